"""Scalar functions as column expressions."""

from .geo import *  # noqa: F403
from .scalars import *  # noqa: F403
