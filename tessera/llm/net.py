"""Small pieces of the numpy networks: Adam, byte buffers, bounded training samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Index of the padding symbol behind the 256 bytes.
PAD = 256


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (size + 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            fixed = np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.params[k] -= (self.rate * fixed * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.params[k].dtype)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array, and its offsets; nulls are empty."""
    texts = pa.concat_arrays([texts.fill_null("")])  # offsets from 0
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def padded(data: np.ndarray, offsets: np.ndarray, unit: int, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(units x unit bytes with PAD behind each text, units of each text): texts start at a unit and have `extra` units of PAD more."""
    sizes = np.diff(offsets)
    units = np.maximum(1, -(-sizes // unit)) + extra
    starts = (np.cumsum(units) - units) * unit
    out = np.full(int(units.sum()) * unit, PAD, np.int16)
    out[np.arange(len(data)) + np.repeat(starts - offsets[:-1], sizes)] = data
    return out.reshape(-1, unit), units
