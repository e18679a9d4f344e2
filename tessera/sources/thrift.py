"""The compact form that Parquet footers and page indexes are written in, as nested dicts by field number."""

from __future__ import annotations

import struct

# Kinds of values, and the physical types of columns in their order.
TRUE, FALSE, BYTE, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = 1, 2, 3, 7, 8, 9, 10, 11, 12
PHYSICAL = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the data end too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        """An unsigned number in groups of seven bits."""
        out = shift = 0
        while True:
            (b,) = self.take(1)
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def signed(self) -> int:
        n = self.number()
        return n >> 1 ^ -(n & 1)

    def value(self, kind: int, depth: int = 0):
        if kind in (TRUE, FALSE):
            return kind == TRUE
        if kind == BYTE:
            return int.from_bytes(self.take(1), "little", signed=True)
        if kind < DOUBLE:
            return self.signed()
        if kind == DOUBLE:
            return struct.unpack("<d", self.take(8))[0]
        if kind == BINARY:
            return self.take(self.number())
        if kind in (LIST, SET):
            (head,) = self.take(1)
            size, own = head >> 4 if head >> 4 != 15 else self.number(), head & 15
            return [self.take(1) == b"\x01" if own in (TRUE, FALSE) else self.value(own, depth + 1) for _ in range(size)]
        if kind == MAP:
            size = self.number()
            both = self.take(1)[0] if size else 0
            return [(self.value(both >> 4, depth + 1), self.value(both & 15, depth + 1)) for _ in range(size)]
        if kind == STRUCT:
            return self.struct(depth + 1)
        raise ValueError(f"kind {kind}")

    def struct(self, depth: int = 0) -> dict[int, object]:
        if depth > 64:
            raise ValueError("nested too deeply")
        out, field = {}, 0
        while (head := self.take(1)[0]) != 0:
            field = field + (head >> 4) if head >> 4 else self.signed()
            out[field] = self.value(head & 15, depth)
        return out


def parse(data: bytes) -> dict[int, object]:
    return Reader(data).struct()
