"""Monotone sequences in Elias-Fano form, and files of arrays that are memory-mapped.

A sequence of n numbers below u keeps the low log2(u/n) bits of each number packed, and
the high bits as a bit vector in which the i-th one stands at place high_i + i.  Two
small directories count ones and zeros before each 64 bits.  All operations work on
whole arrays of queries.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
import tempfile

import numpy as np

from quire.llm.shared import file_system, write_file

MAGIC = b"QARR1\0\0\0"


def write_arrays(uri: str, meta: dict, arrays: dict[str, np.ndarray]) -> None:
    """A file of named arrays, each at a multiple of 64 bytes."""
    places, parts, at = {}, [], 0
    for name, array in arrays.items():
        array = np.ascontiguousarray(array)
        places[name] = (array.dtype.str, at, len(array))
        data = array.tobytes()
        parts.append(data + bytes(-len(data) % 64))
        at += len(parts[-1])
    header = json.dumps({"meta": meta, "arrays": places}).encode()
    head = MAGIC + struct.pack("<I", len(header)) + header
    write_file(uri, [head + bytes(-len(head) % 64), *parts, bytes(8)])


def read_arrays(uri: str) -> tuple[dict, dict[str, np.ndarray]]:
    """Meta data and memory-mapped arrays of a file.

    A file of a store that cannot be mapped is copied to a file without a name, which
    is gone with the process.
    """
    fs, path = file_system(uri)
    if fs.type_name == "local":
        source = open(path, "rb")  # noqa: SIM115
    else:
        source = tempfile.TemporaryFile()  # noqa: SIM115
        with fs.open_input_stream(path) as stream:
            while block := stream.read(8 << 20):
                source.write(block)
        source.flush()
    with source:
        view = mmap.mmap(source.fileno(), os.fstat(source.fileno()).st_size, access=mmap.ACCESS_READ, trackfd=False)
    if view[:8] != MAGIC:
        raise ValueError(f"{uri} is no file of arrays")
    (size,) = struct.unpack_from("<I", view, 8)
    header = json.loads(view[12 : 12 + size])
    base = 12 + size + (-(12 + size) % 64)
    arrays = {n: np.frombuffer(view, np.dtype(d), count, base + at) for n, (d, at, count) in header["arrays"].items()}
    return header["meta"], arrays


def encode(values: np.ndarray, name: str) -> tuple[dict, dict[str, np.ndarray]]:
    """Meta data and arrays of a monotone sequence of numbers from 0."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
    packed = []
    step = 1 << 17  # a multiple of 8, so that pieces end at whole bytes
    for k in range(0, n if low else 0, step):
        part = values[k : k + step, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)
        packed.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little"))
    bits = np.zeros(-(-(n + (top >> low) + 2) // 64) * 64, np.uint8)
    bits[((values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)).astype(np.int64)] = 1
    high = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])[:-1]
    zeros = np.arange(len(high), dtype=np.int64) * 64 - ones
    arrays = {
        f"{name}.low": np.concatenate([*packed, np.zeros(8, np.uint8)]),
        f"{name}.high": high,
        f"{name}.ones": ones.astype(np.uint32),
        f"{name}.zeros": zeros.astype(np.uint32),
    }
    return {f"{name}.n": n, f"{name}.bits": low}, arrays


_HALVES = [(np.uint64(s), np.uint64((1 << s) - 1)) for s in (32, 16, 8, 4, 2, 1)]


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th (from 0) set bit of each word."""
    place = np.zeros(len(words), np.int64)
    for shift, mask in _HALVES:
        count = np.bitwise_count(words & mask).astype(np.int64)
        upper = rank >= count
        rank = rank - count * upper
        words = np.where(upper, words >> shift, words)
        place += upper * np.int64(shift)
    return place


class EliasFano:
    """A memory-mapped monotone sequence."""

    def __init__(self, meta: dict, arrays: dict[str, np.ndarray], name: str) -> None:
        self.n, self.low_bits = meta[f"{name}.n"], meta[f"{name}.bits"]
        self.high, self.ones, self.zeros = (arrays[f"{name}.{x}"] for x in ("high", "ones", "zeros"))
        low = arrays[f"{name}.low"]
        # Every byte starts an unaligned 64-bit number.
        self.low = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        self.mask = np.uint64((1 << self.low_bits) - 1)

    def _select(self, before: np.ndarray, rank: np.ndarray, ones: bool) -> np.ndarray:
        word = np.searchsorted(before, rank.astype(before.dtype), side="right") - 1
        bits = self.high[word]
        return word * 64 + _select_in_word(bits if ones else ~bits, rank - before[word].astype(np.int64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        return (self.low[at >> 3] >> (at & 7).astype(np.uint64)) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        high = self._select(self.ones, i, True) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it does not occur: successor search in its bucket."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        last = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1])) - 1  # zeros in all, less one
        inside = np.flatnonzero(high <= last)
        high, wanted = high[inside], values[inside] & self.mask
        first = np.where(high > 0, self._select(self.zeros, np.maximum(high - 1, 0), False) - (high - 1), 0)
        end = self._select(self.zeros, high, False) - high
        lo, hi = first.copy(), end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            middle = (lo[live] + hi[live]) >> 1
            less = self._low(middle) < wanted[live]
            lo[live] = np.where(less, middle + 1, lo[live])
            hi[live] = np.where(less, hi[live], middle)
            live = live[lo[live] < hi[live]]
        there = np.flatnonzero(lo < end)
        there = there[self._low(lo[there]) == wanted[there]]
        out[inside[there]] = lo[there]
        return out
