"""Words and word shingles of many texts at once, as 64-bit numbers.

A word is a run of bytes other than space and 0x09 to 0x0D; A-Z may count as a-z.
Each word becomes a polynomial hash of its bytes modulo 2**64, computed for a whole
batch of texts by one running sum, and shingles are mixed from the words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quire.llm.shared import LOCAL_BATCH_BYTES, release

SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True

_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close inputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _bytes_table(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * np.uint64(_GOLDEN))


_TABLES = {lower: _bytes_table(lower) for lower in (False, True)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        for old in [k for k in _POWERS if k > 4 * LOCAL_BATCH_BYTES]:
            del _POWERS[old]
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def hash_words(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word in ``data``."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if len(start) == 0:
        return np.empty(0, np.uint64), start, end
    with np.errstate(over="ignore"):
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[lower][data] * up[: len(data)], out=total[1:])
        # The length keeps words apart that differ by bytes of weight zero.
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def _cuts(data: bytes, step: int) -> list[int]:
    """Ends of pieces of about ``step`` bytes that end at white space."""
    view, cuts, at = np.frombuffer(data, np.uint8), [], 0
    while len(view) - at > step:
        to = at + step
        while to < len(view):
            near = np.flatnonzero(_SPACE[view[to : to + step]])
            if len(near):
                to += int(near[0])
                break
            to += step
        at = min(to, len(view))
        cuts.append(at)
    if not cuts or cuts[-1] < len(view):
        cuts.append(len(view))
    return cuts


def word_hashes(texts: list[bytes], lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bounds, hashes) of groups of whole texts.

    ``hashes[bounds[i]:bounds[i+1]]`` are the words of text ``first + i``.  A group
    has about LOCAL_BATCH_BYTES; a longer text is a group of its own and is read in
    pieces, so only its hashes are held whole.
    """
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < LOCAL_BATCH_BYTES):
            size += len(texts[to]) + 1
            to += 1
        if size > 2 * LOCAL_BATCH_BYTES:
            whole, hashes, last = texts[at], [], 0
            for cut in _cuts(whole, LOCAL_BATCH_BYTES):
                hashes.append(hash_words(np.frombuffer(whole[last:cut], np.uint8), lower)[0])
                last = cut
            joined = np.concatenate(hashes)
            yield at, np.array([0, len(joined)]), joined
        else:
            data = np.frombuffer(b" ".join(texts[at:to]), np.uint8)
            hashes, start, _ = hash_words(data, lower)
            ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
            yield at, np.concatenate([[0], np.searchsorted(start, ends)]), hashes
        at = to


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * np.uint64(_BASE) + words[k : k + n]
        return mix(out)


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted by hash.

    A text with fewer words than ``width`` has its whole sequence as one shingle; a
    text without words has none.
    """
    for _, bounds, hashes in word_hashes(texts):
        runs = shingle_hashes(hashes, width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                ordered = np.sort(runs[a : b - width + 1])
                yield ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
            elif b > a:
                yield shingle_hashes(hashes[a:b], b - a)
            else:
                yield np.empty(0, np.uint64)


ROWS_AT_ONCE = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts at a time are held as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)
        del batch
        release()


def texts_of(column) -> list[bytes]:
    """Bytes of an Arrow string column; null counts as empty."""
    return [b"" if t is None else t.encode() for t in column.to_pylist()]
