"""Words and shingles of whole Arrow batches as 64-bit codes, in numpy.

A word's code is a polynomial in its bytes modulo 2**64, mixed afterwards.  With prefix sums of
the polynomial, all words of a piece of text get their codes at once, without a Python loop over
words.  Two different words share a code with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are turned into codes at a time; a longer text is cut between words.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit codes over all others (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(is_word) -> np.ndarray:
    """A table of 256: for each byte whether it is part of a word."""
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words are what lies between ASCII white space.
NOT_SPACE = byte_classes(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are ASCII letters and digits and whatever is not ASCII.
ALPHANUMERIC = byte_classes(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_FOLDED_VALUES = _VALUES[_FOLD]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n + 1 bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, size: int = 1 << 21):
    """Runs of a batch's rows with about so many bytes of text, one row at least."""
    bounds = buffer_of(batch.column("text"))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _cuts(buf: np.ndarray, bounds: np.ndarray, classes: np.ndarray):
    at = 0
    while at < len(buf):
        to = min(at + PIECE, len(buf))
        if to < len(buf):
            end = int(bounds[np.searchsorted(bounds, to, "right") - 1])
            if end > at:
                to = end
            else:  # one text is longer than a piece: go on to the next byte between words
                while to < len(buf) and len(gap := np.flatnonzero(~classes[buf[to : to + 4096]])) == 0:
                    to += 4096
                to = min(to + int(gap[0]), int(bounds[np.searchsorted(bounds, at, "right")])) if to < len(buf) else len(buf)
                to = min(to, int(bounds[np.searchsorted(bounds, at, "right")]))
        yield at, to
        at = to


def word_codes(buf: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, A-Z taken as a-z, and n + 1 bounds that give each text its words."""
    codes, starts = [], []
    for at, to in _cuts(buf, bounds, classes):
        part = buf[at:to]
        inside = classes[part]
        first = np.zeros(len(part) + 1, bool)
        own = bounds[np.searchsorted(bounds, at, "left") : np.searchsorted(bounds, to, "right")] - at
        first[own] = True
        begin = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
        end = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        power, inverse = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_FOLDED_VALUES[part] * power[: len(part)], out=sums[1:])
        codes.append(mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)))
        starts.append(begin + at)
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(codes), np.searchsorted(np.concatenate(starts), bounds).astype(np.int64)


def shingle_codes(words: np.ndarray, n: int) -> np.ndarray:
    """Codes of one text's shingles of n words, repeats included; fewer words are one shingle."""
    if len(words) == 0:
        return words
    width = min(n, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(3) + words[k : len(words) - width + 1 + k] + np.uint64(k + 1))
    return out


def stretch_codes(part: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Codes of the stretches of bytes, as they are, that begin at starts; each ends at the next."""
    power, inverse = _tables(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_VALUES[part] * power[: len(part)], out=sums[1:])
    end = np.append(starts[1:], len(part))
    return mix((sums[end] - sums[starts]) * inverse[starts] + (end - starts).astype(np.uint64))


def distinct_stretches(buf: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct stretches of buf and, for each stretch, its number among them."""
    _, first, number = np.unique(codes, return_index=True, return_inverse=True)
    ends = np.append(starts[1:], len(buf))
    data = buf.tobytes()
    return [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], number


def gathered(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pieces of flat, one after another; places are worked out for some PIECE values at a time."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    shift, at, done = begins - ends + lengths, 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        out[done : ends[to - 1]] = flat[np.arange(done, ends[to - 1]) + np.repeat(shift[at:to], lengths[at:to])]
        at, done = to, int(ends[to - 1])
    return out
