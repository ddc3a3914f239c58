"""Byte-level BPE's pre-tokens of whole Arrow batches, found in numpy.

The pattern is public_tokenizers.PATTERN.  Its matches tile a text, and each starts where the
class of a character (letter, number, white space, other) changes, but for three rules: a space
belongs to the letters, numbers or others after it; white space before something else gives its
last character away; and 's 't 're 've 'm 'll 'd after anything but a space are tokens.
"""

from __future__ import annotations

import numpy as np
import regex

from millrace.llm import textcodes

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_classes: list[np.ndarray] = []


def _char_classes() -> np.ndarray:
    if not _classes:
        table = np.zeros(0x110000, np.int8)
        at = np.concatenate([np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)])  # no surrogates
        everything = at.tobytes().decode("utf-32-le")
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for match in regex.finditer(pattern, everything):
                table[at[match.start() : match.end()]] = kind
        _classes.append(table)
    return _classes[0]


def _starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where tokens start in texts that lie end to end; bounds are the texts' starts and the end."""
    n = len(points)
    kind = _char_classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[n] = True
    space = kind == _SPACE
    # the last white space before something else in the same text
    last = np.zeros(n, bool)
    last[: n - 1] = space[:-1] & ~space[1:] & ~edge[1:n]
    start = run[:n].copy()
    start |= last
    blank = last & (points == 0x20)
    start[1:] &= ~blank[:-1]
    apostrophe = np.flatnonzero((points == 0x27) & start & run[:n])
    apostrophe = apostrophe[apostrophe + 1 < n]
    if len(apostrophe):
        apostrophe = apostrophe[~edge[apostrophe + 1]]
        one = points[apostrophe + 1]
        far = np.minimum(apostrophe + 2, n - 1)
        two = np.where((apostrophe + 2 < n) & ~edge[far], points[far], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for own, length in ((apostrophe[short], 2), (apostrophe[long], 3)):
            start[own + 1] = False
            rest = own + length
            rest = rest[rest < n]
            start[rest[kind[rest] == _LETTER]] = True
    return np.flatnonzero(start)


def pretokens(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and first bytes of all tokens of texts end to end, in order.

    Texts are worked through in pieces of whole texts; a very long text is one piece.
    """
    codes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + textcodes.PIECE, "right")) - 1)
        part = buf[bounds[at] : bounds[to]]
        if len(part):
            points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
            byte = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
            texts = np.searchsorted(byte, np.unique(bounds[at : to + 1]) - bounds[at])
            first = byte[_starts(points, texts)]
            codes.append(textcodes.stretch_codes(part, first))
            starts.append(first + bounds[at])
        at = to
    return np.concatenate(codes), np.concatenate(starts)
