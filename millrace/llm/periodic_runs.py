"""Periodic runs of words, by the linear method for all tandem repeats (Gusfield and Stoye).

A run is a stretch of consecutive words with smallest period q and at least max(least, times * q)
words that no neighbouring word extends keeping period q.  Documents are read in Arrow batches; no
step shuffles, and nothing is cut off: whole texts are read, a batch at a time.

1. Words become numbers, equal words equal numbers.
2. Where can a run be?  In a run, every stretch of `gram` words that starts in its part after the
   first q words occurred q words before.  So the places whose gram occurred before in the same
   document come in stretches, and one of m places holds a run only if some gram in it lies no more
   than (m + gram - 1) / 2 behind; then the whole run lies within that many words before the stretch
   and a gram after it.  Other words are left out: this is a proof, not a guess (hashes decide, and
   equal grams have equal hashes).  What is left of a batch is one text, each region ended by a
   symbol of its own.
3. The suffix tree of that text, as suffix array and names: names[k] numbers all substrings of 2^k
   symbols in their order.  A node or place in the tree is an interval of suffixes and a length;
   the suffix link of the place of a substring at i is the place of that at i + 1.
4. Lempel-Ziv blocks, from the longest earlier occurrence of each suffix.  The leftmost occurrence of
   a square has its centre in a block and ends in it or the next one; common extensions to both
   sides of block starts, for every period up to the two blocks' length, give a square for each such
   occurrence that it is reached from by rotations (the leftmost covering set).
5. From each of these, suffix links lead to the next rotation as long as the tree has it, at most
   once round the period.  The places met are the vocabulary: every distinct square.  Only squares
   of a primitive root count, so that a square's period is the smallest.
6. All suffixes below the places of the vocabulary are the squares' occurrences; those of one period
   at consecutive words merge into runs.

Edge cases: null and empty texts, and texts without words, have no runs and an empty collapsed text;
a null doc_id is a document like others, whose words stay as they are; repeated rows are treated
each for itself; an empty table gives an empty result.  Extra columns are returned by collapse(),
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.llm import common

LEAST, TIMES = 24, 3
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Symbols of regions that one suffix tree holds, if they are of several documents.
TREE = 1 << 19
#: (doc_id, number of words) to the numbers of the words to read instead, or None.
Alter = Callable[[int | None, int], np.ndarray | None]


def names(text: np.ndarray) -> list[np.ndarray]:
    """names()[k][i] numbers text[i : i + 2**k] in order; the last one numbers the suffixes.

    The text must end in a symbol that it has nowhere else.
    """
    n = len(text)
    found = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
    while n > 1 and found[-1].max() < n - 1:
        half = 1 << (len(found) - 1)
        key = found[-1].astype(np.int64) * (n + 1)
        key[: n - half] += found[-1][half:].astype(np.int64) + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.zeros(n, np.int32)
        rank[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        name = np.empty(n, np.int32)
        name[order] = rank
        found.append(name)
    return found


def ahead(found: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of the suffixes at i and at j, where i is not j."""
    start, i, j = i, i.copy(), j.copy()
    for k in range(len(found) - 2, -1, -1):
        step = (found[k][i] == found[k][j]).astype(np.int64) << k
        i += step
        j += step
    return i - start


def behind(found: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common suffixes of text[: i + 1] and text[: j + 1]; -1 is before the text."""
    start, i, j = i, i.copy(), j.copy()
    for k in range(len(found) - 2, -1, -1):
        a, b = i + 1 - (1 << k), j + 1 - (1 << k)
        step = ((np.minimum(a, b) >= 0) & (found[k][np.maximum(a, 0)] == found[k][np.maximum(b, 0)])).astype(np.int64) << k
        i -= step
        j -= step
    return start - i


def blocks(found: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end: each is the longest that began earlier too, or one symbol."""
    n = len(order)
    before, after, open_ = [-1] * n, [-1] * n, []
    for at in order.tolist():  # the nearest smaller suffix starts on both sides in suffix order
        while open_ and open_[-1] > at:
            after[open_.pop()] = at
        before[at] = open_[-1] if open_ else -1
        open_.append(at)
    longest = np.zeros(n, np.int64)
    for near in (np.array(before), np.array(after)):
        at = np.flatnonzero(near >= 0)
        longest[at] = np.maximum(longest[at], ahead(found, at, near[at]))
    step, starts, at = np.maximum(longest, 1).tolist(), [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    return np.array([*starts, n], np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): (0, 0, 1, 1, 1) and (0, 1, 0, 1, 2)."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def covering(found: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of a square for each leftmost occurrence of a square that it reaches by rotations."""
    n, here, size = len(found[0]), starts[:-1], np.diff(starts)
    after = np.append(size[1:], 0)
    squares = []
    of, k = _spread(size)  # centre within a block, end in the next one
    k, edge = k + 1, (here + size)[of]
    fits = (edge < n) & (edge - k >= 0)
    k, edge = k[fits], edge[fits]
    same = found[0][edge] == found[0][edge - k]
    k, edge = k[same], edge[same]
    right, left = ahead(found, edge, edge - k), behind(found, edge - 1, edge - k - 1)
    hit = right + left >= k
    squares.append((np.maximum(edge - k - left, edge - 2 * k + 1)[hit], k[hit]))
    of, k = _spread(size + after)  # start left of a block, centre within it
    k, edge = k + 1, here[of]
    fits = (edge + k < n) & (edge > 0)
    k, edge = k[fits], edge[fits]
    same = (found[0][edge] == found[0][edge + k]) & (found[0][edge - 1] == found[0][edge + k - 1])
    k, edge = k[same], edge[same]
    right, left = ahead(found, edge, edge + k), behind(found, edge - 1, edge + k - 1)
    hit = right + left >= k
    squares.append((np.maximum(edge - left, edge - k + 1)[hit], k[hit]))
    return np.concatenate([s for s, _ in squares]), np.concatenate([k for _, k in squares])


def primitive(found: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Is the square's half no power of a shorter word?  Asked for each prime factor of its length."""
    out, rest = np.ones(len(start), bool), period.copy()
    most = int(period.max(initial=1))
    least = np.arange(most + 1)  # the least prime factor of each number
    for p in range(2, int(most**0.5) + 1):
        if least[p] == p:
            many = least[p * p :: p]
            many[many == np.arange(p * p, most + 1, p)] = p
    while (more := np.flatnonzero(rest > 1)).size:
        p = least[rest[more]]
        part = period[more] // p
        out[more] &= ahead(found, start[more], start[more] + part) < 2 * period[more] - part
        divides = np.ones(len(more), bool)
        while divides.any():
            rest[more[divides]] //= p[divides]
            divides &= rest[more] % p == 0
    return out


def _below(found: list[np.ndarray], order: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place in suffix order of the suffixes that begin with text[start : start + length]."""
    n, level = len(order), np.floor(np.log2(length)).astype(np.int64)
    table, tail = np.concatenate(found), length - (1 << level)
    offset = level * n
    head, foot = table[offset + start], table[offset + start + tail]

    def equal(place: np.ndarray) -> np.ndarray:
        at = order[np.clip(place, 0, n - 1)]
        inside = (place >= 0) & (place < n) & (at + length <= n)
        at = np.where(inside, at, 0)
        return inside & (table[offset + at] == head) & (table[offset + np.minimum(at + tail, n - 1)] == foot)

    low, high = found[-1][start].astype(np.int64), found[-1][start].astype(np.int64)
    for k in range(n.bit_length(), -1, -1):
        low = np.where(equal(low - (1 << k)), low - (1 << k), low)
        high = np.where(equal(high + (1 << k)), high + (1 << k), high)
    return low, high


def runs_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of two periods or more, by period and start.

    The text must end in a symbol that it has nowhere else.
    """
    none = np.zeros(0, np.int64)
    found = names(text)
    order = np.empty(len(text), np.int64)
    order[found[-1]] = np.arange(len(text))
    start, period = covering(found, blocks(found, order))
    whole = primitive(found, start, period)
    start, period = start[whole], period[whole]
    if not len(start):
        return none, none, none
    rotations = np.minimum(ahead(found, start, start + period) - period + 1, period)
    of, turn = _spread(rotations)
    start, period = start[of] + turn, period[of]
    low, high = _below(found, order, start, 2 * period)
    _, met = np.unique(low * len(text) + period, return_index=True)
    low, high, period = low[met], high[met], period[met]
    of, nth = _spread(high - low + 1)
    key = np.sort(period[of] * len(text) + order[low[of] + nth])
    first = np.flatnonzero(np.append(True, np.diff(key) != 1))
    last = np.append(first[1:], len(key)) - 1
    period = key[first] // len(text)
    at = key[first] % len(text)
    return at, last - first + 2 * period, period


def regions(numbers: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches of the documents' words (numbers; documents end at ends) that hold all their runs."""
    # a run of length l and period q repeats l - q words, at least the smaller of the two bounds here
    gram = max(1, min(max(least - q, (times - 1) * q) for q in range(1, least + 1)))
    n = len(numbers)
    if n < gram + 1:
        return []
    size, value = 1, numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    value ^= value >> np.uint64(29)
    base, grams, done = np.uint64(0xD1342543DE82EF95), np.zeros(n, np.uint64), 0
    weight, power = base, np.uint64(1)
    rest = gram
    with np.errstate(over="ignore"):
        while rest:  # gram as a sum of powers of two
            if rest & 1:
                grams[: n - done] += power * value[done:]
                done, power = done + size, power * weight
            if rest := rest >> 1:
                value = value.copy()
                value[: n - size] += weight * value[size:]
                weight, size = weight * weight, 2 * size
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    whole = np.flatnonzero(np.arange(n) + gram <= ends[doc])
    order = whole[np.argsort(grams[whole], kind="stable")]
    met = (grams[order[1:]] == grams[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    back = np.zeros(n, np.int64)
    back[order[1:][met]] = (order[1:] - order[:-1])[met]
    again = np.flatnonzero(back)
    if not len(again):
        return []
    new = np.append(True, (np.diff(again) != 1) | (doc[again[1:]] != doc[again[:-1]]))
    first = np.flatnonzero(new)
    m = np.diff(np.append(first, len(again)))
    reach = (m + gram - 1) // (times - 1)  # the greatest period
    possible = np.minimum.reduceat(back[again], first) <= reach
    begins, out = np.append(0, ends), []
    for at, many, far in zip(again[first][possible].tolist(), m[possible].tolist(), reach[possible].tolist()):
        begin, end = int(begins[doc[at]]), int(ends[doc[at]])
        low, high = max(at - far - 1, begin), min(at + many + gram, end)
        while out and out[-1][1] >= low and out[-1][0] >= begin:
            before = out.pop()
            low, high = min(low, before[0]), max(high, before[1])
        out.append((low, high))
    return out


def find(numbers: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the documents' runs, by start and period; starts count all documents' words."""
    parts, group, size = [], [], 0
    for at, to in [*regions(numbers, ends, least, times), (-1, -1)]:
        if group and (at < 0 or size + to - at > TREE):
            top = int(numbers.max()) + 1
            text = np.concatenate([np.append(numbers[a:b], top + i) for i, (a, b) in enumerate(group)])
            begin = np.cumsum([0] + [b - a + 1 for a, b in group])
            start, length, period = runs_of(text)
            long = length >= np.maximum(least, times * period)
            of = np.searchsorted(begin, start[long], "right") - 1
            parts.append((start[long] - begin[of] + np.array([a for a, _ in group])[of], length[long], period[long]))
            group, size = [], 0
        group.append((at, to))
        size += to - at
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _batches(alter: Alter | None, least: int, times: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            known: dict[bytes, int] = defaultdict(count().__next__)
            numbers, texts, changed = [], [], {}
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()  # bytes.split() cuts at \x20 and \x09-\x0D
                read = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                if alter is not None and (of := alter(ids[i], len(words))) is not None:
                    words, read = [words[j] for j in of.tolist()], read[of]
                numbers.append(read)
                texts.append(b" ".join(words))
            ends = np.cumsum(np.array([len(x) for x in numbers], np.int64))
            start, length, period = find(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), ends, least, times)
            doc = np.searchsorted(ends, start, "right")
            start = start - np.append(0, ends)[doc]
            offsets = np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)
            for i in np.unique(doc).tolist():
                stay = np.ones(len(numbers[i]), bool)
                for s, l, q in zip(*(x[offsets[i] : offsets[i + 1]] for x in (start, length, period))):
                    stay[s + q : s + l] = False
                words = texts[i].split(b" ")
                changed[i] = b" ".join([words[j] for j in np.flatnonzero(stay).tolist()])
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"]))
            collapsed = pa.array([changed.get(i, t) for i, t in enumerate(texts)], pa.binary()).cast(pa.string())
            rest = [batch.column(j) for j in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, found, collapsed], [batch.schema.field(0).name, *batch.schema.names[2:], "runs", "collapsed"])

    return run


def runs(docs: DataFrame, alter: Alter | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (start, length, period, by start and period) and collapsed, the text without the
    words that a run holds after its first period, its words joined by one space."""
    if times < 2 or least < 1:
        raise ValueError("a run has two periods at least")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_batches(docs.select("doc_id", "text"), _batches(alter, least, times), f"doc_id {kind}, runs {RUNS}, collapsed string")


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with the text of documents that have runs collapsed; other texts and columns as they were."""
    read = docs.select("doc_id", "text", F.struct("*").alias("row"))
    schema = StructType([read.schema["doc_id"], read.schema["row"], StructField("runs", StructType.fromDDL(f"r {RUNS}")["r"].dataType), StructField("collapsed", StringType())])
    found = common.map_batches(read, _batches(None, least, times), schema)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("row.text"))
    return found.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words of one in ten documents repeat from some word on, as the query's contract says."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.append(np.arange(a), a + np.arange(n - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(common.table(spark, sf_dir, "documents"), planted)
    # the greatest length / period: compared as fractions, both parts of which are whole
    best = F.aggregate(
        "runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
