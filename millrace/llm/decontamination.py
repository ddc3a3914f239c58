"""Exact phrase and proximity search of benchmark items in a corpus, by a positional inverted index.

build_index() cuts the corpus into segments of whole documents and stores, for each segment, the
postings of all its words: the distinct terms in order, and for each term the ascending positions
at which it occurs.  Segments are written to the shared folder; any number of searches read them.

phrase_matches() intersects, within each segment, the lists of a phrase's terms, each shifted by
the term's offset.  It starts from the rarest term, so that most phrases end at a term that the
segment doesn't have.  The phrases of a block of items are intersected at once, in slices of a
bounded number of occurrences.  near_matches()
finds the shortest stretches that hold all terms of an item.

The items are the stated query set.  The driver reads them in blocks of bounded size, and each
block is sent to all segments; nothing of the corpus passes through the driver.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z taken as a-z.

Edge cases: null or empty text has no words, neither hits nor windows; an item without words or
with a null item_id matches nothing; an item of fewer words than a window is one window.  Rows
that share a doc_id, null or not, are told apart by their place in the index and get a result
each.  Items that share an item_id count as one item.  Empty tables give no matches.  Columns
besides doc_id, item_id and text are ignored, but returned by drop_contaminated().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common, textcodes

#: Words and documents of a segment, unless one document alone has more: a row of about 1 MB.
SEGMENT = 1 << 17
#: Row groups of the index, of which readers and writers hold one at once.  Parquet looks at their
#: size and that of pages every 100 rows unless told otherwise; codes and positions don't compress.
FORMAT = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false", "compression": "uncompressed"}
#: Words of the items that are searched in one pass.
BLOCK = 1 << 18
WINDOW = 13
#: Occurrences of rarest terms that are followed at once; one term's list may be longer.
OPEN = 1 << 20

INDEX = "segment long, doc_ids array<long>, n_words array<int>, terms binary, ends binary, positions binary"
MATCHES = "segment long, ordinal int, doc_id long, item_id string, first int, last int"


def _segment(number: int, ids: list, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
    terms, ends = codes[first], np.append(first[1:], len(codes)).astype(np.uint32) if len(first) else np.zeros(0, np.uint32)
    del codes
    row = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))]
    row += [pa.array([x.tobytes()], pa.binary()) for x in (terms, ends, order.astype(np.uint32))]
    return pa.RecordBatch.from_arrays(row, ["segment", "doc_ids", "n_words", "terms", "ends", "positions"])


def _indexer(batches):
    number, ids, codes, counts, size = (TaskContext.get().partitionId() << 24), [], [], [], 0
    for batch in batches:
        words, at = textcodes.word_codes(*textcodes.buffer_of(batch.column("text")), textcodes.ALPHANUMERIC)
        names = batch.column("doc_id").cast(pa.int64()).to_pylist()
        places = at + np.arange(len(at))  # a document takes one besides its words
        begin = 0
        while begin < len(names):
            # as many documents as fit, one at least
            end = max(begin + (not ids), int(np.searchsorted(places, places[begin] + SEGMENT - size, "right")) - 1)
            ids += names[begin:end]
            codes.append(words[at[begin] : at[end]])
            counts.append(np.diff(at[begin : end + 1]))
            size += int(places[end] - places[begin])
            begin = end
            if begin < len(names):
                yield _segment(number, ids, np.concatenate(codes), np.concatenate(counts))
                number, ids, codes, counts, size = number + 1, [], [], [], 0
    if ids:
        yield _segment(number, ids, np.concatenate(codes), np.concatenate(counts))


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of docs (doc_id, text), written to the shared folder."""
    return common.save(docs.select("doc_id", "text").transform(common.map_batches, _indexer, INDEX), "index", **FORMAT)


def _blocks(items: DataFrame) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Item ids and the word codes of their texts, in blocks of about BLOCK words."""
    names, texts, size = [], [], 0
    for name, text in items.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").toLocalIterator():
        codes = textcodes.word_codes(*textcodes.buffer_of(pa.array([text])), textcodes.ALPHANUMERIC)[0]
        names.append(name)
        texts.append(codes)
        size += len(codes)
        if size >= BLOCK:
            yield names, texts
            names, texts, size = [], [], 0
    yield names, texts


class _Postings:
    """One segment's lists."""

    def __init__(self, row: dict):
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ends = np.frombuffer(row["ends"], np.uint32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32).astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.size = len(self.positions) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.ends - self.begins) * self.size + self.positions
        self.bounds = np.concatenate([[0], np.cumsum(row["n_words"])]).astype(np.int64)
        self.ids = row["doc_ids"]

    def ranks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of terms in the dictionary and the lengths of their lists (0: not there)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, np.where(self.terms[at] == terms, self.ends[at] - self.begins[at], 0)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, "right") - 1


def _merged(doc: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Overlapping stretches of one document and item become one."""
    order = np.lexsort((first, item, doc))
    doc, item, first, last = doc[order], item[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (first[1:] > last[:-1] + 1)
    at = np.flatnonzero(new)
    return [doc[at], item[at], first[at], np.maximum.reduceat(last, at) if len(at) else last]


def _matches(row: dict, names: list[str], found: list[np.ndarray], postings: _Postings) -> pa.RecordBatch:
    doc, item, first, last = found
    columns = [
        pa.array(np.full(len(doc), row["segment"]), pa.int64()), pa.array(doc, pa.int32()), pa.array([postings.ids[d] for d in doc], pa.int64()),
        pa.array([names[i] for i in item], pa.string()), pa.array(first - postings.bounds[doc], pa.int32()), pa.array(last - postings.bounds[doc], pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["segment", "ordinal", "doc_id", "item_id", "first", "last"])


def _phrases(texts: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; for each window its terms' numbers (-1 beyond its width), its width and item."""
    rows, widths, owners = [], [], []
    for i, codes in enumerate(texts):
        width = min(window, len(codes))
        for at in range(len(codes) - width + 1 if width else 0):
            rows.append(codes[at : at + width])
            widths.append(width)
            owners.append(i)
    terms = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
    numbers = np.full((len(rows), window), -1)
    for k, row in enumerate(rows):
        numbers[k, : len(row)] = np.searchsorted(terms, row)
    return terms, numbers, np.array(widths, np.int64), np.array(owners, np.int64)


def _intersected(lists: _Postings, ranks: np.ndarray, offsets: np.ndarray, many: np.ndarray, widths: np.ndarray, owners: np.ndarray) -> list[np.ndarray]:
    """Document, item, first and last word of the occurrences of some phrases.

    ranks and offsets are a phrase's terms in the lists and their places in it, the rarest first,
    which occurs so many times.
    """
    which = np.repeat(np.arange(len(many)), many)
    within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    start = lists.positions[lists.begins[ranks[which, 0]] + within] - offsets[which, 0]
    ok = (start >= 0) & (start + widths[which] <= lists.bounds[-1])
    which, start = which[ok], start[ok]
    for k in range(1, ranks.shape[1]):
        wanted = ranks[which, k] * lists.size + start + offsets[which, k]
        at = np.minimum(np.searchsorted(lists.keys, wanted), len(lists.keys) - 1)
        ok = (lists.keys[at] == wanted) | (k >= widths[which])
        which, start = which[ok], start[ok]
    last = start + widths[which] - 1
    doc = lists.doc_of(start)
    ok = lists.doc_of(last) == doc
    return _merged(doc[ok], owners[which[ok]], start[ok], last[ok])


def _phrase_searcher(names: list[str], texts: list[np.ndarray], window: int):
    def search(batches):
        terms, numbers, widths, owners = _phrases(texts, window)
        for batch in batches:
            for row in batch.to_pylist():
                lists = _Postings(row)
                rank, count = lists.ranks(terms)
                counts = np.where(numbers < 0, np.iinfo(np.int64).max, count[numbers]) if len(terms) else np.zeros((0, window), np.int64)
                alive = np.flatnonzero(counts.min(axis=1, initial=1) > 0)
                offsets = np.argsort(counts[alive], axis=1, kind="stable")  # from the rarest term on
                many = counts[alive, offsets[:, 0]] if len(alive) else np.zeros(0, np.int64)
                found, ends, at = [[np.zeros(0, np.int64)] * 4], np.cumsum(many), 0
                while at < len(alive):
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + OPEN, "right")))
                    own = alive[at:to]
                    found.append(_intersected(lists, rank[numbers[own[:, None], offsets[at:to]]], offsets[at:to], many[at:to], widths[own], owners[own]))
                    at = to
                found = _merged(*(np.concatenate(x) for x in zip(*found)))
                yield _matches(row, names, found, lists)

    return search


def _near_searcher(names: list[str], texts: list[np.ndarray], span: int):
    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lists = _Postings(row)
                out = []
                for item, codes in enumerate(texts):
                    rank, count = lists.ranks(np.unique(codes))
                    if not len(rank) or not count.all():
                        continue
                    own = [lists.positions[lists.begins[r] : lists.ends[r]] for r in rank]
                    first = np.sort(np.concatenate(own))
                    last = first.copy()
                    for positions in own:
                        at = np.searchsorted(positions, first)
                        last = np.maximum(last, np.append(positions, np.iinfo(np.int32).max)[at])
                    doc = lists.doc_of(first)
                    ok = (last - first < span) & (last < lists.bounds[doc + 1])
                    out.append([doc[ok], np.full(int(ok.sum()), item), first[ok], last[ok]])
                found = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
                yield _matches(row, names, _merged(*found), lists)

    return search


def _searched(index: DataFrame, items: DataFrame, searcher, argument: int) -> DataFrame:
    out = None
    for names, texts in _blocks(items):
        part = index.transform(common.map_batches, searcher(names, texts, argument), MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stretches (first to last word, from 0) of documents where windows of items (item_id, text) occur.

    A window is so many consecutive words of an item.  Overlapping occurrences are one stretch.
    """
    return _searched(index, items, _phrase_searcher, window)


def near_matches(index: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """Stretches of up to span words that hold every word of an item, in any order."""
    return _searched(index, items, _near_searcher, span)


def contamination(index: DataFrame, matches: DataFrame, num: int = 1, den: int = 20) -> DataFrame:
    """For every document of the index: n_words, n_hit, n_items, items and contaminated."""
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ordinal", "d"))
    docs = docs.select("segment", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
    before = Window.partitionBy("segment", "ordinal").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1))))
    hits = matches.withColumn("new", new).groupBy("segment", "ordinal").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    out = docs.join(hits, ["segment", "ordinal"], "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("segment", "ordinal", "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), ((n_hit > 0) & (den * n_hit >= num * F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents.

    Of rows that share a doc_id, all go if one is contaminated.
    """
    index = build_index(docs)
    bad = contamination(index, phrase_matches(index, items, window)).where("contaminated").select(F.col("doc_id").alias("_id")).distinct()
    return common.by_id(docs, common.small(common.save(bad, "contaminated")), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(common.table(spark, sf_dir, "documents"))
    found = contamination(index, phrase_matches(index, common.table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bk AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0),
bi AS (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bk),
bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM bi),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
di AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw)),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w FROM di),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, w)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), FALSE) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
