"""Scan of JSON documents whose rows are the elements of one array, in as many tasks as there are byte ranges.

Spark's text source cuts a file at commas by byte ranges.  Whether a range begins within a string, and
how deep, depends on all ranges before it, so each is first summed up for both cases (parity of its
quotes, brackets outside and inside of strings); a running sum over the ranges, of which there is a
row each, gives every range its state.  A second scan cuts the elements out.  An element that crosses
ranges is put together by its place in the array, which is the number of commas before it.

Edge cases: strings may hold commas, brackets and escaped quotes; null and scalar elements take a
place but give no row; a missing or empty array gives no rows; of an empty file nothing is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import storage

_CHARS = r'(?:[^"\\]++|\\.)*+("?)'
_REST = re.compile(_CHARS, re.S)
_DEEP = re.compile(rf'"{_CHARS}|[{{}}\[\]]', re.S)
_SHALLOW = re.compile(rf'"{_CHARS}|[{{}}\[\],]', re.S)
_ESCAPED = re.compile(r"\\.", re.S)
#: Characters of elements that go into one batch.
BATCH = 1 << 22
_CUT = "file string, start long, ending boolean, listed boolean, inherited long, known long, whole boolean, text string"


class Document(NamedTuple):
    """elements: file, place, text of each element; outer: file, text of the document without its nested values."""

    elements: DataFrame
    outer: DataFrame


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What is between commas, in the order of the file within each range (file, start)."""
    return spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value"))


def _chunks(batches) -> Iterator[tuple[tuple, str]]:
    """A range's columns besides value, and text of it; each piece is followed by a comma."""
    for batch in batches:
        names = [n for n in batch.schema.names if n != "value"]
        keys = zip(*(batch.column(n).to_pylist() for n in names))
        for key, rows in groupby(zip(keys, batch.column("value").to_pylist()), lambda x: x[0]):
            yield key, ",".join(v for _, v in rows) + ","


def _brackets(parts: list[str]) -> int:
    return sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts)


def _summary(batches):
    for (file, start), chunks in groupby(_chunks(batches), lambda x: x[0]):
        odd, depths = 0, [0, 0]
        for _, text in chunks:
            parts = _ESCAPED.sub("", text).split('"')
            depths[odd] += _brackets(parts[::2])
            depths[1 - odd] += _brackets(parts[1::2])
            odd = (odd + len(parts) - 1) % 2
        yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "odd": [odd], "outside": [depths[0]], "inside": [depths[1]]})


def _states(pieces: DataFrame) -> DataFrame:
    """Of each range: whether it begins in a string, and how many brackets are open there."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    found = pieces.mapInArrow(_summary, "file string, start long, odd long, outside long, inside long")
    found = found.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    depth = F.sum(F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))).over(before)
    return found.withColumn("depth", F.coalesce(depth, F.lit(0))).select("file", "start", "quoted", "depth")


def cut(chunks: Iterator[str], quoted: bool, depth: int, name: str) -> Iterator[tuple]:
    """(ending, listed, inherited, known, whole, text) of each element of a range, or of the part of it that is there.

    listed tells if the array around is the one called name, null if it was opened before the range;
    inherited and known count its commas in the range so far, in either case.  The last row has
    ending: the totals, the array open at the end, and the text outside of nested values.
    """
    key, listed, commas, whole, element, outer = "", None, {None: 0, True: 0, False: 0}, False, [], []
    for text in chunks:
        at = kept = 0
        if quoted:
            found = _REST.match(text)
            quoted, at = not found[1], found.end()
        while not quoted and (found := (_SHALLOW if depth == 2 else _DEEP).search(text, at)):
            at, token = found.end(), found[0]
            if token[0] == '"':
                quoted = not found[1]
                key = token if depth == 1 else key
            elif token == ",":
                commas[listed] += 1
            elif token in "{[":
                depth += 1
                if depth == 2:
                    outer.append(text[kept:at])
                    listed = token == "[" and key == f'"{name}"'
                elif depth == 3:
                    kept, whole = found.start(), True
            else:
                depth -= 1
                if depth == 2:
                    if listed is not False:
                        yield False, listed, commas[None], commas[True], whole, "".join([*element, text[kept:at]])
                    element = []
                elif depth == 1:
                    kept = found.start()
        if depth > 2 and listed is not False:
            element.append(text[kept:])
        elif depth < 2:
            outer.append(text[kept:])
    if depth > 2 and listed is not False:
        yield False, listed, commas[None], commas[True], False, "".join(element)
    yield True, listed, commas[None], commas[True], False, "".join(outer)


def _cutter(name: str):
    names = [c.split()[0] for c in _CUT.split(", ")]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string()])))

    def run(batches):
        rows, size = [], 0
        for (file, start, quoted, depth), chunks in groupby(_chunks(batches), lambda x: x[0]):
            for row in cut((text for _, text in chunks), quoted, depth, name):
                rows.append((file, start, *row))
                size += len(row[-1]) + 64
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    return run


def read_elements(spark: SparkSession, path: str, name: str) -> Document:
    """The elements of the array called name in the object that each file at path is."""
    pieces = _pieces(spark, path)
    # A broadcast keeps the order of the scan; it has a row for each range, as the scan has a task.
    placed = pieces.join(F.broadcast(_states(pieces)), ["file", "start"]).select("file", "start", "quoted", "depth", "value")
    parts = storage.written(placed.mapInArrow(_cutter(name), _CUT), "elements")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.where("ending")
    entering = ends.select("file", "start", "inherited", "known", F.coalesce(F.last("listed", ignorenulls=True).over(before), F.lit(False)).alias("entering"))
    commas = F.when(F.col("entering"), F.col("inherited")).otherwise(0) + F.col("known")
    starts = entering.select("file", "start", "entering", F.coalesce(F.sum(commas).over(before), F.lit(0)).alias("before"))
    own = parts.where("not ending").join(storage.small(starts), ["file", "start"]).where(F.coalesce("listed", "entering"))
    own = own.select("file", "start", (F.col("before") + commas).alias("place"), "whole", "text")
    text = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text")
    crossing = own.where("not whole").groupBy("file", "place").agg(text())
    outer = ends.groupBy("file").agg(text()).select("file", F.regexp_replace("text", r"^\x{FEFF}|[,\s]+$", "").alias("text"))
    return Document(own.where("whole").select("file", "place", "text").unionByName(crossing), outer)
