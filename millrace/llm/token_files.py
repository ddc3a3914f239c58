"""Token ids in Parquet files that can be read selectively.

write() encodes documents and stores a row for each: doc_id, part, row, before, n_tokens and the
list column ids.  Files follow each other in ascending doc_id order, and rows within a file too,
so that row-group and page statistics of doc_id are narrow: a reader of some doc_ids skips the
other pages, and a reader of the metadata never touches the ids.  Ids are dictionary encoded, with
delta encoding where a dictionary grows too large; row groups and pages have bounded sizes.

read() gives the documents back, with `start`: the number of ids of all documents before.  Each
row holds the count within its file, so only one number for each file has to be added up.

Text is encoded as the tokenizers library encodes it, pre-token by pre-token: byte_bpe.encode()
gathers the distinct pre-tokens of the corpus, and the library's model encodes each once.  With
split_added, the default, strings of the vocabulary's added tokens in a text are those tokens, as by
the library's own default; without, they are ordinary text.

Edge cases: null text counts as empty and holds the end id alone; null doc_ids come first; rows
that share a doc_id are ordered by a hash of their ids.  An empty table writes no rows and reads
back as an empty table.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import common
from millrace.llm.byte_bpe import Coder, MakeCoder, encode, unpack

VOCABULARY = "byte_bpe_50k.json"
END = 0
FORMAT = {
    "parquet.block.size": 32 << 20,
    "parquet.page.size": 256 << 10,
    "parquet.page.row.count.limit": 2000,
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": 1 << 20,
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}
ROWS = "doc_id long, part int, row long, before long, n_tokens long, ids array<int>"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the model's vocabulary.

    Visible characters of Latin-1 stand for themselves, the other bytes in order for those from 256 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


def added_tokens(vocabulary: str) -> dict[bytes, int]:
    """Added tokens and ids of a tokenizer, given as JSON."""
    return {t["content"].encode(): t["id"] for t in json.loads(vocabulary)["added_tokens"]}


def by_library(vocabulary: str, added: dict[bytes, int] | None = None) -> MakeCoder:
    """Encodes words by the model of the library's tokenizer, given as JSON, and added ones by their ids."""
    known = added or {}

    def make() -> Coder:
        model, letters = Tokenizer.from_str(vocabulary).model, _byte_letters()
        return lambda word: [known[word]] if word in known else [t.id for t in model.tokenize(word.decode("latin-1").translate(letters))]

    return make


def _rows(end: int):
    def rows(batches):
        row = before = 0
        for batch in batches:
            own = [np.append(unpack(x), end).astype(np.int32) for x in batch.column("ids").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            n = len(own)
            tokens = np.concatenate([*own, np.zeros(0, np.int32)])
            columns = [batch.column("doc_id"), pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32()), pa.array(np.arange(row, row + n)), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "row", "before", "n_tokens", "ids"])
            row, before = row + n, before + int(ends[-1])

    return rows


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, split_added: bool = True) -> None:
    """Write the ids of docs (doc_id, text), with the end id after each document."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        text = f.read()
    made: list[str] = []
    with common.recording(made):
        added = added_tokens(text) if split_added else {}
        encoded = encode(docs, coder=by_library(text, added), packed=True, added=tuple(added))
    saved = common.save(encoded.select("doc_id", "ids"), "encoded")
    common.delete(docs.sparkSession, made)
    tie = F.xxhash64("ids")
    ordered = saved.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.transform(common.map_batches, _rows(end), ROWS).write.options(**FORMAT).parquet(path)
    common.discard(saved)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files at path: doc_id, part, row, start, n_tokens, ids."""
    rows = spark.read.schema(ROWS).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    offset = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = common.small(parts.select("part", offset.alias("offset")))
    return rows.join(offsets, "part").select("doc_id", "part", "row", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids")


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), np.uint32)
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/token-files-{common.uuid.uuid4().hex[:12]}"
    write(common.table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids").transform(common.map_batches, _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
