"""Byte-level BPE over a corpus: each distinct word is encoded once.

encode() works through chunks of documents.  In a chunk, every pre-token becomes the number of a
word in the chunk's own list, frequent words first; numbers in order of place are the exploded
text.  The lists are cut into buckets by the words' hashes and shuffled, so that all lists' equal
words meet in one task, which encodes each distinct word once.  Its ids go back to the chunks by
another shuffle and, in order of place, into the documents.  The places themselves are the bulk of
the data: they are written once, packed, into a table bucketed by chunk, and never shuffled.  A
frequent word costs one entry for each chunk, not one for each time it occurs.

decode() joins ids with the table of token bytes, whose size the vocabulary fixes.

ids are little-endian unsigned 32-bit integers in one binary value; ids_array() makes them an
array.  Text is split by no special tokens but those that encode() is given as added.

Edge cases: null text counts as empty and has no ids; null and repeated doc_ids are kept as they
are, a row each.  Ids that the table lacks decode to nothing.  Columns besides doc_id and text
are ignored by encode(); decode() returns all columns.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, pretokens, textcodes

#: Bytes of text of a chunk, unless one document alone has more.
CHUNK = 1 << 23
#: Bytes of text of a chunk whose words are listed at once, unless one document alone has more.
RUN = 1 << 20
#: Buckets of words, at least and at most; between them, as many as a shuffle has partitions.  Each
#: task of the word shuffle takes its buckets one after another.  More buckets would cut a chunk's
#: list into pieces of a few words.
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
RANKS = "byte_bpe_50k.tiktoken"
Coder = Callable[[bytes], list[int]]
MakeCoder = Callable[[], Coder]
#: A row for each chunk's text, where bucket is null: doc_ids, words of each, places of all words,
#: and the bucket of each word of the list.  And a row for each bucket of a chunk's words.
CHUNKS = "chunk long, bucket int, doc_ids array<long>, n_words array<int>, places binary, buckets binary, lengths binary, words binary"
IDS = "of long, bucket int, lengths binary, ids binary"


def ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes and ids of a rank file, by default that of the public vocabulary."""
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return {base64.b64decode(token): int(number) for token, number in (line.split() for line in f if line.strip())}


def chunked(batches, size: int):
    """(doc_ids, bytes, bounds) of runs of documents of about so many bytes."""
    ids, parts, lengths, total = [], [], [], 0
    for batch in batches:
        buf, bounds = textcodes.buffer_of(batch.column("text"))
        names = batch.column("doc_id").cast(pa.int64()).to_pylist()
        begin = 0
        while begin < len(names):
            end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + max(0, size - total), "right")) - 1)
            ids += names[begin:end]
            parts.append(buf[bounds[begin] : bounds[end]])
            lengths.append(np.diff(bounds[begin : end + 1]))
            total += int(bounds[end] - bounds[begin])
            begin = end
            if total >= size or begin < len(names):
                yield ids, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
                ids, parts, lengths, total = [], [], [], 0
                pa.default_memory_pool().release_unused()
    if ids:
        yield ids, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, their bytes by significance, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _words(buf: np.ndarray, bounds: np.ndarray, added: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """pretokens() of the texts, but each added token in them, the longest first, is one word."""
    anyone = re.compile(b"|".join(re.escape(token) for token in sorted(added, key=len, reverse=True)))
    if not added or not anyone.search(buf):
        return pretokens.pretokens(buf, bounds)
    spans = np.array([m.span() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) for m in anyone.finditer(buf, a, b)], np.int64).reshape(-1, 2)
    codes, starts = pretokens.pretokens(buf, np.unique(np.concatenate([bounds, spans.ravel()])))
    before = np.searchsorted(spans[:, 0], starts, "right") - 1
    within = (before >= 0) & (starts < spans[before, 1]) if len(spans) else np.zeros(len(starts), bool)
    whole = {token: textcodes.stretch_codes(np.frombuffer(token, np.uint8), np.zeros(1, np.int64))[0] for token in added}
    codes[np.searchsorted(starts, spans[:, 0])] = np.array([whole[buf[a:b].tobytes()] for a, b in spans.tolist()], np.uint64)
    left = ~within | np.isin(starts, spans[:, 0])
    return codes[left], starts[left]


def bucket_count(partitions: int) -> int:
    """Buckets of words for a shuffle of so many partitions: the same number for each of them."""
    return min(MOST_BUCKETS, partitions * -(-LEAST_BUCKETS // partitions))


def _exploder(added: tuple[bytes, ...], buckets: int):
    return lambda batches: _explode(batches, added, buckets)


def _explode(batches, added: tuple[bytes, ...], buckets: int):
    for k, (ids, buf, bounds) in enumerate(chunked(batches, CHUNK)):
        yield _exploded((TaskContext.get().partitionId() << 24) + k, ids, buf, bounds, added, buckets)
        del ids, buf, bounds  # the next chunk is gathered without this one


def _distinct(buf: np.ndarray, bounds: np.ndarray, added: tuple[bytes, ...]) -> tuple[np.ndarray, ...]:
    """Distinct words of some texts: codes, first places, lengths and how often; which of them each word is; words of each text."""
    codes, starts = _words(buf, bounds, added)
    codes, first, number, times = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
    lengths = np.append(starts[1:], len(buf))[first] - starts[first]
    return codes, starts[first], lengths, times, number.astype(np.uint32), np.diff(np.searchsorted(starts, bounds)).astype(np.int32)


def _listed(buf: np.ndarray, bounds: np.ndarray, added: tuple[bytes, ...]) -> tuple[np.ndarray, ...]:
    """Codes, first places and lengths of the distinct words, frequent ones first; places of all words in that list; words of each text.

    Texts are worked through in runs, whose lists of distinct words are merged: only the places
    have a value for each word of the whole.
    """
    runs, at = [], 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUN, "right")) - 1)
        codes, begins, *rest = _distinct(buf[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], added)
        runs.append((codes, begins + bounds[at], *rest))
        at = to
    codes, begins, lengths, times = (np.concatenate(x) for x in list(zip(*runs))[:4])
    codes, first, number = np.unique(codes, return_index=True, return_inverse=True)
    order = np.argsort(-np.bincount(number, times, len(codes)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    ends = np.cumsum([len(run[0]) for run in runs])
    places = np.concatenate([rank[number[end - len(run[0]) : end]][run[4]] for run, end in zip(runs, ends.tolist())])
    return codes[order], begins[first][order], lengths[first][order], places, np.concatenate([run[5] for run in runs])


def _exploded(chunk: int, ids: list, buf: np.ndarray, bounds: np.ndarray, added: tuple[bytes, ...], buckets: int) -> pa.RecordBatch:
    codes, begins, lengths, places, counts = _listed(buf, bounds, added)
    places = pack(places)
    bucket = (codes % np.uint64(buckets)).astype(np.int32)
    listed = np.argsort(bucket, kind="stable")
    begins, lengths = begins[listed], lengths[listed]
    words = textcodes.gathered(buf, begins, lengths)
    cuts = np.append(np.flatnonzero(np.diff(bucket[listed], prepend=-1)), len(listed))
    bytes_at = np.concatenate([[0], np.cumsum(lengths)])[cuts]
    n = len(cuts) - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk] * (n + 1)), pa.array([None, *bucket[listed[cuts[:-1]]].tolist()], pa.int32()), pa.array([ids, *[None] * n], pa.list_(pa.int64())),
            pa.array([counts, *[None] * n], pa.list_(pa.int32())), pa.array([places, *[None] * n], pa.binary()), pa.array([pack(bucket), *[None] * n], pa.binary()),
            pa.array([None, *(pack(lengths[a:b]) for a, b in zip(cuts[:-1], cuts[1:]))], pa.binary()),
            pa.array([None, *(pa.compress(words[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(bytes_at[:-1], bytes_at[1:]))], pa.binary()),
        ],
        ["chunk", "bucket", "doc_ids", "n_words", "places", "buckets", "lengths", "words"],
    )


def by_ranks(table: dict[bytes, int]) -> MakeCoder:
    """Encodes words by the ranks of a table."""

    def make() -> Coder:
        bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        return lambda word: bpe.encode_ordinary(word.decode())

    return make


def _word_encoder(make: MakeCoder):
    def encode(batches):
        coder = make()
        kept: dict[bytes, bytes] = {}
        last = None
        for batch in batches:
            lengths, ids = [], []
            for bucket, sizes, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lengths", "words"))):
                if bucket != last:  # rows come bucket by bucket
                    kept, last = {}, bucket
                ends = np.cumsum(unpack(sizes), dtype=np.int64)
                data = pa.decompress(words, int(ends[-1]), "zstd", asbytes=True)
                own = []
                for a, b in zip([0, *ends.tolist()], ends.tolist()):
                    word = data[a:b]
                    if word not in kept:
                        kept[word] = array("I", coder(word)).tobytes()
                    own.append(kept[word])
                lengths.append(pack(np.array([len(x) // 4 for x in own])))
                ids.append(pack(np.frombuffer(b"".join(own), "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())], ["of", "bucket", "lengths", "ids"])

    return encode


def _binary_parts(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a binary column end to end and bounds."""
    buf, bounds = textcodes.buffer_of(column.cast(pa.large_binary()))
    return np.frombuffer(buf.tobytes(), kind), bounds // np.dtype(kind).itemsize


def _reassembled(chunk: pa.Table, words: pa.Table, packed: bool) -> pa.Table:
    columns = {"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())}
    if chunk.num_rows:
        row = chunk.to_pylist()[0]
        words = words.sort_by("bucket")
        joined = lambda name: np.concatenate([np.zeros(0, np.uint32), *map(unpack, words.column(name).to_pylist())])
        lengths, flat = joined("lengths").astype(np.int64), joined("ids").astype("<u4")
        at = np.empty(len(lengths), np.int64)
        at[np.argsort(unpack(row["buckets"]), kind="stable")] = np.arange(len(lengths))
        at = at[unpack(row["places"])]
        begins, lengths = (np.cumsum(lengths) - lengths)[at], lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(row["n_words"])])]
        ids = textcodes.gathered(flat, begins, lengths)
        columns = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids": pa.array([pack(ids[a:b]) if packed else ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())}
    return pa.table(columns)


def _reassemble(chunk: pa.Table, words: pa.Table) -> pa.Table:
    return _reassembled(chunk, words, False)


def _reassemble_packed(chunk: pa.Table, words: pa.Table) -> pa.Table:
    return _reassembled(chunk, words, True)


def encode(docs: DataFrame, table: dict[bytes, int] | None = None, coder: MakeCoder | None = None, packed: bool = False, added: tuple[bytes, ...] = ()) -> DataFrame:
    """doc_id, n_tokens and ids of every row of docs (doc_id, text).

    coder, made once in each task, may replace the table's merges; packed ids are as by pack();
    coder gets each of the tokens added as a word of its own.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exploder = _exploder(added, bucket_count(partitions))
    chunks = common.save_bucketed(docs.select("doc_id", "text").transform(common.map_batches, exploder, CHUNKS), "chunks", "chunk", compression="zstd")
    words = chunks.where("bucket is not null").select("chunk", "bucket", "lengths", "words")
    words = words.repartitionById(min(partitions, MOST_BUCKETS), "bucket").sortWithinPartitions("bucket")
    known = words.transform(common.map_batches, _word_encoder(coder or by_ranks(table or ranks())), IDS)
    texts = chunks.where("bucket is null").select("chunk", "doc_ids", "n_words", "places", "buckets")
    return texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_reassemble_packed if packed else _reassemble, "doc_id long, n_tokens long, ids binary")


def _decoder(table: dict[bytes, int]):
    def decode(batches):
        size = max(table.values(), default=-1) + 2
        lengths = np.zeros(size, np.int64)
        for token, number in table.items():
            lengths[number] = len(token)
        flat = np.frombuffer(b"".join(sorted(table, key=table.__getitem__)), np.uint8)
        begins = np.cumsum(lengths) - lengths
        for batch in batches:
            ids, bounds = _binary_parts(batch.column("ids"), np.uint32)
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = np.minimum(ids[a:b], size - 1)
                out.append(textcodes.gathered(flat, begins[own], lengths[own]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return decode


def decode(encoded: DataFrame, table: dict[bytes, int] | None = None) -> DataFrame:
    """encoded with `decoded`, the bytes of its ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.transform(common.map_batches, _decoder(table or ranks()), f"{schema}, decoded binary")


def ids_array(ids: str = "ids"):
    """The ids as an array of integers."""
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + 4 - k, 1)), 16, 10)
    number = lambda i: byte(i, 0).cast("int") * 16777216 + byte(i, 1).cast("int") * 65536 + byte(i, 2).cast("int") * 256 + byte(i, 3).cast("int")
    count = (F.octet_length(ids) / 4).cast("int")
    return F.when(count == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), number))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(common.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
