"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

A scan finds candidate spans of four kinds in each text: assignments of a password, token and the
like; access keys; long hexadecimal runs; and bare tokens that mix letters and digits.  All over
the corpus, the hash of each candidate's value is counted by the distinct repositories and owners
that hold it.  A value that several owners hold is a widely copied example.  A value of one owner
that looks random is taken for a live credential of that owner; what lies between is `unclear`.

The first three kinds are always reported, with their class.  Bare tokens are reported only where
ownership makes them `live`.  Distinct (value, owner, repository) rows are counted, so copies
combine before they are sent, and only hashes and spans are shuffled, never texts.

Spans are in code points, from 0, end exclusive.  Each kind is matched from left to right without
overlaps; matches that are too short are dropped after that.

Edge cases: null text counts as empty and has no spans; a null owner or repository counts as one
more owner or repository; null or repeated doc_ids get a row for each row of the table.  An empty
table gives an empty result.  Clashing column names do no harm: only doc_id, text and the two
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common

#: Kind: pattern, group of the value, least length of that group.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "bare": (r"(?<![A-Za-z0-9+_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
#: Owners from which on a value is an example.
EXAMPLE_OWNERS = 3
#: Distinct characters that a value that looks random has, at least.
RANDOM_CHARS = 9


def candidates(docs: DataFrame, repository: Column, owner: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (row, doc_id), and the candidates (row, kind, start, end, value, repository, owner)."""
    text = common.text_or_empty()
    columns = [F.monotonically_increasing_id().alias("row"), "doc_id", repository.cast("string").alias("repository"), owner.cast("string").alias("owner")]
    for kind, (pattern, group, _) in KINDS.items():
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        zipped = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("whole"), values.alias("value")), lambda x: F.struct(x["gap"].alias("gap"), F.length(x["whole"]).alias("len"), x["value"].alias("value")))
        columns.append(F.when(text.rlike(pattern), zipped).alias(kind))
    scanned = common.save(docs.select(*columns), "scanned")
    parts = [scanned.where(F.col(kind).isNotNull()).select("row", "repository", "owner", F.lit(kind).alias("kind"), F.posexplode(kind).alias("k", "m")) for kind in KINDS]
    spread = parts[0]
    for part in parts[1:]:
        spread = spread.unionByName(part)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(Window.partitionBy("row", "kind").orderBy("k"))
    least = F.create_map(*(F.lit(x) for kind, (_, _, n) in KINDS.items() for x in (kind, n)))
    spans = spread.select("row", "repository", "owner", "kind", (end - F.col("m.len")).alias("start"), end.alias("end"), F.col("m.value").alias("value"))
    return scanned.select("row", "doc_id"), spans.where(F.length("value") >= least[F.col("kind")])


def ownership(spans: DataFrame) -> DataFrame:
    """For each value's hash: the numbers of distinct repositories and owners, and its class."""
    none = lambda c: F.coalesce(F.col(c), F.lit("\0"))
    looks = F.size(F.array_distinct(F.split("value", ""))) >= RANDOM_CHARS
    held = spans.select(F.xxhash64("value").alias("hash"), none("repository").alias("repository"), none("owner").alias("owner"), looks.alias("looks")).distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.max("looks").alias("looks"))
    counts = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.max("looks").alias("looks"))
    kind = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when((F.col("owners") == 1) & F.col("looks"), "live").otherwise("unclear")
    return counts.select("hash", "owners", "repositories", kind.alias("class"))


def scan(docs: DataFrame, repository: Column, owner: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (row, doc_id), and their reported spans with owners, repositories and class."""
    rows, spans = candidates(docs, repository, owner)
    spans = common.save(spans.withColumn("hash", F.xxhash64("value")), "spans")
    owners = common.save(ownership(spans), "ownership")  # written before it is joined, so that Spark can split a hot value
    judged = spans.join(owners, "hash")
    base = judged.where(F.col("kind").isin(*BASE))
    live = judged.where("kind = 'bare' and class = 'live'").withColumn("kind", F.lit("live"))
    taken = base.select(F.col("row").alias("_row"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    free = live.join(taken, (F.col("row") == F.col("_row")) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")), "left_anti")
    return rows, base.unionByName(free).drop("hash")


def _listed(where: Column) -> Column:
    """kind:start:end of an array of spans, in order."""
    return F.array_join(F.transform(F.filter("spans", lambda x: where(x) if callable(where) else F.lit(True)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows, spans = scan(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    order = F.create_map(*(F.lit(x) for k, kind in enumerate((*BASE, "live")) for x in (kind, k)))
    entry = F.struct("start", order[F.col("kind")].alias("order"), "kind", "end", "class")
    grouped = spans.groupBy("row").agg(F.array_sort(F.collect_list(entry)).alias("spans"))
    out = rows.join(grouped, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(grouped.schema["spans"].dataType)))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda kind: lambda x: x["kind"] == kind
    return out.select(
        "doc_id",
        *(count(of_kind(kind)).alias(f"n_{kind}") for kind in BASE),
        F.sha2(_listed(lambda x: x["order"] < len(BASE)).cast("binary"), 256).alias("base_sha256"),
        _listed(None).alias("spans"),
        count(lambda x: x["class"] == "live").alias("n_live"),
        count(lambda x: x["class"] == "example").alias("n_example"),
    )
