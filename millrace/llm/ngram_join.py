"""Join of documents whose sets of word shingles have a Jaccard similarity of num/den or more.

Parity sketches: each shingle's hash is XORed into the part of a sketch that the hash chooses.
The sketches of two sets then differ in as many places as the symmetric difference has elements,
at most.  A similarity of num/den leaves sets of a and b shingles at most
(a + b) * (den - num) / (den + num) elements apart.  So:

* Sizes are cut into bands.  A band's largest set bounds the difference D of its pairs.  The band
  fixes its scheme: D // 2 + 1 groups of three parts, and some groups more, the slack.  A similar
  pair differs by one element at most in more groups than the slack, and there two of three parts
  agree.  Each group gives three keys, one for each two of its parts; documents at the upper end
  of a band also get keys by the next band's scheme.
* Documents that share a key are candidates.  Sizes and the Hamming distance of parity sketches of
  about a bit for each shingle rule out most pairs that share a key by chance, the shingle sets
  decide on the others.  A sketch twice as long as another is folded, which keeps the bound.
* Keys that say little are left out without losing a pair.  They are keys of two empty parts, and
  hot keys, which more than HOT sets hold.  A set does without them if no more of its groups have
  such a key than the slack is: each of its pairs then meets in another group, whose keys neither
  side leaves out.  A set with more of them keeps them all, so that two such sets meet there.
  A passage that very many unlike documents share thus makes no large buckets; buckets that stay
  large are those of documents that have much in common.
* Schemes are worked through in PASSES passes, and a pass's keys are deleted when it is done, so
  that only a share of all keys is shuffled, and on disk twice, at a time.
* Keys are cut to as many bits as leave one false meeting in some 100,000 keys, whatever their
  number, since all of them are shuffled.
* Links are only needed up to reachability.  A class of equal sets is one node, and only one of
  its documents gets keys.  In each bucket every node is first compared with the bucket's most
  central one, whose buckets are the fullest: in a group of copies that is the text they were
  copied from.  Then nodes that are still apart from others of a bucket of three or more are
  compared with those.  Pairs that are connected already are not compared, so a bucket of copies
  costs about as many comparisons as it has members.

Sets are equal, and shingles shared, if their 64-bit hashes are.

Edge cases: null text and text without words give the empty set, which is linked with nothing;
fewer words than a shingle has are one shingle.  A null doc_id takes part in links, but never
names a component that has another id.  Rows repeated as a whole are in one class; an empty
table gives an empty result.  Columns besides doc_id and text are ignored by near_duplicates()
and returned by keep().
"""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, textcodes
from millrace.llm.components import components

#: A row for each document (own), and one for its keys by the next band's scheme.  lead: the first
#: of its class in its task; only those rows have keys.
SKETCHED = "doc_id long, n int, class long, uid long, own boolean, lead boolean, scheme int, slack int, sketch array<long>, keys array<long>, part int"
#: Ratio of the smallest sizes of neighbouring bands.
BAND = 1.5
#: Bits of a key beyond those that number all keys.
KEY_BITS = 16
PASSES = 4
#: Sets beyond which a key is hot.
HOT = 2
#: Words of the sketches' folded form, the same for all sets, and words at most of the one that
#: larger sets are compared by as well, before their pairs are written.
FOLD, WIDE = 8, 64


def _bands(num: int, den: int, largest: int) -> list[int]:
    """Smallest sizes of the bands, beyond the largest set."""
    bands, at = [1], 1
    while 2 * at * (den - num) < den + num:  # up to here, similar sets of one size are equal
        at += 1
    while bands[-1] <= largest:
        bands.append(at)
        at = max(at + 1, int(at * BAND))
    return bands


def _groups(bands: list[int], band: int, num: int, den: int) -> tuple[int, int]:
    """Groups of a band's scheme, and how many of them are slack; none where similar sets are equal."""
    differ = 2 * (bands[band + 1] - 1) * (den - num) // (den + num)
    slack = 1 + (differ // 2 + 1) // 8
    return (differ // 2 + 1 + slack, slack) if differ else (0, 0)


def _keys(codes: np.ndarray, band: int, groups: int, slack: int) -> tuple[np.ndarray, int]:
    """Keys of one set (sorted) by a band's scheme, and the slack that is left for hot keys."""
    if not groups:
        return codes[:0], 0
    part = (((codes >> np.uint64(32)) * np.uint64(3 * groups)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    parity = np.zeros(3 * groups, np.uint64)
    parity[part[first]] = np.bitwise_xor.reduceat(textcodes.mix(codes), first)
    parity = parity.reshape(groups, 3)
    name = (np.uint64(band) << np.uint64(40)) + np.arange(groups, dtype=np.uint64) * np.uint64(8)
    mixed = textcodes.mix(parity + np.uint64(0x9E3779B97F4A7C15))
    one, two = [0, 0, 1], [1, 2, 2]
    keys = textcodes.mix(textcodes.mix(mixed[:, one] * np.uint64(3) + mixed[:, two]) + name[:, None] + np.arange(3, dtype=np.uint64))
    empty = (parity[:, one] | parity[:, two]) == 0
    weak = int(empty.any(axis=1).sum())
    return (keys[~empty], slack - weak) if weak <= slack else (keys.ravel(), -1)


def _sets(batch: pa.RecordBatch, shingle: int):
    """The sorted shingle codes of each text of a batch, in order."""
    words, at = textcodes.word_codes(*textcodes.buffer_of(batch.column("text")), textcodes.NOT_SPACE)
    for i in range(len(at) - 1):
        yield np.unique(textcodes.shingle_codes(words[at[i] : at[i + 1]], shingle))


def _class(codes: np.ndarray) -> int:
    """One code for the whole set."""
    total = np.bitwise_xor.reduce(textcodes.mix(codes + np.uint64(17)), keepdims=True) + codes.sum(keepdims=True) * np.uint64(3)
    return int(textcodes.mix(total + np.uint64(len(codes))).view(np.int64)[0])


def _sketch(codes: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: a power of two of 64-bit words, a bit for each element at least."""
    words = max(FOLD, 1 << (max(1, -(-len(codes) // 64)) - 1).bit_length())
    place = (codes >> np.uint64(20) & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=64 * words) & 1).astype(np.uint8)).view(np.uint64)


def _listed(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _sketcher(shingle: int, num: int, den: int):
    def sketch(batches):
        bands, none, seen = _bands(num, den, 1 << 31), np.zeros(0, np.uint64), set()
        uid = TaskContext.get().partitionId() << 33
        for batch in chain.from_iterable(map(textcodes.slices, batches)):
            rows, sketches, keys = [], [], []
            for doc, codes in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), _sets(batch, shingle)):
                size, uid = len(codes), uid + 1
                name = _class(codes) if size else 0
                lead = size > 0 and name not in seen
                band = int(np.searchsorted(bands, size, "right")) - 1 if size else 0
                for k in (band, band + 1) if lead and size * den >= bands[band + 1] * num else (band,):
                    own, slack = _keys(codes, k, *_groups(bands, k, num, den)) if lead else (none, 0)
                    if k == band or len(own):
                        rows.append((doc, size, name, uid, k == band, lead, k, slack, k % PASSES))
                        sketches.append(_sketch(codes) if lead and k == band else none)
                        keys.append(own)
                if lead:
                    seen.add(name)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns[:8], _listed(sketches), _listed(keys), columns[8]], ["doc_id", "n", "class", "uid", "own", "lead", "scheme", "slack", "sketch", "keys", "part"])

    return sketch


def _set_maker(shingle: int):
    def make(batches):
        for batch in chain.from_iterable(map(textcodes.slices, batches)):
            sets = list(_sets(batch, shingle))
            classes = pa.array([_class(s) if len(s) else 0 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([classes, _listed(sets)], ["class", "codes"])

    return make


def _folded(words: Column, k: Column) -> Column:
    """The k-th word of a sketch that is folded to so many words."""
    return F.reduce(F.transform(F.sequence(k, F.size("sketch") - 1, words), lambda i: F.get("sketch", i)), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def _near(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and short sketches allow that the rows a and b are similar enough."""
    n, m, x, y = (F.col(c) for c in (f"{a}n", f"{b}n", f"{a}sketch", f"{b}sketch"))
    length = F.least(F.size(x), F.size(y))
    fold = lambda z: F.when(F.size(z) > length, F.zip_with(F.slice(z, 1, length), F.slice(z, length + 1, length), lambda p, q: p.bitwiseXOR(q))).otherwise(z)
    apart = F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (apart * (den + num) <= (n + m) * (den - num))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of classes that are similar enough."""
    side = lambda x: nodes.select(F.col("class").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "sketch")))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_near("a_", "b_", num, den))
    near = common.save(near.select("a", "b", "a_n", "b_n"), "near")
    wanted = near.select(F.col("a").alias("class")).union(near.select("b")).distinct().join(nodes.select("class", "doc_id"), "class")
    ids = common.small(wanted.select(F.col("doc_id").alias("_id")).distinct())
    chosen = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = common.save(chosen.select("text").transform(common.map_batches, _set_maker(shingle), "class long, codes array<long>").join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"]), "sets")
    both = near.join(sets.select(F.col("class").alias("a"), F.col("codes").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("codes").alias("y")), "b")
    common_size = F.size(F.array_intersect("x", "y"))
    same = both.select("a", "b", "a_n", "b_n", common_size.alias("i")).where(F.col("i") * den >= (F.col("a_n") + F.col("b_n") - F.col("i")) * num)
    links = common.save(same.select("a", "b"), "links")
    common.discard(sets)
    return links


def _members(sketched: DataFrame, stale: DataFrame, part: int, cut: int) -> DataFrame:
    """(key, class, scheme, slack, size) for the keys of one pass that several classes hold."""
    leading = sketched.where((F.col("part") == part) & (F.size("keys") > 0)).join(stale, "uid", "left_anti")
    keyed = leading.select("class", "scheme", "slack", F.explode("keys").alias("key")).withColumn("key", F.shiftrightunsigned("key", cut))
    held = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("low"), F.max("class").alias("high"))
    shared = common.save(held.where("low < high").select("key", "size"), "shared")
    members = common.save(keyed.join(common.small(shared), "key").select("key", "class", "scheme", "slack", "size"), "members")
    common.discard(shared)
    return members


def _fewer(members: DataFrame) -> DataFrame:
    """members without the hot keys of the classes that can do without them."""
    hot = F.col("size") > HOT
    free = members.where(hot).groupBy("class", "scheme").agg(F.count(F.lit(1)).alias("hot"), F.first("slack").alias("slack")).where("hot <= slack")
    free = common.save(free.select("class", "scheme", F.lit(True).alias("free")), "free")
    return members.join(common.small(free), ["class", "scheme"], "left").where(~hot | F.col("free").isNull()).select("key", "class", "size")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """For every row of docs: doc_id, n_shingles, class, component_id (smallest reachable doc_id)."""
    docs = docs.select("doc_id", "text")
    sketched = common.save(docs.transform(common.map_batches, _sketcher(shingle, num, den), SKETCHED), "sketches", partition_by="part")
    sized = common.save(sketched.where("own").select("doc_id", "n", "class"), "sized")
    leading = sketched.where("own and lead").select("class", "uid", "n", "sketch")
    names = sized.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    least = leading.groupBy("class").agg(F.min("uid").alias("uid"))
    stale = common.save(leading.select("uid").join(least, "uid", "left_anti"), "stale")
    nodes = common.save(leading.join(common.small(stale), "uid", "left_anti").join(names, "class").select("class", "doc_id", "n", "sketch", *(_folded(F.lit(FOLD), F.lit(k)).alias(f"f{k}") for k in range(FOLD))), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 1
    cut = max(0, 64 - KEY_BITS - int(total).bit_length())
    passes = []
    for part in range(PASSES):
        passes.append(_members(sketched, common.small(stale), part, cut))
        common.discard(sketched, f"/part={part}")
    members = common.save(_fewer(reduce(DataFrame.unionByName, passes)), "members")
    for part in passes:
        common.discard(part)
    central = members.groupBy("class").agg(F.sum("size").alias("weight"))
    pivots = members.join(central, "class").groupBy("key").agg(F.max(F.struct("weight", "class")).alias("m"))
    members = common.save(members.join(pivots.select("key", F.col("m.class").alias("pivot")), "key").select("key", "class", "pivot"), "placed")

    stars = common.save(members.where("class <> pivot").groupBy("class", "pivot").agg(F.count(F.lit(1)).alias("times")), "stars")
    best = stars.groupBy("class").agg(F.max(F.struct("times", "pivot")).alias("m")).select(F.col("class").alias("b"), F.col("m.pivot").alias("a"))
    links = _verified(best, docs, nodes, shingle, num, den)
    roots = common.save(components(links), "roots")

    root = lambda x, name: F.coalesce(F.col(name), F.col(x))
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    rest = stars.select(F.col("class").alias("b"), F.col("pivot").alias("a")).join(best, ["a", "b"], "left_anti")
    rest = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").where(root("a", "a_root") != root("b", "b_root")).select("a", "b")
    more = _verified(rest, docs, nodes, shingle, num, den)
    links = links.unionByName(more)
    roots = common.save(components(links), "roots")

    rooted = members.join(roots.withColumnRenamed("node", "class"), "class", "left").select("key", "class", "pivot", root("class", "root").alias("root"))
    per_root = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = per_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("roots"))
    main = main.where("roots > 1 and all > 2").select("key", F.col("m.root").alias("main"))
    words = F.least(F.lit(WIDE), F.size("sketch"))
    wide = nodes.select("class", "n", *(f"f{k}" for k in range(FOLD)), F.when(F.col("n") > 64 * FOLD, F.transform(F.sequence(F.lit(0), words - 1), lambda k: _folded(words, k))).alias("sketch"))
    open_ = common.save(rooted.join(main, "key").join(wide, "class"), "open")
    a, b = open_.where("root <> main").alias("a"), open_.alias("b")
    unlike = (F.col("a.root") != F.col("b.root")) & (F.col("a.class") != F.col("a.pivot")) & (F.col("b.class") != F.col("a.pivot"))
    apart = reduce(add, (F.bit_count(F.col(f"a.f{k}").bitwiseXOR(F.col(f"b.f{k}"))) for k in range(FOLD)))
    n, m = F.col("a.n"), F.col("b.n")
    alike = (F.least(n, m) * den >= F.greatest(n, m) * num) & (apart * (den + num) <= (n + m) * (den - num))
    across = a.join(b, (F.col("a.key") == F.col("b.key")) & unlike & alike & ((F.least(n, m) <= 64 * FOLD) | _near("a.", "b.", num, den)))
    across = across.select(F.least("a.class", "b.class").alias("a"), F.greatest("a.class", "b.class").alias("b")).distinct()
    links = links.unionByName(_verified(across, docs, nodes, shingle, num, den))
    roots = components(links).select(F.col("node").alias("class"), "root")

    placed = nodes.select("class", "doc_id").join(roots, "class", "left").select("class", "doc_id", root("class", "root").alias("root"))
    names = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(names, "root").select("class", "component_id")
    out = sized.join(named, "class", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest doc_id."""
    found = near_duplicates(docs, shingle, num, den)
    stay = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return common.by_id(docs, stay, "left_semi")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=3, num=90, den=100).drop("class")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, hash(x) AS h, x FROM (SELECT doc_id, unnest(sh) AS x FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.h = b.h AND a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON n.doc_id = r.a GROUP BY 1, 2
"""
