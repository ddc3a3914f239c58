import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import periodic_runs, sharding, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def table(spark, folder, name, df):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# -- whitening


def plain_whitening(rows, components=4):
    """By the contract's words, over an eigendecomposition of the covariance."""
    good = [(i, [int(np.floor(float(c) * 256)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[Fraction(int(n * c - s), n) for c, s in zip(x, sums)] for x in fit], dtype=float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in good:
        top = [n * c - int(s) for c, s in zip(x, sums)]
        for k, at in enumerate(order, 1):
            out[i, k] = (n, sum(t * t for t in top), abs(float(np.array(top, float) / n @ vectors[:, at] / np.sqrt(values[at]))), values[at] / values.sum())
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6)) * np.array([3, 2, 1, 0.5, 0.2, 0.1])
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) @ mix.T + 1]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(150)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("-inf")] + [0.0] * 5)]
    return rows


def test_whitening_is_that_of_the_covariance(spark, vectors, tmp_path):
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], VECTORS).repartition(7)
    found = whitening.op11_embedding_whitening(spark, table(spark, tmp_path, "embeddings", df)).collect()
    expected = plain_whitening(vectors)
    assert {(r.vec_id, r.component) for r in found} == set(expected)
    for r in found:
        n, deviation, whitened, explained = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(whitened, abs=1e-8) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-10
    signs = {k: {np.sign(r.whitened) for r in found if r.component == k and r.vec_id in (7, 300, 449)} for k in (1, 2, 3, 4)}
    assert all(len(s) == 1 for s in signs.values())


def test_the_tree_of_factors_is_needed(spark, vectors):
    """Many partitions and a small fan give the same as one partition; the factor is that of all rows."""
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], VECTORS)
    many = whitening.whiten(df.repartition(23), fan=2).collect()
    one = {(r.vec_id, r.component): r for r in whitening.whiten(df.coalesce(1)).collect()}
    assert len(many) == len(one) == 450 * 4
    assert all(r.whitened == pytest.approx(one[r.vec_id, r.component].whitened, abs=1e-9) for r in many)


def test_qr_keeps_what_a_covariance_loses(spark):
    """Two directions whose variances differ by 1e18: a covariance has lost the smaller one."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(a * 4096), float(a * 4096 + b / 256)], 0) for i, (a, b) in enumerate(zip(rng.integers(-4000, 4000, 400), rng.integers(-2, 3, 400)))]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.component for r in found} == {1, 2} and max(r.identity_error for r in found) < 1e-4


def test_whitening_of_awkward_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    for rows in ([(1, [0.5, 0.5], 0)], [(1, [], 0)], [(1, None, 0)], [(1, [0.5], 0), (2, [0.5], 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    flat = spark.createDataFrame([(None, [float(i), 2.0 * i, 0.0], "x") for i in range(9)] + [(3, [1.0], "y")], "vec_id long, embedding array<float>, v string")
    found = whitening.whiten(flat).collect()  # vectors of unequal length; three dimensions, two directions
    assert len(found) == 20 and {r.component for r in found} == {1, 2}
    assert sum(r.explained for r in found if r.vec_id == 3) == pytest.approx(1)
    big = whitening.whiten(spark.createDataFrame([(i, [1e16 * i], 0) for i in range(40)], "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.deviation is None for r in big if r.vec_id == 0)


# -- periodic runs


def plain_runs(words, least=24, times=3):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i + q - s
            if size >= max(least, times * q) and not any(words[s : s + size - d] == words[s + d : s + size] for d in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def as_array(docs):
    return np.array([w for d in docs for w in d], np.int64), np.cumsum([len(d) for d in docs])


def repetitive(rng, most=60):
    n, letters = rng.randint(0, most), rng.randint(1, 4)
    words = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 10)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_runs_by_brute_force():
    rng = random.Random(3)
    for least, times in [(24, 3), (6, 3), (4, 2), (8, 2), (1, 3), (10, 4)] * 60:
        docs = [repetitive(rng) for _ in range(rng.randint(1, 4))] + [[0]]
        numbers, ends = as_array(docs)
        found = list(zip(*(x.tolist() for x in periodic_runs.find(numbers, ends, least, times))))
        expected = [(s + int(e) - len(d), size, q) for d, e in zip(docs, ends) for s, size, q in plain_runs(d, least, times)]
        assert found == expected, (docs, least, times)


def test_tree_finds_all_squares():
    """The vocabulary is complete: all runs of two periods, over one to three letters, Fibonacci and equal words."""
    rng, fib = random.Random(4), [[0], [0, 1]]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    for words in [fib[-1], [0] * 300, [0, 1] * 99, *([rng.randrange(k) for _ in range(120)] for k in (1, 2, 2, 3))]:
        start, length, period = periodic_runs.runs_of(np.array([*words, 9]))
        assert sorted(zip(start.tolist(), length.tolist(), period.tolist()), key=lambda r: (r[0], r[2])) == plain_runs(words, 1, 2)


def test_blocks_are_the_lempel_ziv_factors():
    rng = random.Random(5)
    for _ in range(50):
        words = [rng.randrange(2) for _ in range(40)] + [7]
        found = periodic_runs.names(np.array(words))
        order = np.argsort(found[-1])
        starts, at = [], 0
        while at < len(words):
            starts.append(at)
            size = max((k for k in range(1, len(words) - at + 1) if any(words[j : j + k] == words[at : at + k] for j in range(at))), default=1)
            at += size
        assert periodic_runs.blocks(found, order).tolist() == [*starts, len(words)]


def by_contract(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents_by_contract(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["uno", "zwei", "drei x", "ༀ"]) for _ in range(rng.randint(0, 150)))) for i in range(120)]
    rows += [(500, "a\tb\x0bc \n" * 30), (501, None), (502, ""), (503, " \n "), (504, "long " * 20_000), (504, "long " * 20_000), (505, " ".join(map(str, range(50_000))))]
    rows += [(506, " ".join([*map(str, range(700)), *"xyz" * 9, *map(str, range(700)), *"xyz" * 8]))]
    folder = table(spark, tmp_path, "documents", spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = sorted(map(tuple, periodic_runs.op12_periodic_runs(spark, folder).collect()))
    small = [r for r in rows if len(r[1] or "") < 20_000]
    assert [r for r in found if r[0] not in (504, 505)] == sorted(by_contract(*r) for r in small)
    assert [r[1:6] for r in found if r[0] == 504 and zlib.crc32(b"504") % 10] == [(1, 0, 20_000, 1, 20_000_000)] * 2
    assert sum(1 for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0) > 5


def test_collapse_keeps_other_columns(spark):
    rows = [(1, "so " * 40 + "end", "r", 7), (2, "  as it was ", "s", None), (None, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, `collapsed` int")
    assert {tuple(r) for r in periodic_runs.collapse(df).collect()} == {(1, "so end", "r", 7), *rows[1:]}
    assert periodic_runs.runs(df.where("false")).count() == 0


# -- sharding


def check_shards(rows, found, shards, slack):
    """rows: (doc_id, text); found: (doc_id, size, text_crc32, shard, slot)."""
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(r[:3] for r in found) == sorted((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    total = [0] * shards
    for shard in range(shards):
        assert sorted(r[4] for r in found if r[3] == shard) == list(range(sum(r[3] == shard for r in found)))
        total[shard] = sum(r[1] for r in found if r[3] == shard)
    assert max(total) - min(total) <= slack
    return total


def test_shards_are_nearly_equal(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "w" * int(rng.paretovariate(1.2) * 40) + str(i)) for i in range(3000)]
    rows += [(3000 + i, "hot text " * 30) for i in range(1500)] + [(5000 + i, f"copy {i // 3} " * 20) for i in range(600)] + [(9000, None), (9001, "")]
    rows = [(i, t and t[:20_000]) for i, t in rows]
    folder = table(spark, tmp_path, "documents", spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    found = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.op13_sharding(spark, folder).collect()]
    largest = max(len((t or "").encode()) for _, t in rows) + 8
    share = sum(r[1] for r in found) / 24
    check_shards(rows, found, 24, 2 * (largest + share / sharding.WHOLE))
    by_text = {}
    of = {r[0]: r[3] for r in found}
    for i, t in rows:
        by_text.setdefault(t, set()).add(of[i])
    assert all(len(by_text[f"copy {k} " * 20]) == 1 for k in range(200))  # small groups stay together
    assert len(by_text["hot text " * 30]) > 1  # a third of all rows does not


def test_overfull_ranges_split(spark, docs):
    """With one key drawn for each range or less, and most bytes in one text, no range stays overfull."""
    df = docs(*[(i, "same " * 50 if i % 4 else f"other {i}") for i in range(4000)])
    records = sharding.common.save(df.select((F.length("text") + 8).cast("long").alias("size"), sharding._key(F.xxhash64("text")).alias("key")), "records")
    before, sharding.DRAWN = sharding.DRAWN, 1
    try:
        bounds, counts = sharding.splitters(records, 8)
    finally:
        sharding.DRAWN = before
    assert counts[:, 0].sum() == 4000 and len(bounds) == len(counts) - 1
    assert (counts[:, 1] <= 2 * max(1.0, counts[:, 1].sum() / 128)).all()


def test_shards_of_awkward_tables(spark, docs, tmp_path):
    assert sharding.shard(docs()).count() == 0
    rows = [(None, "a"), (1, None), (1, None), (2, "b")]
    few = sharding.placed(docs(*rows), 24, F.struct("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"))).collect()
    found = [(-1 if r["row"]["doc_id"] is None else r["row"]["doc_id"], r["size"], r["row"]["c"], r["shard"], r["slot"]) for r in few]
    check_shards([(-1, "a"), *rows[1:]], found, 24, 18)
    odd = spark.createDataFrame([(i, f"text {i}", "s", i, "k") for i in range(100)], "doc_id long, text string, shard string, `key` int, `a.b` string")
    assert sorted(sharding.shard(odd.drop("a.b"), 3).columns) == sorted(["doc_id", "text", "key", "size", "shard", "slot"])
    back = sharding.write(odd.drop("a.b"), f"{tmp_path}/shards", 3)
    assert back.count() == 100 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}
    long = sharding.shard(docs((1, "x" * 3_000_000), (2, "y"), (3, "z")), 2)
    assert long.count() == 3
