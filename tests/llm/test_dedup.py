import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import components, exact_dedup, line_dedup, ngram_join

AWKWARD = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (None, "a b"), (1, "a  b"), (5, "x" * 200_000), (6, "x" * 200_000), (7, " a b")]


def by_hand(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        keep = None if None in ids else min(ids)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups_by_hand(docs):
    got = exact_dedup.groups(docs(*AWKWARD)).drop("bucket").collect()
    assert sorted(map(tuple, got), key=str) == by_hand(AWKWARD)


def test_exact_keep_leaves_one_row_of_each_text(docs, spark):
    table = docs(*AWKWARD).withColumns({"keep_id": F.lit(9), "h": F.lit("clash"), "norm": F.lit(0)})
    kept = exact_dedup.keep(table)
    assert kept.columns == table.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in AWKWARD})
    assert exact_dedup.keep(table.limit(0)).count() == 0 and exact_dedup.groups(table.limit(0)).count() == 0


def test_directory_splits_overfull_buckets(spark):
    # half of the hashes share their first 6 bits, so that their buckets are deeper
    entries = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.xxhash64("id")).otherwise(F.shiftrightunsigned(F.xxhash64("id"), 6)).alias("h"))
    buckets = exact_dedup.directory(entries, 50)
    placed = exact_dedup.in_buckets(entries, buckets)
    assert placed.count() == 3000 and placed.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 50
    assert buckets.select("depth").distinct().count() >= 3 and buckets.count() == buckets.select("bucket").distinct().count()


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.shiftleft(F.xxhash64(c), 58), lambda c: F.xxhash64(F.substring(c, 1, 1))], ids=["full", "few bits", "first letter"])
def test_exact_groups_through_split_buckets_and_collisions(docs, hashed):
    rng = random.Random(7)
    rows = AWKWARD + [(10 + k, " ".join(rng.choices(["a", "b", "c", "dd"], k=rng.randrange(1, 5)))) for k in range(200)]
    got = exact_dedup.groups(docs(*rows), 8, hashed)
    assert sorted(map(tuple, got.drop("bucket").collect()), key=str) == by_hand(rows)
    buckets = got.select("bucket").distinct().count()
    assert got.where("bucket is null").isEmpty() and (hashed is not F.xxhash64 or buckets > 8)


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 130)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def expected_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * den >= len(sets[i] | sets[j]) * num and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return sorted(out, key=str)


def family(rng, base, size, first, edits):
    out = []
    for k in range(size):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append((first + k, " ".join(words)))
    return out


@pytest.mark.parametrize("n, num, den, seed", [(3, 90, 100, 1), (5, 80, 100, 2)])
def test_near_duplicates_by_brute_force(docs, n, num, den, seed):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one  two"), (None, "lone words here now"), (7, " \n\t ")]
    for k, length in enumerate((8, 12, 14, 20, 40, 90, 300)):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        rows += family(rng, base, 14, 100 + 20 * k, max(1, length // 12))
    # a passage that unlike texts share makes hot keys, and a very long text
    passage = [f"p{k}" for k in range(60)]
    rows += [(500 + k, " ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 200))] + passage)) for k in range(25)]
    rows += [(600, " ".join(f"v{k}" for k in range(30_000))), (601, " ".join(f"v{k + 40}" for k in range(30_000)))]
    rows += [rows[20], rows[-1], (9, rows[-1][1])]
    got = ngram_join.near_duplicates(docs(*rows), n, num, den).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == expected_components(rows, n, num, den)


def test_near_duplicates_on_empty_table_and_keep(docs):
    table = docs((1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "q r s t u"))
    assert ngram_join.near_duplicates(table.limit(0)).count() == 0
    clash = table.withColumns({"class": F.lit("x"), "n": F.lit(1), "_id": F.lit(2)})
    assert sorted(r["doc_id"] for r in ngram_join.keep(clash).collect()) == [1, 3, 4]


def test_line_dedup(docs):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\n b\nc\ny"), (3, None), (4, ""), (5, "a\nb"), (6, f"p\n{long}\nq"), (7, f"r\n{long}\ns"), (8, "z\nz\nz\nz\nz"), (8, "z\nz\nz\nz\nz"), (None, "u\nv\nw"), (9, "u\nv\nw")]
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in line_dedup.dedup_lines(docs(*rows).withColumn("removed", F.lit(0))).collect()}
    assert got[1] == ("a\nb\nc\nd", []) and got[2] == ("x\ny", [1, 2, 3]) and got[3] == (None, []) and got[4] == ("", []) and got[5] == ("a\nb", [])
    assert got[6][0] == f"p\n{long}\nq" and got[7] == ("r\ns", [1]) and got[8] == ("z", [1, 2, 3, 4]) and got[None][1] == [] and got[9] == ("", [0, 1, 2])
    assert line_dedup.dedup_lines(docs((1, "a")).limit(0)).count() == 0


def lines_by_hand(rows):
    trim = lambda x: x.strip(" \t\n\v\f\r")
    seen, out = {}, []
    for i, text in sorted(rows):
        lines = [trim(x) for x in text.split("\n")]
        words = [len(re.findall(r"[^ \t-\r]+", x)) for x in lines]
        gone = set()
        for at in range(len(lines)):
            for size in (1, 2, 3):
                if at + size <= len(lines) and (size == 3 or sum(words[at : at + size]) > 50):
                    if seen.setdefault(tuple(lines[at : at + size]), (i, at)) < (i, at):
                        gone |= set(range(at, at + size))
        out.append((i, sorted(gone)))
    return out


def test_lines_by_brute_force(docs):
    rng = random.Random(11)
    pool = [" ".join(rng.choices(["a", "bb", "word", "longerword" * 3], k=k)) for k in (0, 1, 3, 8, 20, 26, 30, 49, 51, 60, 120)]
    rows = [(k, "\n".join(rng.choice([" ", ""]) + rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    rows.append((100, "\n".join(f"line {k % 700}" for k in range(5000))))
    got = sorted((r["doc_id"], r["removed"]) for r in line_dedup.dedup_lines(docs(*rows)).collect())
    assert got == lines_by_hand(rows)


def test_short_lines_count_in_windows_of_two_lines(docs):
    long, short = " ".join(f"word{k}" for k in range(47)), "a short heading line"
    rows = [(1, f"first\n{short}\n{long}\nend"), (2, f"{short}\n{long}"), (3, f"{long}\n{short}\nother"), (4, f"three words only\n{long}"), (5, f"\n{long}"), (6, f"three words only\n{long}\n")]
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in line_dedup.dedup_lines(docs(*rows)).collect()}
    # 51 words in the same order are a window, 50 or fewer are not
    assert got == {i: ("", [0, 1]) if i == 2 else (text, []) for i, text in rows}
