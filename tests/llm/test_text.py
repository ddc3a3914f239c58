import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import byte_bpe, common, decontamination, html_extraction, language_id, pretokens, quality, secret_scan, textcodes, token_files

TEXTS = [(1, "It's  <|endoftext|> don't\n\n stop!! 123 ñandú 中文 x"), (2, None), (3, ""), (None, "null id"), (1, "same id"), (5, "the " * 3000), (6, "  \n "), (5, "the " * 3000)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("'strvelmd  \n\t1²é中😀!-aB\x85 "), max_size=12), max_size=6))
def test_pretokens_are_the_patterns_matches(texts):
    buf, bounds = textcodes.buffer_of(pa.array(texts, pa.string()))
    expected, at = [], 0
    for text in texts:
        expected += [at + len(text[: m.start()].encode()) for m in regex.finditer(public_tokenizers.PATTERN, text)]
        at += len(text.encode())
    assert pretokens.pretokens(buf, bounds)[1].tolist() == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAB \n\té.1"), max_size=20), max_size=6))
def test_word_codes_tell_words_apart(texts):
    codes, at = textcodes.word_codes(*textcodes.buffer_of(pa.array(texts, pa.string())), textcodes.NOT_SPACE)
    words = [w for t in texts for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    assert len(codes) == len(words) == at[-1]
    assert len(set(codes.tolist())) == len(set(words)) and len(set(zip(codes.tolist(), words))) == len(set(words))


def test_very_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(textcodes, "PIECE", 64)
    texts = ["ab " * 200, "x" * 500, "", "one two", "é" * 300 + " z"]
    codes, at = textcodes.word_codes(*textcodes.buffer_of(pa.array(texts)), textcodes.NOT_SPACE)
    assert np.diff(at).tolist() == [200, 1, 0, 2, 2] and len(set(codes.tolist())) == 6


def test_bpe_round_trip(docs):
    table = docs(*TEXTS).withColumns({"ids": F.lit(0), "chunk": F.lit("x")})
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(), special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(table)).withColumn("array", byte_bpe.ids_array()).collect()
    want = sorted(((i, bpe.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS), key=str)
    assert sorted(((r["doc_id"], r["array"], bytes(r["decoded"])) for r in got), key=str) == want
    assert all(r["n_tokens"] == len(r["array"]) for r in got)
    assert byte_bpe.encode(table.limit(0)).count() == 0


def test_buckets_are_the_same_number_for_each_partition():
    for partitions in (1, 8, 51, 64, 200, 4096, 20_000):
        n = byte_bpe.bucket_count(partitions)
        assert byte_bpe.LEAST_BUCKETS <= n <= byte_bpe.MOST_BUCKETS and n % min(partitions, byte_bpe.MOST_BUCKETS) == 0


def test_pack_round_trip():
    for n in (0, 1, 1000):
        x = np.random.default_rng(n).integers(0, 1 << 32, n)
        assert byte_bpe.unpack(byte_bpe.pack(x)).tolist() == x.tolist()


def test_token_files(docs, spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token_files.write(docs(*TEXTS), str(tmp_path / "t"))
    got = token_files.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])])[:-1].tolist()
    import pyarrow.parquet as pq

    file = max((tmp_path / "t").glob("*.parquet"), key=lambda p: p.stat().st_size)
    column = next(c for k in range(pq.ParquetFile(file).metadata.num_columns) if (c := pq.ParquetFile(file).metadata.row_group(0).column(k)).path_in_schema.startswith("ids"))
    assert column.has_dictionary_page or any("DELTA" in e for e in column.encodings)
    token_files.write(docs(*TEXTS).limit(0), str(tmp_path / "e"))
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0
    sums = token_files.read(spark, str(tmp_path / "t")).select("doc_id", "start", "n_tokens", "ids").mapInArrow(token_files._checksums, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    assert sorted(r["ids_crc32"] for r in sums) == sorted(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def contamination_by_hand(rows, items, window=13):
    out = []
    for i, text in rows:
        words, hit, found = words_of(text), set(), set()
        for name, item in items:
            w = words_of(item)
            k = min(window, len(w))
            wins = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k and name is not None else set()
            for a in range(len(words) - k + 1):
                if tuple(words[a : a + k]) in wins:
                    hit |= set(range(a, a + k))
                    found.add(str(name))
        out.append((i, len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def test_contamination_by_brute_force(docs, spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(30)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 13, 20, 40])))) for k in range(12)] + [(3, "again some words of item three"), (50, None), (51, "..."), (None, "w1 w2 w3"), (10, "W1, w2")]
    rows = [(1, None), (2, ""), (None, items[0][1])]
    for k in range(40):
        text = [word() for _ in range(rng.randrange(200))]
        if k % 2:
            text[rng.randrange(len(text) + 1) : 0] = re.split(r"\W+", items[k % 12][1].upper())
        rows.append((k + 10, " ".join(text)))
    rows += [rows[5], rows[5]]
    monkeypatch.setattr(decontamination, "BLOCK", 60)  # several blocks of items
    table, bench = docs(*rows).withColumn("segment", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.build_index(table)
    got = decontamination.contamination(index, decontamination.phrase_matches(index, bench))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()), key=str) == contamination_by_hand(rows, items)
    bad = {i for i, *_, c in contamination_by_hand(rows, items) if c}
    assert sorted((r["doc_id"] for r in decontamination.drop_contaminated(table, bench).collect()), key=str) == sorted((i for i, _ in rows if i not in bad), key=str)
    empty = decontamination.build_index(table.limit(0))
    assert decontamination.contamination(empty, decontamination.phrase_matches(empty, bench.limit(0))).count() == 0
    assert decontamination.contamination(index, decontamination.phrase_matches(index, bench.limit(0))).where("n_hit > 0").isEmpty()


@pytest.mark.parametrize("bound", [1, 3, 1 << 20])
def test_slices_of_occurrences_change_nothing(docs, spark, monkeypatch, bound):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices("abc", k=rng.randrange(0, 80)))) for k in range(30)]
    items = [(k, " ".join(rng.choices("abc", k=rng.randrange(0, 12)))) for k in range(20)] + [(20, "a a a a a")]
    index = decontamination.build_index(docs(*rows).coalesce(1)).toArrow().combine_chunks().to_batches()
    codes = [textcodes.word_codes(*textcodes.buffer_of(pa.array([text])), textcodes.ALPHANUMERIC)[0] for _, text in items]
    monkeypatch.setattr(decontamination, "OPEN", bound)
    found = decontamination._phrase_searcher([str(i) for i, _ in items], codes, 4)(index)
    got = {(r["doc_id"], int(r["item_id"]), w) for batch in found for r in batch.to_pylist() for w in range(r["first"], r["last"] + 1)}
    want = set()
    for doc, text in rows:
        ws = text.split()
        for item, phrase in items:
            ps = phrase.split()
            width = min(4, len(ps))
            windows = {tuple(ps[i : i + width]) for i in range(len(ps) - width + 1)} if ps else set()
            want |= {(doc, item, i + j) for i in range(len(ws)) for j in range(width) if tuple(ws[i : i + width]) in windows}
    assert got == want and want


def test_index_of_a_partition_is_in_small_pieces(spark):
    words = "array_join(transform(sequence(1, {}), x -> hash(id, x) % 50000), ' ')"
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.expr(words.format(10000)).alias("text"))
    long = spark.range(300, 301).select("id", F.expr(words.format(300000)))
    empty = spark.range(301, 300001).select("id", F.lit("").alias("text"))
    index = decontamination.build_index(many.union(long).union(empty).coalesce(1))
    groups = [m.row_group(k) for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:")).metadata] for k in range(m.num_row_groups)]
    assert sum(g.total_byte_size for g in groups) > 12 << 20
    assert max(g.total_byte_size for g in groups) <= decontamination.FORMAT["parquet.block.size"]
    segments = index.select("segment", "doc_ids", "n_words", F.expr("length(terms) + length(ends) + length(positions)").alias("bytes")).collect()
    assert len({r["segment"] for r in segments}) == len(segments)
    assert all(len(r["doc_ids"]) == 1 or sum(r["n_words"]) + len(r["doc_ids"]) <= decontamination.SEGMENT and r["bytes"] <= 3 << 20 for r in segments)
    assert sorted((i, n) for r in segments for i, n in zip(r["doc_ids"], r["n_words"])) == [(i, 10000 if i < 300 else 300000 if i == 300 else 0) for i in range(300001)]


def test_runs_of_a_chunk_make_the_same_list(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "bb", "<|e|>", "ccc", "dd<|e|>d", "é"], k=rng.randrange(0, 9))) for _ in range(60)]
    buf, bounds = textcodes.buffer_of(pa.array([*texts, "", "x " * 500, ""]))
    whole = byte_bpe._listed(buf, bounds, (b"<|e|>",))
    for run in (1, 40):
        monkeypatch.setattr(byte_bpe, "RUN", run)
        assert all(a.tolist() == b.tolist() for a, b in zip(whole, byte_bpe._listed(buf, bounds, (b"<|e|>",)), strict=True))
    begins, lengths, places = whole[1:4]
    words = [buf[a : a + n].tobytes() for a, n in zip(begins, lengths)]
    assert b"".join(words[k] for k in places) == buf.tobytes() and len(set(words)) == len(words)


def test_gathered_in_pieces(monkeypatch):
    monkeypatch.setattr(textcodes, "PIECE", 5)
    rng = np.random.default_rng(1)
    for n in (0, 1, 40):
        flat, lengths = np.arange(100), rng.integers(0, 9, n)
        begins = rng.integers(0, 90, n)
        assert textcodes.gathered(flat, begins, lengths).tolist() == [x for b, k in zip(begins, lengths) for x in range(b, b + k)]


def test_near_matches(docs, spark):
    index = decontamination.build_index(docs((1, "a x b y c"), (2, "c b"), (3, "a b"), (4, "a p q r s t b c")))
    found = decontamination.near_matches(index, spark.createDataFrame([(1, "c a b")], "item_id int, text string"), 5).collect()
    assert [(r["doc_id"], r["first"], r["last"]) for r in found] == [(1, 0, 4)]


LANGS = {"en": "the quick brown fox and the lazy dog were in this house with other things", "de": "der schnelle braune fuchs und der faule hund waren nicht mit anderen im haus", "fr": "le rapide renard brun et le chien paresseux sont dans cette maison avec une autre"}


def test_language_id_on_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(LANGS[lang].split(), k=rng.randrange(5, 40))), lang, "s") for k, lang in enumerate(sorted(LANGS) * 60)]
    rows += [(1000, None, "en", "s"), (1001, "123 !!", "de", "s"), (None, "the house", None, "s"), (1002, "x" * 100_000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").drop("lang_pred")
    model = language_id.train(df.where(~language_id.held_out()))
    got = language_id.predict(df.withColumn("held", language_id.held_out()), model, ["doc_id", "held", "lang"]).collect()
    test = [r for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert {r["held"] for r in got if r["doc_id"] is not None} == {True, False} and all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == r["lang"] for r in test) >= 0.97 * len(test)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    kept = {r["doc_id"] for r in language_id.known_languages(df).collect()}
    assert kept == {r[0] for r in rows} - {1000, 1001}
    assert language_id.predict(df.limit(0), language_id.train(df.limit(0)), ["doc_id"]).count() == 0


def test_bundles_are_sums_of_bound_vectors(monkeypatch):
    monkeypatch.setattr(language_id, "KEPT", 2)
    codes, times = np.unique(language_id.ngrams("abc abd"), return_counts=True)
    encoder = language_id.Encoder(64)
    want = sum(t * encoder.bind(int(c)).astype(float) for c, t in zip(codes, times))
    assert np.array_equal(encoder.bundle(codes, times), want) and np.array_equal(encoder.bundle(codes, times), want)


PAGE = "<html><head><title>T{k}</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>News {k}</a></li></ul></nav><div class='ad'>Buy {k}</div><article><h1>Head {k} &amp; more</h1><p>One   <i>two</i>\n{k}<p>Three&nbsp;&lt;b&gt;{extra}<form>Name<input></form><section class=comments><p>Nice {k}</p></section></article><aside>Side</aside><footer>&copy; {k}</footer>"


def test_html_extraction(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(k=k, extra="<ul><li>item<li>other</ul>" if k % 3 else "")) for k in range(20)]
    rows += [(100, None, None), (101, "http://a.example/z", ""), (102, "http://b.example/", "plain <b>te</b>xt<br>second"), (103, "http://c.example/", "<p>" * 500 + "deep"), (100, None, None)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    for k in range(20):
        assert texts[k] == f"Head {k} & more\nOne two {k}\nThree <b>" + ("\nitem\nother" if k % 3 else "")
    assert texts[100] == texts[101] == "" and texts[102] == "plain text\nsecond" and texts[103] == "deep"
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


ODD = [
    ("<label>Open menu</label><article><p><label>Label text</label> x</p><fieldset><legend>Box</legend><p>y</p></fieldset><form><label>Name</label><fieldset>z</fieldset></form></article>", "Label text x\nBox\ny"),
    ("<div><p>Text</p><label>Search</label></div>", "Text"),
    ("<article><h1>A</h1><p>see</p><ul><li><a href=1>First link</a></li><li><a href=2>Second link</a></li></ul></article>", "A\nsee\nFirst link\nSecond link"),
    ("<article><p class='side-effects'>one</p><div id='search-results'>two</div><section class=related-work>three</section><div class='comment-list'>no</div></article>", "one\ntwo\nthree"),
    ("<body class='has-sidebar'><div id=page class=no-comments><article><header><h1>T</h1></header><p title='it's'>hello</p></article></div><div class='cookie-notice'>no</div></body>", "T\nhello"),
    ("<div class='site-header'>no</div><div class=sidebar>no</div><p>alone</p><div id='ads'>no</div>", "alone"),
    ("<article><p>a &lt; b = c > d</p><a href=x>l</a><p x=\"1>2\" y='>'>tail", "a < b = c > d\nl\ntail"),
]


def test_html_contract_cases(spark):
    rows = [(k, f"http://h{k}.example/", html) for k, (html, _) in enumerate(ODD)]
    # a host without a main element: what all pages share is template, however many pages there are
    plain = "<div>Site name</div><h3>Section {k}</h3><p>text {k}</p>{more}<div>All rights</div>"
    hosts = {2: "two", 4: "four", 9: "nine"}
    for n, host in hosts.items():
        rows += [(100 * n + k, f"http://{host}.example/{k}", plain.format(k=k, more="<blockquote>only here</blockquote>" if k == 1 else "")) for k in range(n)]
    long = "".join(f"<p>b {k}</p><h2>c {k}</h2>" + "<ul><li>x</li></ul>" * (k % 3) for k in range(25_000))
    rows += [(5000, "http://long.example/1", f"<article>{long}</article>"), (5001, "http://long.example/2", f"<article><h1>t</h1>{long[40:]}<p>end</p></article>"), (5002, "http://open.example/", "<article><p>x" + " a=1" * 20_000 + "<a b='" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(df.repartition(3)).collect()}
    for k, (_, want) in enumerate(ODD):
        assert got[k] == want
    for n in hosts:
        for k in range(n):
            assert got[100 * n + k] == f"Section {k}\ntext {k}" + ("\nonly here" if k == 1 else "")
    assert got[5000].count("b ") == got[5000].count("c ") == 25_000
    assert got[5001].startswith("t\n") and got[5001].endswith("end")
    again = {r["page_id"]: r["text"] for r in html_extraction.extract(df.orderBy(F.desc("page_id")).repartition(2)).collect()}
    assert again == got


def test_wrappers_have_optional_and_repeated_items():
    a, b = (html_extraction.page_wrapper(list(html_extraction.slots(h))) for h in ("<h1>A</h1><p>x</p><p>y</p><div>z</div>", "<h1>A</h1><p>x</p>"))
    wrapper = html_extraction.align(a, b)
    assert [(x[0].split("/")[0], x[1], x[2], x[3]) for x in wrapper] == [("h1", "A", False, False), ("p", None, False, True), ("div", "z", True, False)]
    pair = html_extraction.page_wrapper(list(html_extraction.slots("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>")))
    assert len(pair) == 1 and pair[0][3] and len(pair[0][1]) == 2


def _language_of(items):
    """A pattern over the letters of paths that accepts what a wrapper accepts, written apart from it."""
    out = ""
    for key, inner, optional, again in items:
        one = "(?:" + _language_of(inner) + ")" if isinstance(inner, list) else "(?:" + re.escape(f"<{key}>") + ")"
        out += "(?:" + one + ("+" if again else "") + ")" + ("?" if optional else "")
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=9), min_size=1, max_size=5))
def test_wrappers_accept_their_pages_and_place_every_slot(pages):
    pages = [[(path, "") for path in page] for page in pages if page]
    if not pages:
        return
    own = [html_extraction.page_wrapper(page) for page in pages]
    items = own[0]
    for other in own[1:]:
        items = html_extraction.align(items, other)
    wrapper = html_extraction.Wrapper(items)
    for page in pages:
        assert re.fullmatch(_language_of(items), "".join(f"<{path}>" for path, _ in page))
        for (path, _), place in zip(page, wrapper.places(page)):
            assert place == -1 or wrapper.paths[place] == path


def test_places_are_those_of_optional_and_repeated_slots():
    items = [["h", "", False, False], ["(p q)", [["p", "", False, False], ["q", "", False, False]], False, True], ["x", "", True, False], ["p", "", False, False]]
    wrapper = html_extraction.Wrapper(items)
    assert wrapper.paths == ["h", "p", "q", "x", "p"]
    place = lambda text: wrapper.places([(c, "") for c in text])
    assert place("hpqpqxp") == [0, 1, 2, 1, 2, 3, 4]
    assert place("hpqxp") == [0, 1, 2, 3, 4]
    assert place("xz") == [3, -1]


def _plain(spark, pages):
    """Texts of pages given as {host: [html]}, by host."""
    rows = [(1000 * h + k, f"http://{host}.example/{k}", html) for h, (host, htmls) in enumerate(pages.items()) for k, html in enumerate(htmls)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    return {host: [got[1000 * h + k] for k in range(len(htmls))] for h, (host, htmls) in enumerate(pages.items())}


STORIES = ["red apples grow", "blue whales sing", "old towns sleep", "new roads bend", "tall trees sway"]


def test_wrappers_decide_where_no_main_element_does(spark):
    """Blocks whose class names say nothing; what tells them is what other pages have at their place."""
    framed = "<div class=zz>Acme {k} visits</div><ul><li><a href=/>Home {s}</a></li></ul><h2>{s}</h2><p>Always said here</p><ul><li><a href=1>{s} link</a></li></ul><p>{s} more</p>{extra}<div class=yy>Copyright {k}</div>"
    pages = {
        "framed": [framed.format(k=k, s=s, extra="<blockquote>once</blockquote>" if k == 2 else "") for k, s in enumerate(STORIES)],
        "alone": [framed.format(k=7, s="x", extra="")],
        "copies": ["<div>Name</div><p>the same text</p>"] * 3,
        "repeated": [f"<div>Top</div><p>{s} 1</p>" + f"<p>{s} 2</p>" * k + "<div>End</div>" for k, s in enumerate(STORIES)],
    }
    got = _plain(spark, pages)
    for k, s in enumerate(STORIES):
        assert got["framed"][k].split("\n") == [s, "Always said here", f"{s} link", f"{s} more"] + ["once"] * (k == 2)
        assert got["repeated"][k].split("\n") == [f"{s} 1"] + [f"{s} 2"] * k
    assert got["alone"] == ["Acme 7 visits\nx\nAlways said here\nx more\nCopyright 7"]  # nothing to compare with: link lists go
    assert got["copies"] == ["Name\nthe same text"] * 3


def test_paths_alone_would_not_do(spark, monkeypatch):
    """The same host read by the bare set of its paths keeps what its wrapper drops."""
    pages = {"one": [f"<div>Shop {k}</div><p>{s}</p><div>Shop {k}</div>" for k, s in enumerate(STORIES)]}
    assert _plain(spark, pages)["one"] == STORIES
    bare = html_extraction.content(html_extraction.Wrapper(html_extraction.page_wrapper(list(html_extraction.slots(pages["one"][0])))).paths, {})
    assert bare == [True] * 3


def test_texts_at_places_by_hand(spark):
    """kinds of a host against a plain count over its pages, whose places are their positions."""
    rows = [(f"http://k.example/{k}", f"<h1>{s}</h1><h2>No {k}</h2><h3>Same</h3>" + "<h4>rare</h4>" * (k == 3)) for k, s in enumerate(STORIES)]
    rows += [(None, None), ("http://m.example/", "<article>x</article>")]
    got = {r["host"]: dict(r["kinds"] or {}) for r in html_extraction.wrappers(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got["k.example"] == {0: "open", 1: "numbered", 2: "fixed", 3: "single"}
    assert got["m.example"] == {} and got[""] == {}


SECRET = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secret_spans_by_brute_force(spark):
    rng = random.Random(2)
    parts = ["password", "PassWord", "token", "api_key", "apikey", "secret", "=", ":", " ", " ", "\"", "'", "abc", "abcdefgh1", "AKIA", "AKIA1234567890AB", "0123456789abcdef" * 2, "é", "\n", "x", "token=secret: abcdefghijkl"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randrange(12))), f"s{k % 5}", "en") for k in range(300)]
    example, live = "token=EXAMPLEEXAMPLE12", "Zx9-kq27_Lm04Ttyu81QpW"
    rows += [(1000 + k, f"copy {example}", f"s{k}", "en") for k in range(5)] + [(2000, f"bare {live} here", "s1", "en"), (2002, f"?sig={live}7 auth.{live}8", "s2", "en"), (2003, f"{'q' * 70}9{'z' * 5}ABCdef0123", "s3", "en"), (2001, None, None, None), (None, "", "s1", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"row": F.lit(1), "kind": F.lit("clash")})
    ids, spans = secret_scan.scan(df, F.concat_ws("/", "source", "lang"), F.col("source"))
    assert ids.count() == len(rows)
    found = {}
    for r in spans.join(ids, "row").collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["kind"], r["end"]))
        assert r["class"] == "example" if r["value"] == "EXAMPLEEXAMPLE12" else True
    for i, text, *_ in rows:
        t = text or ""
        want = [(m.start(), "assign", m.end()) for m in SECRET.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted(x for x in found.get(i, []) if x[1] != "live") == sorted(want)
    assert found[2000] == [(5, "live", 27)]
    assert sorted(found[2002]) == [(5, "live", 28), (34, "live", 57)] and found[2003] == [(0, "live", 86)]
    assert all(x.count() == 0 for x in secret_scan.scan(df.limit(0), F.col("lang"), F.col("source")))


def test_ownership_by_brute_force(spark):
    rng = random.Random(9)
    values = [f"Ab{k:02d}xYz{k * 7919 % 100000:05d}Qw" for k in range(12)] + ["aaaaaaaaaaaa1"]
    rows = [(k, f"token={rng.choice(values)} and token={rng.choice(values)}", f"s{rng.randrange(1 + k % 5)}", rng.choice(["en", "de", None])) for k in range(60)]
    rows += [(100, f"token={values[0]}", None, None), (101, "token=onlyHere123456", "s9", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    _, spans = secret_scan.scan(df, F.concat_ws("/", "source", "lang"), F.col("source"))
    held = {}
    for _, text, source, lang in rows:
        for value in re.findall(r"token=([A-Za-z0-9]+)", text):
            held.setdefault(value, set()).add((source, "/".join(x for x in (source, lang) if x is not None)))
    seen = {r["value"]: (r["owners"], r["repositories"], r["class"]) for r in spans.where("kind = 'assign'").collect()}
    assert set(seen) == set(held)
    for value, pairs in held.items():
        owners = len({o for o, _ in pairs})
        want = "example" if owners >= secret_scan.EXAMPLE_OWNERS else "live" if owners == 1 and len(set(value)) >= secret_scan.RANDOM_CHARS else "unclear"
        assert seen[value] == (owners, len(pairs), want)


def test_language_cosines_by_plain_python(spark):
    import math

    rows = [(1, "aab aab", "x"), (2, "bba bba b", "y"), (3, "aab", "w"), (4, "zzz", None), (5, "", "x"), (6, "aab", None), (7, "bb " * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    encoder = language_id.Encoder(64)

    def vector(text):
        out, padded = [0] * 64, [f" {w} " for w in (text or "").split()]
        stream = " ".join(w.strip() for w in padded)
        stream = f" {stream} " if stream else ""
        for k in range(len(stream) - 2):
            code = 0
            for c in stream[k : k + 3]:
                code = code << 21 | ord(c)
            out = [a + int(b) for a, b in zip(out, encoder.bind(code))]
        return out

    model = {}
    for _, text, lang in rows:
        if lang is not None:
            model[lang] = [a + b for a, b in zip(model.get(lang, [0] * 64), vector(text))]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))
    got = {r["doc_id"]: r for r in language_id.predict(df, language_id.train(df, 64), ["doc_id"], 64).collect()}
    for i, text, _ in rows:
        if text:
            own = vector(text)
            best = max(sorted(model), key=lambda lang: cosine(own, model[lang]))
            ties = {lang for lang in model if abs(cosine(own, model[lang]) - cosine(own, model[best])) < 1e-9}
            assert got[i]["lang_pred"] in ties and abs(got[i]["score"] - max(0, cosine(own, model[best]))) < 1e-6
    assert got[5]["lang_pred"] == "und"


def test_counts_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(6))), k % 3 == 0) for k in range(80)] + [(100, None, True), (101, "a " * 50_000, False)]
    counts = quality.models(spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(5), 1, 1 << 16)
    words = {w: ({i for i, t, y in rows if y and w in (t or "").split()}, {i for i, t, _ in rows if w in (t or "").split()}) for w in "abcdefgh"}
    assert sorted(zip(*counts[:, :-1][:, counts[1, :-1] > 0].tolist())) == sorted((len(a), len(b)) for a, b in words.values())
    assert counts[:, -1].tolist() == [sum(y for *_, y in rows), len(rows)]


def test_resampling_prefers_the_target(spark):
    rng = random.Random(5)
    plain = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(900):
        words = rng.choices(plain, k=40)
        if k % 3 == 0:
            words[5:8] = rng.choices(["vile", "nasty", "foul"], k=3)
        rows.append((k, " ".join(words), k % 3 != 0 and k % 2 == 0))
    rows += [(5000, None, False), (5001, "", True), (None, "w1 w2", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean").withColumns({"key": F.lit(1), "noise": F.lit("clash")})
    got = {r["doc_id"]: r for r in quality.resample(df, n=2, buckets=1 << 12).collect()}
    bad, good = ([r["sampled"] for i, r in got.items() if i is not None and i < 900 and (i % 3 == 0) == b] for b in (True, False))
    assert sum(bad) < 0.25 * len(bad) and sum(good) > 0.9 * len(good) and got[5000]["log_weight"] == 0
    assert sum(r["sampled"] for r in quality.resample(df, k=100, n=1, buckets=1 << 12).collect()) == 100
    assert quality.resample(df.limit(0)).count() == 0 and quality.resample(df.withColumn("target", F.lit(False)), k=5).where("sampled").count() >= 5


@pytest.mark.parametrize("n", [300, 1200])
def test_resampling_finds_rare_marks_at_any_size(spark, n):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices([f"w{j}" for j in range(200)], k=40)) + (" vile" if k % 8 == 0 else ""), k % 8 != 0 and k % 2 == 0) for k in range(n)]
    got = quality.resample(spark.createDataFrame(rows, "doc_id long, text string, target boolean"), n=2, buckets=1 << 14).collect()
    marked, clean = ([r["sampled"] for r in got if (r["doc_id"] % 8 == 0) == b] for b in (True, False))
    assert sum(marked) < 0.3 * len(marked) and sum(clean) > 0.85 * len(clean)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = [" ".join(random.Random(k).choices(LANGS["en"].split(), k=60)) for k in range(12)]
    item = " ".join(f"bench{k}" for k in range(20))
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(base)]
    rows += [(100, base[0].replace(" ", "  "), "en", "s", 1), (101, base[1] + " tail", "en", "s", 1), (102, f"the {item} end of the house", "en", "s", 1), (103, "12345", "en", "s", 1), (104, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = common.table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, str(tmp_path)), name)
        left[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert name == "byte_bpe" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {r[0] for r in rows}
    assert left["language_id"] == everything - {103, 104} and left["exact_dedup"] == left["language_id"] - {100}
    assert left["near_duplicates"] == left["exact_dedup"] - {101} and left["decontamination"] == left["near_duplicates"] - {102} == left["byte_bpe"]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == left["byte_bpe"] and all(got[k]["text"] == base[k] for k in range(12))


def test_digests(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = byte_bpe.op8_byte_bpe(spark, str(tmp_path)).collect()
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in TEXTS)
    rows = token_files.op10_token_files(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) and min(r["start"] for r in rows) == 0


def test_added_tokens_are_the_librarys_by_default(spark, tmp_path):
    mark = "<|endoftext|>"
    texts = [*TEXTS, (10, f"a{mark}b"), (11, mark), (12, f"{mark}{mark} x {mark}"), (13, "<|endof"), (14, "text|>"), (15, f" {mark} it's{mark}'s"), (16, f"é{mark}\n\n中{mark[:-1]}")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(str(i), library.encode(t or "", add_special_tokens=False).ids + [token_files.END]) for i, t in texts]
    got = token_files.op10_token_files(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)


if __name__ == "__main__":
    pytest.main([__file__])
