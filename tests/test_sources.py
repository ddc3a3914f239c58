"""Scans of nested documents and workbooks in several tasks."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.sources import nested, xlsx
from tests.fixtures import write_xlsx


def _document(n: int, seed: int = 3) -> dict:
    rng = random.Random(seed)
    odd = ['a,"b",,', "}{][", 'x\\', '\\",{"receipts":[', "", "ไทย,ไทย", ",", None, "line\nfeed,\ttab", '"']
    bills = [{"receipt_id": f"{k},{rng.choice(odd)}", "note": rng.choice(odd), "items": [{"sku": rng.choice(odd), "n": [[1, 2], {"k": rng.choice(odd)}]} for _ in range(rng.randint(0, 4))]} for k in range(n)]
    for k in range(5, n, 17):
        bills[k] = rng.choice([None, 7, "s,[", [1, {"a": ","}]])
    if n > 40:
        bills[40] = {"receipt_id": "long", "note": "x" * 5000, "items": []}
    return {"branch": 'b"r,an}ch', "meta": {"receipts": [{"not": "these"}], "deep": [1, [2]]}, "others": [{"receipt_id": "no"}, [{"a": 1}]], "receipts": bills, "exported_at": "t,[{", "last": [{"x": 1}]}


@pytest.mark.parametrize("split, form", [(211, {"ensure_ascii": False}), (997, {"indent": 2}), (1 << 27, {"separators": (",", ":")})])
def test_elements_across_ranges(spark, tmp_path, form, split):
    documents = {"one.json": _document(60), "two.json": _document(9, 8), "none.json": {"branch": "x"}, "empty.json": {"receipts": [], "branch": None}}
    for name, document in documents.items():
        (tmp_path / name).write_text(json.dumps(document, **form), encoding="utf-8")
    (tmp_path / "nothing.json").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        if split < 1000:
            assert nested._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 40
        found = nested.read_elements(spark, str(tmp_path), "receipts")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_name = F.element_at(F.split("file", "/"), -1)
    got = {(r[0], r["place"]): json.loads(r["text"]) for r in found.elements.select(by_name, "place", "text").collect()}
    want = {(name, k): bill for name, d in documents.items() for k, bill in enumerate(d.get("receipts", [])) if isinstance(bill, (dict, list))}
    assert got == want and found.elements.count() == len(want)
    fields = {r[0]: r["branch"] for r in found.outer.select(by_name, F.get_json_object("text", "$.branch").alias("branch")).collect()}
    assert fields == {"one.json": 'b"r,an}ch', "two.json": 'b"r,an}ch', "none.json": "x", "empty.json": None}


def test_array_opened_again_and_nested_names(spark, tmp_path):
    text = '{"a": {"receipts": [{"no": 1}]}, "b": "receipts", "c": [{"no": 2}], "receipts" : [ {"k": 1} , {"k": [ {"receipts": [{"k": 2}]} ]}, {} ] , "receipts2": [{"no": 3}] }'
    (tmp_path / "d.json").write_text("﻿" + text, encoding="utf-8")
    got = [(r["place"], json.loads(r["text"])) for r in nested.read_elements(spark, str(tmp_path / "d.json"), "receipts").elements.orderBy("place").collect()]
    assert got == list(enumerate(json.loads(text)["receipts"]))


def test_sheet_is_parsed_in_pieces_and_read_by_address(spark, tmp_path):
    rows = [[f"id{k}", date(2026, 1, 1 + k % 31), None if k % 7 == 0 else f"<row r='{k}'> & ไทย {k}", k] for k in range(500)]
    rows[100] = [None] * 4
    write_xlsx(tmp_path / "a.xlsx", ["id", "day", "text", "n"], rows)
    write_xlsx(tmp_path / "b.xlsx", ["n", "day", "id"], [[1, None, "other"]])
    write_xlsx(tmp_path / "c.xlsx", ["n", "day", "id"], [])
    want = {(str(k + 2), i, f"{d} 00:00:00", t, str(n)) for k, (i, d, t, n) in enumerate(rows) if i} | {("2", "other", None, None, "1")}
    for piece in (64, 4096, xlsx.PIECE):
        found = xlsx.read_sheets(spark, tmp_path.as_uri() + "/*.xlsx", ["id", "day", "text", "n", "absent"], piece)
        got = found.select("source_row", "id", "day", "text", "n", "absent").collect()
        assert {tuple(r)[:5] for r in got} == want and len(got) == len(want) and all(r["absent"] is None for r in got)
    cut = [p for p in xlsx.pieces("a", (tmp_path / "a.xlsx").read_bytes(), 4096)]
    assert len(cut) > 3
    spread = xlsx.read_sheets(spark, f"{tmp_path}/a.xlsx", ["id"], 4096).select(F.spark_partition_id().alias("p")).distinct()
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert spread.count() > 1
    spark.conf.set("spark.sql.adaptive.enabled", old)


def test_shared_strings_follow_their_pieces(tmp_path):
    import zipfile

    sheet = "".join(f'<x:row r="{k}" z:d="1"><x:c r="A{k}" s="1" t="s"><x:v>{k % 5}</x:v></x:c><x:c r="C{k}"><x:v>{k}</x:v></x:c></x:row>' for k in range(1, 300))
    ns = 'xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><x:worksheet {ns} xmlns:z="urn:z"><x:dimension ref="A1"/><x:sheetData>{sheet}</x:sheetData><x:rowBreaks/></x:worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<x:sst {ns}>' + "".join(f"<x:si><x:t>s{k}</x:t></x:si>" for k in range(5)) + "</x:sst>")
    found = list(xlsx.pieces("s", (tmp_path / "s.xlsx").read_bytes(), 700))
    assert len(found) > 5 and all(p["header"] == [(0, "s1"), (2, "1")] and p["line"] == 1 for p in found)
    lines = [(n, cells[0], cells[2]) for p in found for n, cells in xlsx._cells(p["root"], p["rows"], dict(p["strings"]), set())]
    assert lines == [(k, f"s{k % 5}", str(k)) for k in range(1, 300)]
