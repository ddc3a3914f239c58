"""Scan of XLSX workbooks: the first sheet, its first row being the header, cells as text.

A workbook is a zip of XML files, which the standard library reads.  Spark brings its bytes from any
file system it knows.  A compressed sheet can be read from its start only, so one task unpacks it and
cuts it between rows, by a search for their tags; each piece takes the header and its own shared
strings along, and the pieces are dealt out to be parsed.  Dates become ISO text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
#: Number formats of dates that every workbook knows.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iterfind(".//m:t", _NS)) for item in root.iterfind("m:si", _NS)]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iterfind(".//m:numFmt", _NS) if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    return {k for k, xf in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)) if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iterfind(".//m:t", _NS))
    found = cell.find("m:v", _NS)
    if found is None or found.text is None:
        return None
    if kind == "s":
        return shared[int(found.text)]
    if kind in ("str", "b", "e", "d"):
        return found.text
    if int(cell.get("s", -1)) in dates:
        moment = datetime(1899, 12, 30) + timedelta(seconds=round(float(found.text) * 86400))
        return moment.isoformat(sep=" ")
    return found.text[:-2] if found.text.endswith(".0") else found.text


#: Bytes of a sheet that are parsed by one task.
PIECE = 1 << 20
_ROW = re.compile(rb"<(?:\w+:)?row[\s/>]")
_STRING_CELL = re.compile(r"""<(?:\w+:)?c\b[^>]*\bt\s*=\s*["']s["'][^>]*>\s*<(?:\w+:)?v[^>]*>\s*(\d+)""")


def _row_texts(sheet, piece: int) -> Iterator[tuple[str, str]]:
    """The sheet's start tag, and its rows, in pieces of at least that many bytes of whole rows."""
    text, root = b"", None
    while more := sheet.read(piece):
        text += more
        if root is None:
            if (found := re.search(rb"<((?:\w+:)?worksheet)\b[^>]*>", text)) is None:
                continue
            root, end = found[0].decode(), re.compile(rb"</(?:\w+:)?sheetData\s*>")
            if first := _ROW.search(text):
                text = text[first.start() :]
            else:
                root = None
                continue
        if done := end.search(text):
            text = text[: done.start()]
            break
        cuts = [m.start() for m in _ROW.finditer(text)]
        if len(cuts) > 1:
            yield root, text[: cuts[-1]].decode()
            text = text[cuts[-1] :]
    if root is not None:
        yield root, text.decode()


def _cells(root: str, text: str, strings: dict[int, str], dates: set[int]) -> Iterator[tuple[int, dict[int, str | None]]]:
    prefix = root[1 : root.index("worksheet")]
    for row in ElementTree.fromstring(f"{root}{text}</{prefix}worksheet>").iterfind("m:row", _NS):
        yield int(row.get("r")), {_column(c.get("r")): _value(c, strings, dates) for c in row.iterfind("m:c", _NS)}


_PIECES = "file string, part int, root string, rows string, header map<int,string>, line int, strings map<int,string>, dates array<int>"
_PIECES_ARROW = pa.schema([("file", pa.string()), ("part", pa.int32()), ("root", pa.string()), ("rows", pa.string()), ("header", pa.map_(pa.int32(), pa.string())), ("line", pa.int32()), ("strings", pa.map_(pa.int32(), pa.string())), ("dates", pa.list_(pa.int32()))])


def pieces(file: str, data: bytes, piece: int) -> Iterator[dict]:
    """Pieces of the first sheet, each with all that is needed to parse it."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared, dates = _shared(book), _date_styles(book)
        sheet = min((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        header, line = {}, 0
        with book.open(sheet) as f:
            for part, (root, text) in enumerate(_row_texts(f, piece)):
                strings = {k: shared[k] for k in {int(m[1]) for m in _STRING_CELL.finditer(text)}}
                if not header:
                    named = ((n, {k: v for k, v in cells.items() if v is not None}) for n, cells in _cells(root, text, strings, dates))
                    line, header = next((x for x in named if x[1]), (0, {}))
                yield {"file": file, "part": part, "root": root, "rows": text, "header": list(header.items()), "line": line, "strings": list(strings.items()), "dates": sorted(dates)}


def _unpacker(piece: int):
    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                for found in pieces(file, data.as_py(), piece):
                    yield pa.RecordBatch.from_pylist([found], _PIECES_ARROW)

    return run


def _parser(columns: list[str]):
    names = [*columns, "source_row"]

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                places = {name: k for k, name in x["header"]}
                found = _cells(x["root"], x["rows"], dict(x["strings"]), set(x["dates"]))
                kept = [(line, cells) for line, cells in found if places and line > x["line"] and any(v is not None for v in cells.values())]
                values = [*([cells.get(places.get(c)) for _, cells in kept] for c in columns), [str(line) for line, _ in kept]]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in values], names)

    return run


def read_sheets(spark: SparkSession, path: str, columns: list[str], piece: int = PIECE) -> DataFrame:
    """columns by their header, and source_row, the line in its sheet, of the first sheet of each workbook at path."""
    books = spark.read.format("binaryFile").load(path).select("path", "content")
    dealt = books.mapInArrow(_unpacker(piece), _PIECES).repartition("file", "part")
    return dealt.mapInArrow(_parser(columns), ", ".join(f"`{c}` string" for c in (*columns, "source_row")))
