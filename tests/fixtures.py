"""A small seeded shop: raw files of three branches with a log of the faults put into them."""

from __future__ import annotations

import csv
import json
import zipfile
from datetime import date, datetime, timedelta
from pathlib import Path
from xml.sax.saxutils import escape

import numpy as np

from millrace.plans import schemas

# Invented products in the form of a price list.
PRODUCTS = [
    ("P01", "เมนูแดง", "Red Cup", "coffee", "N-1", "sku:red", 31, 42, 53, None),
    ("P02", "เมนูน้ำเงิน", "Blue Cup", "coffee", "N-2", "sku:blue", 33, 44, 57, None),
    ("P03", "เมนูเขียว", "Green Cup", "coffee", "N-3", "sku:green", 36, 47, 58, None),
    ("P07", "เมนูเหลือง", "Yellow Cup", "non_coffee", "N-4", "sku:yellow", 29, 41, 56, None),
    ("P12", "ขนมกลม", "Round Bun", "bakery", "N-5", "sku:round", None, None, None, 38),
    ("P13", "ขนมยาว", "Long Bun", "bakery", "N-6", "sku:long", None, None, None, 37),
]
SIZE_WORDS = {branch: {size: word for word, size in words.items()} for branch, words in schemas.SIZES.items()}
PAY_WORDS = {branch: list(words) for branch, words in schemas.PAYMENTS.items()}


def _write_csv(path: Path, header, rows) -> None:
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


def _letter(k: int) -> str:
    return chr(65 + k)


def write_xlsx(path: Path, header, rows) -> None:
    """One sheet; the second column is a date cell, numbers are numbers, the rest inline text."""

    def cell(ref, value, dated=False):
        if value is None:
            return ""
        if dated:
            return f'<c r="{ref}" s="1"><v>{(value - date(1899, 12, 30)).days}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    body = ["".join(cell(f"{_letter(k)}1", h) for k, h in enumerate(header))] + ["".join(cell(f"{_letter(k)}{i}", v, k == 1) for k, v in enumerate(r)) for i, r in enumerate(rows, 2)]
    sheet = "".join(f'<row r="{i}">{b}</row>' for i, b in enumerate(body, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')


def write_shop(folder: Path, seed: int = 7, days: int = 181, bills: int = 12) -> dict:
    """Write all raw files; returns what was put in, by issue."""
    rng = np.random.default_rng(seed)
    log: dict[str, list] = {k: [] for k in ("duplicate_rows", "duplicate_bills", "unknown_product", "non_positive", "typo", "large_order", "synonym", "member_fixed", "member_unknown", "member_merged", "price", "duplicate_member", "missing_day")}
    _write_csv(folder / "products.csv", "product_id name_th name_en category nimman_code thaphae_sku price_S price_M price_L price_nosize".split(), PRODUCTS)
    _write_csv(folder / "holidays.csv", ["date", "name_th", "name_en"], [("2026-01-01", "วันขึ้นปีใหม่", "New Year"), ("2026-04-13", "วันสงกรานต์", "Songkran")])
    members = [[f"M{k:04d}", f"Person {k}", [None, "M", "F"][int(rng.integers(0, 3))], int(rng.integers(1960, 2008)), f"08{k:08d}", "2025-01-01", ["nimman", "cmu", "thaphae"][k % 3]] for k in range(1, 61)]
    originals = [list(m) for m in members]
    members[3][3] = None
    members[4][3] += 543
    members[5][4] = "+66 8" + members[5][4][2:]
    twin = ["M0061", "Person  7", members[6][2], members[6][3], members[6][4], "2025-06-01", members[6][6]]
    members.append(twin)
    log["duplicate_member"].append("M0061")
    _write_csv(folder / "members.csv", "member_id full_name gender birth_year phone register_date home_branch".split(), members)

    lines: dict[str, list] = {"nimman": [], "cmu": [], "thaphae": []}
    for branch in lines:
        number = 0
        for d in range(days):
            day = date(2026, 1, 1) + timedelta(days=d)
            if branch == "thaphae" and d in (131, 132):
                log["missing_day"].append(day.isoformat())
                continue
            weekend = day.weekday() >= 5
            for _ in range(bills + 2 * weekend + int(rng.integers(0, 3))):
                number += 1
                at = datetime(day.year, day.month, day.day, int(rng.integers(7, 20)), int(rng.integers(0, 60)))
                member = f"M{int(rng.integers(1, 61)):04d}" if rng.random() < 0.5 else None
                chosen = rng.choice(len(PRODUCTS), size=int(rng.integers(1, 3)), replace=False)
                if 1 in chosen and rng.random() < 0.6:
                    chosen = np.unique(np.append(chosen, 4))
                pay = int(rng.integers(0, 3))
                for p in chosen:
                    product = PRODUCTS[p]
                    size = None if product[3] == "bakery" else "SML"[int(rng.integers(0, 3))]
                    price = product[9] if size is None else product[6 + "SML".index(size)]
                    lines[branch].append({"n": number, "at": at, "p": product, "size": size, "qty": int(rng.integers(1, 4)), "price": price, "member": member, "pay": pay})

    rows = []
    for k, x in enumerate(lines["nimman"]):
        x["id"] = f"NM-{x['n']:06d}"
        code, price, qty, member = x["p"][4], x["price"], x["qty"], x["member"]
        if k == 10:
            code = "X99"
            log["unknown_product"].append(x["id"])
        if k == 20:
            qty = 0
            log["non_positive"].append(x["id"])
        if k == 30:
            qty = 300
            log["typo"].append(x["id"])
        if k == 40:
            qty = 40
            log["large_order"].append(x["id"])
        if k == 50:
            price *= 100
            log["price"].append(x["id"])
        if k == 60:
            price = None
        if k == 70:
            member = "MO012"
            log["member_fixed"].append(x["id"])
        if k == 80:
            member = "M9999"
            log["member_unknown"].append(x["id"])
        if k == 90:
            member = "M0061"
            log["member_merged"].append(x["id"])
        at = x["at"].replace(hour=2) if k == 100 else x["at"]
        rows.append([x["id"], at.strftime("%d/%m/") + str(at.year + 543) + at.strftime(" %H:%M"), code, None if k == 110 and x["size"] else x["size"], qty, price, member, PAY_WORDS["nimman"][x["pay"]]])
    rows.insert(200, rows[199])
    log["duplicate_rows"].append(rows[199][0])
    _write_csv(folder / "nimman_sales.csv", "receipt_no sale_datetime item_code size qty unit_price member_id payment".split(), rows)

    rows = []
    for k, x in enumerate(lines["cmu"]):
        name = x["p"][1]
        if k == 10:
            name = f" {x['p'][2].upper()} "
            log["synonym"].append(f"{x['n']:013d}")
        rows.append([f"{x['n']:013d}", x["at"].date(), x["at"].strftime("%H:%M"), name, SIZE_WORDS["cmu"].get(x["size"]), None if k == 20 else x["qty"], x["qty"] * x["price"], x["member"], PAY_WORDS["cmu"][x["pay"]]])
    write_xlsx(folder / "cmu_sales.xlsx", ["เลขที่บิล", "วันที่", "เวลา", "ชื่อเมนู", "ขนาด", "จำนวน", "ราคารวม", "รหัสสมาชิก", "ชำระโดย"], rows)

    receipts: dict[int, dict] = {}
    for x in lines["thaphae"]:
        bill = receipts.setdefault(x["n"], {"receipt_id": f"TP{x['n']:05d}", "timestamp": (x["at"] - timedelta(hours=7)).strftime("%Y-%m-%dT%H:%M:%SZ"), "customer": {"member_id": x["member"]}, "payment": {"method": PAY_WORDS["thaphae"][x["pay"]]}, "items": []})
        bill["items"].append({"sku": x["p"][5], "size": SIZE_WORDS["thaphae"].get(x["size"]), "quantity": x["qty"], "price": x["price"]})
    found = list(receipts.values())
    found.append(found[5])
    log["duplicate_bills"].append(found[5]["receipt_id"])
    log["duplicate_bill_items"] = len(found[5]["items"])
    (folder / "thaphae_sales.json").write_text(json.dumps({"branch": "thaphae", "exported_at": "2026-07-01T00:05:00Z", "receipts": found}, ensure_ascii=False), encoding="utf-8")
    log["counts"] = {"nimman": len(lines["nimman"]) + 1, "cmu": len(lines["cmu"]), "thaphae": sum(len(b["items"]) for b in found)}
    write_truth(folder, lines, originals, log)
    return log


def write_truth(folder: Path, lines: dict, members: list, log: dict) -> None:
    """What the files would say without the faults put in, and where those are."""
    form = {"nimman": "NM-{:06d}", "cmu": "{:013d}", "thaphae": "TP{:05d}"}
    rows, place = [], {}
    for branch, found in lines.items():
        for x in found:
            receipt = form[branch].format(x["n"])
            x["line"] = place[receipt] = place.get(receipt, 0) + 1
            rows.append([branch, receipt, x["line"], x["at"].strftime("%Y-%m-%d %H:%M:%S"), x["p"][0], x["size"], float(x["qty"]), float(x["price"]), x["member"], list(schemas.PAYMENTS[branch].values())[x["pay"]]])
    _write_csv(folder / "sales_truth.csv", "branch receipt_id line_no sale_dt product_id size qty unit_price member_id payment".split(), rows)
    _write_csv(folder / "members_truth.csv", "member_id full_name gender birth_year phone register_date home_branch".split(), members)
    at = lambda k: {"receipt_id": lines["nimman"][k]["id"], "line_no": lines["nimman"][k]["line"]}
    issues = [{"issue_id": i, **at(k)} for i, k in (("B8", 10), ("B10", 20), ("C1", 30), ("C3", 40), ("C2", 50), ("A1", 70))]
    (folder / "injected_issues.json").write_text(json.dumps({"issues": issues, "counts": {}}), encoding="utf-8")
