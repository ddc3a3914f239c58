"""Names, code maps and limits of the retail model.

Fixed values: column names of the source files, code words, business limits.
"""

from __future__ import annotations

BRANCHES = ("nimman", "cmu", "thaphae")
BRANCH_INFO = [("nimman", "นิมมาน", "Nimman", "CSV"), ("cmu", "มช.", "CMU", "Excel"), ("thaphae", "ท่าแพ", "Tha Phae", "JSON")]

STAGING = (
    "branch receipt_id sale_datetime product_id size qty unit_price line_total member_id payment price_source "
    "extract_flags datetime_raw product_raw size_raw payment_raw source_file source_row"
).split()

NIMMAN_COLUMNS = {"receipt_no": "receipt_id", "sale_datetime": "datetime_raw", "item_code": "product_raw", "size": "size_raw", "qty": "qty", "unit_price": "unit_price", "member_id": "member_id", "payment": "payment_raw"}
CMU_COLUMNS = {"เลขที่บิล": "receipt_id", "ชื่อเมนู": "product_raw", "ขนาด": "size_raw", "จำนวน": "qty", "ราคารวม": "line_total", "รหัสสมาชิก": "member_id", "ชำระโดย": "payment_raw"}
CMU_DATE, CMU_TIME = "วันที่", "เวลา"

SIZES = {
    "nimman": {"S": "S", "M": "M", "L": "L"},
    "cmu": {"เล็ก": "S", "กลาง": "M", "ใหญ่": "L"},
    "thaphae": {"Small": "S", "Medium": "M", "Large": "L"},
}
PAYMENTS = {
    "nimman": {"CASH": "cash", "QR": "qr", "CARD": "card"},
    "cmu": {"เงินสด": "cash", "พร้อมเพย์": "qr", "บัตรเครดิต": "card"},
    "thaphae": {"cash": "cash", "promptpay": "qr", "credit_card": "card"},
}
PRODUCT_KEYS = {"nimman": "nimman_code", "cmu": "name_th", "thaphae": "thaphae_sku"}

PERIOD = ("2026-01-01", "2026-06-30")
OPEN_HOUR, CLOSE_HOUR = 7, 20
AGES = (10, 100)
VOLATILITY_DAYS = 7
RECEIVED_AT = "2026-07-01 07:05:00"
TARGET = 0.98
PRICE_TOLERANCE = 0.01
GENDER_UNKNOWN = "U"
GENDERS = ("M", "F", GENDER_UNKNOWN)
LARGE_QTY = 50
DIMENSIONS = ("Completeness", "Uniqueness", "Validity", "Consistency", "Accuracy", "Timeliness")

DRINKS = ("coffee", "non_coffee")
BAKERY = "bakery"
SIZE_ORDINAL = {"S": 1, "M": 2, "L": 3}
TIMES_OF_DAY = (("เช้า", 7, 10), ("กลางวัน", 11, 13), ("บ่าย", 14, 16), ("เย็น", 17, 19))
AGE_GROUPS = (("<=22", 0, 22), ("23-35", 22, 35), ("36-50", 35, 50), ("51+", 50, 150))
TIERS = ("ต่ำ", "กลาง", "สูง")
NO_TIER = "ไม่เคยซื้อ"

MEMBERS = "member_id string, full_name string, gender string, birth_year int, phone string, register_date string, home_branch string"
PRODUCTS = "product_id string, name_th string, name_en string, category string, nimman_code string, thaphae_sku string, price_S int, price_M int, price_L int, price_nosize int"
HOLIDAYS = "date date, name_th string, name_en string"
RECEIPT = "receipt_id string, timestamp string, customer struct<member_id: string>, payment struct<method: string>, items array<struct<sku: string, size: string, quantity: string, price: string>>"
