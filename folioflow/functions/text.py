"""Text, number and date columns of document extraction."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# --- Fixed values: patterns of the field rules -------------------------------
EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
WEBSITE = r"(?i)\b(?:https?://|www\.)[^\s<>()]+"
PHONE = r"(?<!\w)(?:\+?\d[\d\s().\-]{6,}\d)(?!\w)"
DATE = r"(?i)\b(?:\d{1,4}[./\-]\d{1,2}[./\-]\d{1,4}|\d{1,2}[\-\s](?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[\-\s]\d{2,4})\b"
MONEY = r"(?i)((?:(?:THB|TRY|USD|EUR|GBP|฿|₺|\$|€|£)\s*)?[-+]?\d[\d.,\s]*\d(?:\s*(?:THB|TRY|USD|EUR|GBP|฿|₺|\$|€|£))?)"
NUMBER = r"(?i)[:#]\s*([A-Z0-9][A-Z0-9/_.\-]{2,})"
TIME = r"(?i)\b(?:[01]?\d|2[0-3]):[0-5]\d(?:\s?[AP]M)?\b"
MONEY_NOISE = r"(?i)THB|TRY|USD|EUR|GBP|฿|₺|\$|€|£|\s"

# --- Fixed values: keywords of the field rules --------------------------------
KEYWORDS = {
    "invoice_number": ("invoice no", "invoice number", "invoice #", "fatura no", "เลขที่ใบแจ้งหนี้"),
    "receipt_number": ("receipt no", "receipt number", "transaction no", "transaction number", "fiş no", "เลขที่ใบเสร็จ"),
    "reference_number": ("reference no", "reference number", "referans no", "เลขอ้างอิง"),
    "subtotal": ("subtotal", "sub total", "ara toplam", "ยอดรวมก่อนภาษี"),
    "discount": ("discount", "indirim", "ส่วนลด"),
    "service_charge": ("service charge", "hizmet bedeli", "ค่าบริการ"),
    "tax": ("tax", "vat", "kdv", "ภาษี", "ภาษีมูลค่าเพิ่ม"),
    "total_amount": ("grand total", "total amount", "amount due", "total", "genel toplam", "toplam", "ยอดรวม", "รวมทั้งสิ้น"),
    "paid_amount": ("paid amount", "amount paid", "paid", "ödenen", "ชำระแล้ว", "ยอดชำระ"),
    "balance": ("balance due", "balance", "remaining", "bakiye", "ยอดคงเหลือ"),
    "payment_method": ("payment method", "paid by", "cash", "credit card", "nakit", "kredi kartı", "ชำระโดย", "เงินสด", "บัตรเครดิต"),
    "address": ("address", "adres", "ที่อยู่"),
    "tax_identification_number": ("tax id", "tax number", "vat no", "vergi no", "เลขประจำตัวผู้เสียภาษี"),
    "customer_account_number": ("customer no", "customer number", "account no", "account number", "müşteri no", "เลขที่ลูกค้า"),
    "vendor_name": ("vendor", "merchant", "seller", "supplier", "satıcı", "ผู้ขาย", "ร้านค้า"),
    "customer_name": ("customer", "buyer", "client", "müşteri", "ลูกค้า", "ผู้ซื้อ"),
    "person_name": ("full name", "name", "ad soyad", "ชื่อ-นามสกุล", "ชื่อ"),
    "bank_name": ("bank name", "bank", "banka", "ธนาคาร"),
    "account_reference": ("iban", "bank account", "account reference", "hesap", "เลขที่บัญชี"),
}
# Currency markers, in the order in which they are tried.
CURRENCIES = (
    ("฿", "THB"), ("thb", "THB"), ("บาท", "THB"), ("₺", "TRY"), ("try", "TRY"), ("tl", "TRY"),
    ("$", "USD"), ("usd", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"),
)
# Words of payment methods and titles.
PAYMENTS = (("cash", ("cash", "nakit", "เงินสด")), ("credit_card", ("credit card", "kredi kartı", "บัตรเครดิต")), ("bank_transfer", ("bank transfer", "havale", "โอนเงิน")))
TITLES = (("invoice", ("invoice", "fatura", "ใบแจ้งหนี้")), ("receipt", ("receipt", "fiş", "fis", "ใบเสร็จ")))
CURRENCY_NAMES = {"฿": "THB", "BAHT": "THB", "$": "USD", "US$": "USD", "€": "EUR", "£": "GBP", "₺": "TRY"}
HEADER_WORDS = r"(?i)invoice|receipt|date|total|tax|fatura|ใบเสร็จ"


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_case(text: Column, cases, test=contains_any) -> Column:
    """The name of the first (name, words) case whose words occur in ``text``."""
    out = F.lit(None).cast("string")
    for name, words in reversed(list(cases)):
        out = F.when(test(text, words), F.lit(name)).otherwise(out)
    return out


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or NULL."""
    m = F.regexp_extract(text, pattern, group)
    return F.when(m != "", m)


def after_label(text: Column) -> Column:
    """What follows the first colon, trimmed; NULL where that is nothing."""
    return found(text, r"^[^:：]*?\s*[:：]\s*(.*?)\s*$", 1)


def currency(text: Column) -> Column:
    folded = F.lower(text)
    out = F.lit(None).cast("string")
    for marker, code in reversed(CURRENCIES):
        out = F.when(F.contains(folded if marker.isalpha() else text, F.lit(marker)), F.lit(code)).otherwise(out)
    return out


def last_money(text: Column) -> Column:
    every = F.regexp_extract_all(text, F.lit(MONEY), 1)
    return F.when(F.size(every) > 0, F.trim(F.element_at(every, -1)))


def money(raw: Column) -> Column:
    """Decimal with two places, half-even; a lone comma before 2-3 digits is a decimal mark.

    Amounts of up to 34 digits before the mark are exact; longer ones, like
    text that is no number, give NULL.
    """
    c = F.regexp_replace(raw, MONEY_NOISE, "")
    comma, dot = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit(""))), F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    comma_last = F.length(F.substring_index(c, ",", -1)) < F.length(F.substring_index(c, ".", -1))
    no_comma = F.replace(c, F.lit(","), F.lit(""))
    plain = (
        F.when((comma > 0) & (dot > 0), F.when(comma_last, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(no_comma))
        .when((comma == 1) & F.length(F.substring_index(c, ",", -1)).isin(2, 3), F.replace(c, F.lit(","), F.lit(".")))
        .otherwise(no_comma)
    )
    # what follows the third decimal only tells whether that one is exact
    short = F.regexp_replace(plain, r"(\.\d{3})0*[1-9]\d*$", "$11")
    return F.bround(short.try_cast("decimal(38,4)"), 2).cast("decimal(38,2)")


def loose_number(text: Column) -> Column:
    """The number that evaluation reads, as text: a comma before 1-2 digits is a decimal mark."""
    n = F.replace(F.regexp_extract(text, r"[-+]?\d[\d\s.,]*", 0), F.lit(" "), F.lit(""))
    comma, dot = F.contains(n, F.lit(",")), F.contains(n, F.lit("."))
    comma_last = F.length(F.substring_index(n, ",", -1)) < F.length(F.substring_index(n, ".", -1))
    no = lambda c, ch: F.replace(c, F.lit(ch), F.lit(""))
    many = (F.length(n) - F.length(no(n, "."))) > 1
    head = F.substring(n, F.lit(1), F.length(n) - F.length(F.substring_index(n, ".", -1)) - 1)
    return (
        F.when(comma & dot, F.when(comma_last, F.replace(no(n, "."), F.lit(","), F.lit("."))).otherwise(no(n, ",")))
        .when(comma, F.when(F.length(F.substring_index(n, ",", -1)).isin(1, 2), F.replace(n, F.lit(","), F.lit("."))).otherwise(no(n, ",")))
        .when(many, F.concat(no(head, "."), F.lit("."), F.substring_index(n, ".", -1)))
        .otherwise(n)
    )


def loose_decimal(text: Column) -> Column:
    """:func:`loose_number` with up to 20 digits before the mark and ten after it."""
    return loose_number(text).try_cast("decimal(30,10)")


def iso_date(text: Column) -> Column:
    """Three numbers, the year known by its four digits; day and month only range-checked."""
    n = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    a, b, c = (F.try_element_at(n, F.lit(i)) for i in (1, 2, 3))
    year, month, day = F.when(F.length(a) == 4, a).when(F.length(c) == 4, c), b, F.when(F.length(a) == 4, c).otherwise(a)
    m, d = month.try_cast("int"), day.try_cast("int")
    ok = (F.size(n) == 3) & year.isNotNull() & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.concat_ws("-", year, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))).otherwise("")


def decimal_mark(text: Column) -> Column:
    return found(text, r"\d([.,])\d{1,2}(?!\d)", 1)


def alphanumeric(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{Nd}]", "")


def currency_code(text: Column) -> Column:
    c = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    out = c
    for name, code in CURRENCY_NAMES.items():
        out = F.when(c == name, F.lit(code)).otherwise(out)
    return out


def folded(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed (plain ASCII rule)."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def contains_thai(text: Column) -> Column:
    return text.rlike("[฀-๿]")


def garbage(text: Column) -> Column:
    """No letter or digit, or one character makes up more than four fifths.

    A character that common is the middle one of the sorted characters, so
    only that one is counted.
    """
    n = F.length(text)
    middle = F.element_at(F.sort_array(F.split(text, "")), F.floor(n / 2).cast("int") + 1)
    most = n - F.length(F.replace(text, middle, F.lit("")))
    return ~text.rlike(r"[\p{L}\p{N}]") | ((n > 0) & (most / F.greatest(n, F.lit(1)) > 0.8))


def turkish_letters(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit("([çğıöşüÇĞİÖŞÜ])"), 1), "")


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[_.]+|[_.]+$", ""), 1, 60)


def drop_lone_quote(text: Column) -> Column:
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return F.when(quotes == 1, F.replace(text, F.lit('"'), F.lit(""))).otherwise(text)


def half_even(number: Column) -> Column:
    return F.rint(number)


def synthetic_count(real: Column, fraction: Column) -> Column:
    """How many made-up rows give ``fraction`` of the whole."""
    return F.rint(real * fraction / (F.lit(1.0) - fraction)).cast("bigint")


def human_bytes(n: Column) -> Column:
    """Bytes with a unit, two places rounded half-even; NULL for NULL."""
    out = F.format_string("%.2f TB", F.bround(n / F.lit(1024.0**4), 2))
    for unit, size in (("GB", 3), ("MB", 2), ("KB", 1)):
        out = F.when(n < F.lit(1024.0 ** (size + 1)), F.format_string(f"%.2f {unit}", F.bround(n / F.lit(1024.0**size), 2))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).when(n.isNotNull(), out)


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y"), F.lit(False))


# --- Unicode semantics that the JVM functions lack: one narrow Arrow UDF each --
@F.pandas_udf(T.StringType())
def norm_text(s: pd.Series) -> pd.Series:
    """Compatibility form, case folded, white space collapsed."""
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts after folding; 0 for an empty reference."""

    def one(x, y):
        if x is None or y is None:
            return None
        p, q = (" ".join(unicodedata.normalize("NFKC", t).split()).casefold() for t in (x, y))
        return SequenceMatcher(None, p, q).ratio() if p else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="object").astype("Float64")


@F.pandas_udf(T.IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two texts as sequences of words."""

    def one(x, y):
        if x is None or y is None:
            return None
        p, q = x.split(), y.split()
        row = list(range(len(q) + 1))
        for i, u in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(q, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
        return row[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int64")
