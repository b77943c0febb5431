"""Phone numbers to E.164, by a compact numbering plan.

The plan covers the countries below; numbers of others are taken as invalid and stay text. Each entry has the national
number's pattern and the trunk prefix that may stand before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calling code, national number, trunk prefix, by region.
PLAN: dict[str, tuple[str, str, str]] = {
    "US": ("1", r"[2-9](?:[02-8]\d|1[02-9]|9[0-8])[2-9]\d{6}", "1"),
    "CA": ("1", r"[2-9](?:[02-8]\d|1[02-9]|9[0-8])[2-9]\d{6}", "1"),
    "RU": ("7", r"(?:3(?:0[12]|4[1-35-79]|5[1-3]|65|8[1-58]|9[0145])|4(?:01|1[1356]|2[13467]|7[1-5]|8[1-7]|9[1-689])|8(?:1[1-8]|2[01]|3[13-6]|4[0-8]|5[15-7]|6[0-35-79]|7[1-37-9])|9\d\d|80\d)\d{7}", "8"),
    "KZ": ("7", r"7(?:0[0-8]|1[0-8]|2[1-9]|4[078]|5[0-15]|6[0-4]|7[15-8])\d{7}", "8"),
    "GB": ("44", r"(?:1\d{8,9}|2[03489]\d{8}|3\d{9}|7[1-57-9]\d{8}|800\d{6,7}|8(?:4[2-5]|7[0-3])\d{7})", "0"),
    "DE": ("49", r"(?:1(?:5\d{9}|[67]\d{8,9})|[2-9]\d{5,10})", "0"),
    "FR": ("33", r"[1-79]\d{8}", "0"),
    "ES": ("34", r"[5-9]\d{8}", ""),
    "IT": ("39", r"(?:0\d{5,10}|3\d{8,9})", ""),
    "UA": ("380", r"[3-9]\d{8}", "0"),
    "PL": ("48", r"[1-9]\d{8}", ""),
    "CN": ("86", r"(?:1[3-9]\d{9}|[2-9]\d{8,10})", "0"),
    "IN": ("91", r"[6-9]\d{9}", "0"),
}


def normalize_phone(v: Column, region: str) -> Column:
    """The E.164 form, or null. Numbers without a plus sign or 00 before them are of the region given."""
    digits = F.regexp_replace(v, r"\D", "")
    able = v.rlike(r"\A[+\d()\-./\s]{8,}\z") & F.length(digits).between(10, 15)
    abroad = v.rlike(r"\A(?:\+|00)")
    number = F.when(v.startswith("00"), F.substr(digits, F.lit(3))).otherwise(digits)
    codes = dict.fromkeys(code for code, _, _ in PLAN.values())
    anywhere = [F.when(number.rlike(rf"\A{code}(?:{'|'.join(n for c, n, _ in PLAN.values() if c == code)})\z"), F.concat(F.lit("+"), number)) for code in codes]
    found = F.when(abroad, F.coalesce(*anywhere))
    if region in PLAN:
        code, national, trunk = PLAN[region]
        with_trunk = F.regexp_replace(digits, rf"\A{trunk}(?={national}\z)", "") if trunk else digits
        home = F.when(with_trunk.rlike(rf"\A(?:{national})\z"), F.concat(F.lit(f"+{code}"), with_trunk))
        full = F.when(digits.rlike(rf"\A{code}(?:{national})\z"), F.concat(F.lit("+"), digits))
        found = F.when(abroad, F.coalesce(*anywhere)).otherwise(F.coalesce(home, full))
    return F.when(able, found)
