"""Canonical forms of cells, as Column expressions.

A cell is compatibility-composed, lower-cased and trimmed; then the first that fits of e-mail address, URL, date, phone
number, coordinates and fraction gives its form, else plain text does. Patterns are Java's, on both sides of the regex
functions. All of it runs in the JVM; what Spark has no function for is registered (see latin.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsieve.config import NormalizeConfig
from rowsieve.functions.latin import ascii_domain, composed, to_latin
from rowsieve.functions.phone import normalize_phone

#: Domains whose local parts ignore dots and tags.
TAGGABLE_DOMAINS = ("fastmail.com", "gmail.com", "googlemail.com", "hotmail.com", "outlook.com", "yandex.ru")
#: Abbreviated month names of Russian in the CLDR, lower case, January first.
RU_MONTHS = ("янв.", "февр.", "мар.", "апр.", "мая", "июн.", "июл.", "авг.", "сент.", "окт.", "нояб.", "дек.")
#: Patterns that decide the results.
URL = r"(?i)\A(?:[a-z][a-z0-9+.-]*://.*|\w+\.\w+.*)\z"
GEO = r"\b(\d{1,3}\.\d+)°?\s*[nNsS]?[, ]\s*(-?\d{1,3}\.\d+)°?\s*[eEwW]?\b"
FRACTION = r"\A(?:½|1/2|50 ?%)\z"
SPACED = r"\p{Punct}&&[^@._/#&+\-]+"  # the ampersands are literal, so this is rare
DROPPED = r"[^\p{IsAlphabetic}\d\s@._/#&+\-]"

_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_ATOM = r"(?:[^\s\p{Cntrl}()<>@,;:'\\\".\[\]]|')+"
EMAIL = rf"\A(?:{_ATOM}|\"[^\"]*\")(?:\.(?:{_ATOM}|\"[^\"]*\"))*@(?:{_LABEL}\.)+(?:[a-z]{{2,63}}|xn--[a-z0-9-]{{1,59}})\z"


def trim_control(c: Column) -> Column:
    """Strips every character up to U+0020 from both ends."""
    # A run is tried from its start only, so long ones inside take linear time.
    return F.regexp_replace(c, r"\A[\x00-\x20]+|(?<![\x00-\x20])[\x00-\x20]+\z", "")


def prepare(c: Column) -> Column:
    """The form in which a cell is tried against the kinds; null is empty."""
    return trim_control(F.replace(F.lower(composed(F.coalesce(c, F.lit("")))), F.lit("\u00a0"), F.lit(" ")))


def _local(v: Column) -> Column:
    return F.regexp_replace(v, r"@[^@]*\z", "")


def _domain(v: Column) -> Column:
    """The ASCII form of what follows the last at sign, null where there is none."""
    return ascii_domain(F.substring_index(v, "@", -1))


def is_email(v: Column) -> Column:
    address = F.concat(_local(v), F.lit("@"), _domain(v))
    fits = address.rlike(EMAIL) & (F.length(_local(v)) <= 64) & (F.length(_domain(v)) <= 253)
    # Nothing longer is an address, and the pattern's loops are deep on long texts.
    return F.when(v.contains("@") & (F.length(v) <= 320), F.coalesce(fits, F.lit(False))).otherwise(F.lit(False))


def normalize_email(v: Column) -> Column:
    domain = _domain(v)
    domain = F.when(domain == "googlemail.com", "gmail.com").otherwise(domain)
    plain = F.regexp_replace(F.replace(_local(v), F.lit("."), F.lit("")), r"\+[^@]+\z", "")
    return F.concat(F.when(domain.isin(*TAGGABLE_DOMAINS), plain).otherwise(_local(v)), F.lit("@"), domain)


def is_url(v: Column) -> Column:
    return v.rlike(URL)


def normalize_url(v: Column) -> Column:
    """Host and at most two parts of the path; no scheme, www, query or fragment."""
    v = F.regexp_replace(v, r"(?i)\A(?:https?://)?(?:www\.)?", "")
    v = F.substring_index(F.substring_index(v, "#", 1), "?", 1)
    return F.array_join(F.slice(F.split(F.regexp_replace(v, r"(?<!/)/+\z", ""), "/"), 1, 3), "/")


#: Spellings of dates with year, month and day as groups.
_YEAR, _MONTH, _DAY = r"(?!0000)(\d{4})", r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
DATES = (
    (rf"\A{_DAY}/{_MONTH}/{_YEAR}\z", "$3-$2-$1"),
    (rf"\A{_MONTH}-{_DAY}-{_YEAR}\z", "$3-$1-$2"),
    (rf"\A{_MONTH}/{_DAY}/{_YEAR}\z", "$3-$1-$2"),
)
DATE_TIME = rf"\A{_YEAR}-{_MONTH}-{_DAY}t(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{{0,9}})?)?\z"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _last_day(date: Column) -> Column:
    return F.dayofmonth(F.last_day(F.concat(F.left(date, F.lit(8)), F.lit("01")).cast("date")))


def normalize_date(v: Column) -> Column:
    """dd/MM/yyyy, else MM-dd-yyyy, else MM/dd/yyyy, else an ISO date and time, else d-MMM-yy in Russian; or null.

    A day past the month's end is its last day, but in the ISO form it is no date. Other spellings are out of reach: dotted
    dates are URLs, and English month names and a plain T don't outlive lower-casing."""
    spelt = [F.when(v.rlike(p), F.regexp_replace(v, p, order)) for p, order in DATES]
    names = "|".join(m.replace(".", "[.]") for m in RU_MONTHS)
    russian = rf"\A(0?[1-9]|[12]\d|3[01])-({names})-(\d\d)\z"
    month = F.lpad(F.array_position(F.array(*map(F.lit, RU_MONTHS)), F.regexp_extract(v, russian, 2)).cast("string"), 2, "0")
    spelt.append(F.when(v.rlike(russian), F.concat_ws("-", F.concat(F.lit("20"), F.right(v, F.lit(2))), month, F.lpad(F.regexp_extract(v, russian, 1), 2, "0"))))
    clamped = _let(F.coalesce(*spelt), lambda d: F.concat(F.left(d, F.lit(8)), F.lpad(F.least(F.right(d, F.lit(2)).cast("int"), _last_day(d)).cast("string"), 2, "0")))
    exact = F.when(v.rlike(DATE_TIME), _let(F.left(v, F.lit(10)), lambda d: F.when(F.right(d, F.lit(2)).cast("int") <= _last_day(d), d)))
    return F.when(v.rlike(r"\A\d{1,4}[/-]"), F.coalesce(clamped, exact))


def normalize_geo(v: Column) -> Column:
    """Latitude and longitude without hemisphere, or null."""
    return F.when(v.rlike(GEO), F.concat_ws(",", F.regexp_extract(v, GEO, 1), F.regexp_extract(v, GEO, 2)))


def normalize_fraction(v: Column) -> Column:
    return F.when(v.rlike(FRACTION), F.lit("0.5"))


def text_tail(v: Column) -> Column:
    """White space to blanks, then symbols that carry no meaning dropped, so that double blanks can remain."""
    spaced = F.regexp_replace(F.regexp_replace(v, SPACED, " "), r"\s+", " ")
    return trim_control(F.regexp_replace(spaced, DROPPED, ""))


def normalize_text(v: Column) -> Column:
    return text_tail(to_latin(v))


def normalize_prepared(v: Column, cfg: NormalizeConfig = NormalizeConfig()) -> Column:
    special = F.when(is_email(v), normalize_email(v)).when(is_url(v), normalize_url(v))
    return F.coalesce(special, normalize_date(v), normalize_phone(v, cfg.phone_region), normalize_geo(v), normalize_fraction(v), normalize_text(v))


def normalize_cell(c: Column, cfg: NormalizeConfig = NormalizeConfig()) -> Column:
    """The canonical form of a cell; null and blank cells are empty."""
    return normalize_prepared(prepare(c), cfg)
