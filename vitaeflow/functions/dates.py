"""Dates as people write them, to YYYY.MM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaeflow.functions.text import let, strip

#: Words for the present, month names.
PRESENT = ("至今", "present", "至今在职", "在职", "now", "current")
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
#: Notations that are taken, in the order in which they are tried.
DONE = r"^\d{4}\.\d{2}$"
YEAR = r"^\d{4}\s*年?$"
YEAR_AND_MONTH = (r"^(\d{4})\.(\d)$", r"^(\d{4})\s*年\s*(\d{1,2})\s*月?$", r"^(\d{4})/(\d{1,2})$")
NAME_AND_YEAR = r"^([A-Za-z]+)\s+(\d{4})$"
YEAR_DASH_MONTH = r"^(\d{4})-(\d{1,2})$"


def _month_number(name: Column) -> Column:
    pairs = {m: i for i, m in enumerate(MONTH_NAMES, 1)} | {m[:3]: i for i, m in enumerate(MONTH_NAMES, 1)}
    months = F.create_map(*(F.lit(x) for m, i in pairs.items() for x in (m, f"{i:02d}")))
    return F.try_element_at(months, F.lower(name))


def normalize_period(value: Column) -> Column:
    """A date in one of the common notations as YYYY.MM; others stay, without blanks around them."""
    return F.when(value.isNull() | (value == ""), value).otherwise(let(strip(value), _normalized))


def _normalized(v: Column) -> Column:
    def pieces(pattern: str) -> Column:
        return F.concat(F.regexp_extract(v, pattern, 1), F.lit("."), F.lpad(F.regexp_extract(v, pattern, 2), 2, "0"))

    month = _month_number(F.regexp_extract(v, NAME_AND_YEAR, 1))
    kept = F.lower(v).isin(*PRESENT) | v.rlike(DONE)
    out = F.when(kept, v).when(v.rlike(YEAR), F.concat(F.substring(v, 1, 4), F.lit(".01")))
    for pattern in YEAR_AND_MONTH:
        out = out.when(v.rlike(pattern), pieces(pattern))
    out = out.when(v.rlike(NAME_AND_YEAR) & month.isNotNull(), F.concat(F.regexp_extract(v, NAME_AND_YEAR, 2), F.lit("."), month))
    return out.when(v.rlike(YEAR_DASH_MONTH), pieces(YEAR_DASH_MONTH)).otherwise(v)
