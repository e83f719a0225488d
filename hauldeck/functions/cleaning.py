"""Column functions that type the all-text trip export."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "missing".
MISSING_TEXTS = ["", "nan", "None", "NaN", "NaT", "NA", "na"]
# Accepted day-first layouts, then ISO ones.
DATETIME_PATTERNS = [
    "dd-MM-yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "dd-MM-yyyy HH:mm",
    "dd/MM/yyyy HH:mm",
    "yyyy-MM-dd HH:mm",
    "dd-MM-yyyy",
    "dd/MM/yyyy",
    "yyyy-MM-dd",
]


def clean_str(c: Column, missing: list[str] | None = None) -> Column:
    """Trimmed text, NULL for texts that mean missing (the oldest loader knew fewer of them)."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t.isin(missing or MISSING_TEXTS), None).otherwise(t)


def _digits(c: Column) -> Column:
    kept = F.regexp_replace(c, "[^0-9+]", "")
    return F.when(kept.isin("", "0"), None).otherwise(kept)


def clean_mobile(c: Column) -> Column:
    """Every '.0' goes, then everything but digits and '+'."""
    return _digits(F.replace(clean_str(c), F.lit(".0"), F.lit("")))


def clean_mobile_suffix(c: Column) -> Column:
    """Variant of the bulk loader: only a trailing '.0' goes."""
    return _digits(F.regexp_replace(clean_str(c), r"\.0$", ""))


def parse_datetime(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in DATETIME_PATTERNS])


def safe_float(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def safe_int(c: Column) -> Column:
    """Truncates toward zero; values outside bigint become NULL."""
    return safe_float(c).try_cast("bigint")


def like_search(text: str, *cols: Column) -> Column:
    """Case-insensitive 'contains' on any of the columns."""
    cond = None
    for c in cols:
        hit = F.lower(c).contains(text.lower())
        cond = hit if cond is None else cond | hit
    return cond
