"""Value and name patterns, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: formats and word lists whose exact form decides results ---
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PHONE_PATTERN = r"^\+?[\d\s\-\(\)]{7,15}$"
AADHAAR_PATTERN = r"^\d{4}\s?\d{4}\s?\d{4}$|^\d{12}$"
PAN_PATTERN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
URL_PATTERN = r"(?i)^https?://"
CURRENCY_SIGN_PATTERN = "[₹$€£]"
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "1", "0", "t", "f")
PERSON_NAME_PATTERN = (
    r"(?i)(customer|patient|guardian|contact|user|full|first|last|student|employee|client|"
    r"account_holder|owner)[_\s]*name|^name$"
)
PERSONAL_COLUMN_PATTERN = (
    r"(?i)phone|email|address|dob|birth|ssn|aadhaar|pan_number|passport|account_number|card_number"
)
PERSONAL_VALUE_PATTERNS = {
    "email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "aadhaar": r"\b\d{4}\s\d{4}\s\d{4}\b",
    "pan": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "phone": r"\b\+?\d{1,3}[-.\s]?\d{10}\b",
}
ANSWER_NUMBER_PATTERN = r"-?\d[\d,]*\.?\d*"
# --- end of fixed values ---

_TIME = r"\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(\s?(Z|[+-]\d{2}(:?\d{2})?))?"
_DATE_TEXT = rf"^\s*\d{{4}}([-/])\d{{1,2}}\1\d{{1,2}}([T ]{_TIME})?\s*$"
_PLAIN_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def is_date_text(value: Column) -> Column:
    """True when the text is a calendar date (year, month, day), with a time of day at most after it."""
    day = F.translate(F.regexp_extract(value, r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", 0), "/", "-")
    return F.coalesce(value.rlike(_DATE_TEXT) & day.try_cast("date").isNotNull(), F.lit(False))


def is_number_text(value: Column) -> Column:
    """True when the text is a number; Java suffixes such as ``1d`` are not."""
    return F.coalesce(value.rlike(_PLAIN_NUMBER), F.lit(False))


def name_tokens(name: Column) -> Column:
    """Distinct lower-case tokens of a name, split on underscore and space."""
    return F.array_distinct(F.split(F.lower(F.trim(name)), r"[_\s]+"))


def jaccard(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def name_similarity(left: Column, right: Column) -> Column:
    """Token overlap, lifted when one name contains the other or is a bare id."""
    a, b = F.lower(left), F.lower(right)
    contained = F.when(b.contains(a) | a.contains(b), 0.6).otherwise(0.0)
    bare_id = F.when(
        (a.endswith("_id") & (b == "id")) | (b.endswith("_id") & (a == "id")), 0.5
    ).otherwise(0.0)
    return F.greatest(jaccard(name_tokens(left), name_tokens(right)), contained, bare_id)


def contains_any(text: Column, words) -> Column:
    """True when the text contains one of the words, compared literally."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def personal_column_name(name: Column) -> Column:
    return name.rlike(PERSON_NAME_PATTERN) | name.rlike(PERSONAL_COLUMN_PATTERN)
