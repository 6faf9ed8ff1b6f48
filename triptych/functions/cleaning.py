"""Column expressions for ingest and cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.strip() and str.split() see it: Unicode white space plus the four separators.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
NUMBER = rf"(?iU)^{SPACE}*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?){SPACE}*$"

# Texts read as true.
TRUE_WORDS = ("TRUE", "1", "T", "YES")


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (`trim` removes spaces only)."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def missing_if_nan(c: Column) -> Column:
    """NaN means missing everywhere in this library; Spark would sort it above all numbers."""
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not wholly a number becomes NULL."""
    return F.when(c.rlike(NUMBER), strip(c).try_cast("double"))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def title_case(c: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere (`initcap` only looks at spaces)."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    word = lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))
    return F.array_join(F.transform(runs, word), "")


def is_true_text(c: Column) -> Column:
    """Texts such as TRUE, 1, T and YES in any case are true, all else (missing too) is false."""
    return F.coalesce(F.upper(c.cast("string")).isin(*TRUE_WORDS), F.lit(False))


def word_count(c: Column) -> Column:
    """Words separated by any white space; 0 for missing."""
    words = F.regexp_extract_all(c, F.lit(f"(?U){NOT_SPACE}+"), F.lit(0))
    return F.coalesce(F.size(words), F.lit(0))


def collapse_spaces(c: Column) -> Column:
    """Runs of white space to one space, ends stripped, missing to the empty text."""
    return F.coalesce(strip(F.regexp_replace(c, f"(?U){SPACE}+", " ")), F.lit(""))


def title_key(c: Column) -> Column:
    """Form under which titles are stored in and probed against the lookup."""
    return F.lower(strip(c))


def first_filled(*columns: Column) -> Column:
    """First column that is neither missing nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])
