"""Plain forms of loosely written ids, names and missing values, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks around a value.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u200b\u3000\ufeff"
#: Ways of writing that a value is missing, in lower case and without blanks around them. Fixed values.
MISSING = ("", "-", "--", "?", "na", "n/a", "n.a.", "nan", "none", "null", "nil", "unknown", "missing", "not available")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without blanks around it. Null stays null."""
    return F.trim(_col(c), F.lit(BLANKS))


def plain_id(c: Column | str) -> Column:
    """``PREFIX-`` in upper case and the rest in lower case, without blanks around it; text without a hyphen goes to lower case."""
    t = strip(c)
    return F.when(F.instr(t, "-") > 0, F.concat(F.upper(F.substring_index(t, "-", 1)), F.lower(F.substr(t, F.instr(t, "-"))))).otherwise(F.lower(t))


def plain_words(c: Column | str) -> Column:
    """Lower case, words joined by ``_`` instead of blanks and hyphens, without blanks around it."""
    return F.regexp_replace(F.lower(strip(c)), r"[\s\x{00a0}-]+", "_")


def is_missing(c: Column | str) -> Column:
    """True for null and for every way of writing that a value is missing."""
    return F.coalesce(F.lower(strip(_col(c).cast("string"))).isin(*MISSING), F.lit(True))


#: Names of the four partitions after lower-casing and joining words by ``_``. Fixed values.
PARTITION_NAMES = {"train": ("train", "training"), "validation": ("validation", "valid", "val"), "calibration": ("calibration", "calib", "cal"), "final_test": ("final_test", "finaltest", "test", "testing")}


def plain_partition(c: Column | str) -> Column:
    """One of the four partitions; null for null and for unknown names."""
    t = plain_words(c)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, ways in PARTITION_NAMES.items():
        out = out.when(t.isin(*ways), name)
    return out


# The same rules as text for DuckDB.
SQL_BLANKS = " || ".join(f"chr({ord(x)})" for x in BLANKS)


def sql_strip(c: str) -> str:
    return f"trim({c}, {SQL_BLANKS})"


def sql_plain_id(c: str) -> str:
    t = sql_strip(c)
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN instr({t}, '-') > 0 THEN upper(substr({t}, 1, instr({t}, '-') - 1)) || lower(substr({t}, instr({t}, '-'))) ELSE lower({t}) END"


def sql_plain_words(c: str) -> str:
    return f"regexp_replace(lower({sql_strip(c)}), '[\\s\\x{{00a0}}-]+', '_', 'g')"


def sql_is_missing(c: str) -> str:
    return f"coalesce(lower({sql_strip(c)}) IN ({', '.join(repr(x) for x in MISSING)}), true)"


def sql_plain_partition(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_plain_words(c)} IN ({', '.join(map(repr, ways))}) THEN '{name}'" for name, ways in PARTITION_NAMES.items()) + " END"
