"""Scalar cleaning and rule-based classification of raw measurement rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Trimmed text; null becomes empty."""
    return F.trim(F.coalesce(_c(c).cast("string"), F.lit("")))


def number(c: Column | str) -> Column:
    """A double, or null where the text is none."""
    return _c(c).try_cast("double")


def censored_by_text(a: Column | str, b: Column | str) -> Column:
    """Either limit note has text besides blanks (the curation rule)."""
    return (F.length(clean(a)) > 0) | (F.length(clean(b)) > 0)


def censored_by_presence(a: Column | str, b: Column | str) -> Column:
    """Either limit note is present at all, blanks included (the audit rule)."""
    return _c(a).isNotNull() | _c(b).isNotNull()


#: Classes of limit notes in the order in which they apply: words that the note contains, or a pattern. Fixed values.
NOTE_CLASSES = (
    ("solubility_or_not_tested", ("solubility", "not tested"), None),
    ("no_reportable_value", ("no value", "n/a", "%t>100"), None),
    ("not_detected_or_below_lod", ("not detected", "undetected", "below lod", "blod"), None),
    ("explicit_upper_limit", (), r"(^|\s)<\s*[-+]?\d"),
    ("database_assigned_or_reported_floor", ("set to", "value described"), None),
)


def note_class(a: Column | str, b: Column | str) -> Column:
    """The first class whose words or pattern occur in the two notes; not_censored without notes, else other_detection_limit_note."""
    some = lambda c: F.when(F.length(clean(c)) > 0, _c(c).cast("string"))
    text = F.lower(F.concat_ws(" ", some(a), some(b)))
    out = F.when(text == "", "not_censored")
    for name, words, pattern in NOTE_CLASSES:
        rule = text.rlike(pattern) if pattern else F.lit(False)
        for w in words:
            rule |= F.contains(text, F.lit(w))
        out = out.when(rule, name)
    return out.otherwise("other_detection_limit_note")


def topology_signature(shape: Column | str, total: Column | str, main: Column | str, helm: Column | str, tokens: Column | str) -> Column:
    """``kind|total=|main=|tokens=``; a circle closed from its first to its last main-chain unit is head to tail. Unknown numbers are -1."""
    s = F.lower(F.when(clean(shape) == "", "unknown").otherwise(clean(shape)))
    whole = lambda c: F.coalesce(number(clean(c)).cast("int"), F.lit(-1))
    t, m = whole(total), whole(main)
    closed = (s == "circle") & (t == m) & (m > 0) & F.contains(clean(helm), F.concat(F.lit(",1:R1-"), m.cast("string"), F.lit(":R2")))
    kind = F.when(closed, "circle_head_to_tail").when(s == "circle", "circle_other").otherwise(s)
    return F.concat(kind, F.lit("|total="), t.cast("string"), F.lit("|main="), m.cast("string"), F.lit("|tokens="), F.coalesce(_c(tokens), F.lit(-1)).cast("string"))


def prefix(c: Column | str) -> Column:
    """What stands before the first bar."""
    return F.substring_index(_c(c), "|", 1)


def one_hot(c: Column | str, values: tuple[str, ...]) -> list[Column]:
    return [F.coalesce((_c(c) == v).cast("int"), F.lit(0)).alias(f"is_{v}") for v in values]


def normalized(y: Column | str) -> Column:
    """The endpoint scaled from [-6, -4] to [0, 1]: (y + 6) / 2."""
    return (_c(y) + 6.0) / 2.0


def denormalized(p: Column | str) -> Column:
    return 2.0 * _c(p) - 6.0


def is_finite(c: Column | str) -> Column:
    x = _c(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


#: The twenty tokens without modification. Fixed values.
CANONICAL = ("Ala", "Arg", "Asn", "Asp", "Cys", "Gln", "Glu", "Gly", "His", "Ile", "Leu", "Lys", "Met", "Phe", "Pro", "Ser", "Thr", "Trp", "Tyr", "Val")


def count_methylated(tokens: Column | str) -> Column:
    return F.size(F.filter(_c(tokens), lambda t: t.startswith("Me_")))


def count_noncanonical(tokens: Column | str) -> Column:
    return F.size(F.filter(_c(tokens), lambda t: ~t.isin(*CANONICAL)))


def normalized_source(text: Column | str, pattern: str, replacement: str) -> tuple[Column, Column]:
    """The text with a pattern replaced before hashing, and how often it occurred."""
    return F.regexp_replace(_c(text), pattern, replacement), F.regexp_count(_c(text), F.lit(pattern))
