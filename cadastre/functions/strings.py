"""Text column functions: normalising, null tokens, lookups, tags and value formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastre.functions.buckets import cascade
from cadastre.functions.numeric import col

# Spellings of a missing entry in raw text columns.
NULL_TOKENS = ("-", "", "nan", "None", "null", "NULL")

CONTROL_CHARACTERS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def title_case(c: str | Column) -> Column:
    """Trim, then upper-case the first letter after every non-letter (so "O'Neil", "Port-Phillip")."""
    spaced = F.regexp_replace(F.trim(col(c).cast("string")), "([^\\p{L}]+)", "$1\u0001 ")
    return F.regexp_replace(F.initcap(spaced), "\u0001 ", "")


def null_tokens(c: str | Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Trimmed text, with the listed tokens mapped to NULL."""
    trimmed = F.trim(col(c).cast("string"))
    return F.when(~trimmed.isin(*tokens), trimmed)


def missing_flag(c: str | Column) -> Column:
    return col(c).isNull().cast("int")


def lookup(key: str | Column, table: Mapping[str, str | int | float], default) -> Column:
    """Value of a small fixed table, `default` for a missing or unlisted key."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), col(key)), F.lit(default))


def contains_rules(c: str | Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """First rule with any of its fragments inside the text wins."""
    c = col(c)
    checks = []
    for fragments, label in rules:
        condition = F.lit(False)
        for fragment in fragments:
            condition = condition | c.contains(fragment)
        checks.append((condition, label))
    return cascade(checks, default)


def tags(rules: Sequence[tuple[Column, str]], empty: str = "neutral_signals") -> Column:
    """Names of the rules that hold, joined by blanks; `empty` if none does."""
    joined = F.concat_ws(" ", *[F.when(condition, F.lit(name)) for condition, name in rules])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(empty))


def show_number(c: str | Column, missing: str = "unknown") -> Column:
    """Missing -> "unknown", whole numbers without decimals, others with two."""
    c = col(c).cast("double")
    text = F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(F.format_string("%.2f", c))
    return F.when(c.isNull() | F.isnan(c), F.lit(missing)).otherwise(text)


def show_fixed(c: str | Column, decimals: int) -> Column:
    """Fixed decimals; NULL stays NULL."""
    c = col(c).cast("double")
    return F.when(c.isNotNull(), F.format_string(f"%.{decimals}f", c))


def show_int(c: str | Column) -> Column:
    """Truncated to a whole number, as text; NULL stays NULL."""
    return col(c).cast("double").cast("bigint").cast("string")


def sanitize(c: str | Column) -> Column:
    """Valid text without control characters (line feed, carriage return and tab stay)."""
    return F.regexp_replace(col(c), CONTROL_CHARACTERS, "")
