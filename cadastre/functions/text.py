"""Row-to-text templates: a template is data and compiles to one `concat_ws` expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Piece = str | Column


def phrase(*pieces: Piece, when: Column | None = None) -> Column:
    """Pieces glued together; NULL if any column piece is NULL or the condition does not hold."""
    glued = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    return glued if when is None else F.when(when, glued)


@dataclass(frozen=True)
class Section:
    """A list of clauses joined by `sep`; vanishes when every clause is NULL."""

    clauses: Sequence[Column]
    sep: str = ", "
    lead: str = ""
    tail: Piece = ""

    def compile(self) -> Column:
        joined = F.nullif(F.concat_ws(self.sep, *self.clauses), F.lit(""))
        tail = F.lit(self.tail) if isinstance(self.tail, str) else self.tail
        return F.concat(F.lit(self.lead), joined, tail)


@dataclass(frozen=True)
class Template:
    """Sections joined by `sep`, closed by `end`; `empty` when nothing is left."""

    sections: Sequence[Section | Column]
    sep: str = ". "
    end: str = "."
    empty: str | None = None

    def compile(self) -> Column:
        parts = [s.compile() if isinstance(s, Section) else s for s in self.sections]
        joined = F.concat_ws(self.sep, *parts)
        if self.empty is not None:
            return F.when(joined == "", F.lit(self.empty)).otherwise(F.concat(joined, F.lit(self.end)))
        return F.concat(joined, F.lit(self.end))


def append(base: Column, extra: Column, sep: str = " ") -> Column:
    """`base`, followed by `extra` where it is not NULL."""
    return F.concat_ws(sep, base, extra)


# ---- neighbour phrases -------------------------------------------------------------------


def relative_phrase(
    own: Column,
    mean: Column,
    over: Piece,
    under: Piece,
    level: Piece,
    tolerance: float = 0.05,
    inclusive: bool = False,
) -> Column:
    """Compare a row with its neighbours' mean.

    Default rule: strictly more than `tolerance` of the mean away; a non-positive mean counts
    as level. Inclusive rule: ratio at or past 1 +- tolerance; only a zero mean is level.
    NULL when either side is missing.
    """
    lit = lambda p: F.lit(p) if isinstance(p, str) else p
    if inclusive:
        usable = mean != 0
        ratio = F.try_divide(own, mean + F.lit(1e-9))
        above, below = ratio >= 1 + tolerance, ratio <= 1 - tolerance
    else:
        usable = mean >= 1e-12
        gap = F.try_divide(own - mean, mean)
        above, below = gap > tolerance, gap < -tolerance
    return (
        F.when(own.isNull() | mean.isNull(), F.lit(None).cast("string"))
        .when(usable & above, lit(over))
        .when(usable & below, lit(under))
        .otherwise(lit(level))
    )


def delta_phrase(
    own: Column,
    mean: Column,
    label: str,
    up: str,
    down: str,
    shown: Column | None = None,
    digits: int = 0,
    lead: str | None = None,
) -> Column:
    """Absolute difference to the neighbours' mean with a direction; on par below 1e-6."""
    delta = own - mean
    if shown is None:
        size = F.bround(F.abs(delta), digits)
        shown = size.cast("bigint").cast("string") if digits == 0 else size.cast("string")
    return (
        F.when(delta.isNull(), F.lit(None).cast("string"))
        .when(F.abs(delta) < 1e-6, F.lit(f"{label} on par with neighbor mean"))
        .otherwise(
            F.concat(
                F.lit(f"{lead if lead is not None else label} "),
                shown,
                F.when(delta > 0, F.lit(f" {up}")).otherwise(F.lit(f" {down}")),
            )
        )
    )
