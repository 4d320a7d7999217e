"""Exact quantiles with linear interpolation that never gather a column into one task.

Small inputs use the built-in exact aggregate. Larger ones bracket each wanted rank with
`percentile_approx`, count what lies below the bracket, and fetch only the grouped values
inside it; a bracket that still holds too many distinct values is narrowed again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 50_000
FETCH_CAP = 20_000


def _distinct(base: DataFrame, column: str, low: float, high: float) -> int:
    q = F.col(column)
    return base.filter((q >= low) & (q <= high)).agg(F.approx_count_distinct(q)).first()[0]


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    small_rows: int = SMALL_ROWS,
    fetch_cap: int = FETCH_CAP,
    accuracy: int = 10_000,
) -> dict[str, list[float | None]]:
    """{column: quantiles} over the non-NULL values; None for an empty column."""
    wanted = {c: list(p) for c, p in wanted.items()}
    if not wanted:
        return {}
    base = df.select(*[F.col(f"`{c}`").cast("double").alias(f"q{i}") for i, c in enumerate(wanted)])
    names = {c: f"q{i}" for i, c in enumerate(wanted)}
    margin = 2.0 / accuracy
    guesses = [
        F.percentile_approx(q, [edge for p in wanted[c] for edge in (max(p - margin, 0.0), min(p + margin, 1.0))], F.lit(accuracy)).alias("b" + q)
        for c, q in names.items()
    ]
    counts = base.agg(*[F.count(q).alias(q) for q in names.values()], *guesses).first()
    out: dict[str, list[float | None]] = {}
    small = [c for c in wanted if counts[names[c]] <= small_rows]
    if small:
        row = base.agg(
            *[F.percentile(names[c], F.array(*[F.lit(float(p)) for p in wanted[c]])).alias(names[c]) for c in small]
        ).first()
        for c in small:
            out[c] = list(row[names[c]]) if row[names[c]] is not None else [None] * len(wanted[c])

    large = [c for c in wanted if c not in small]
    pending: dict[tuple[str, int], dict] = {}
    for c in large:
        out[c] = [None] * len(wanted[c])
        n = counts[names[c]]
        for i, p in enumerate(wanted[c]):
            position = p * (n - 1)
            pending[(c, i)] = {"rank": math.floor(position), "fraction": position - math.floor(position),
                               "low": None, "high": None, "size": n, "before": 0,
                               "guess": counts["b" + names[c]][2 * i : 2 * i + 2]}

    while pending:
        # 1. bracket every pending rank inside its current range
        keys = list(pending)
        brackets = []
        for j, (c, i) in enumerate(keys):
            t, q = pending[(c, i)], F.col(names[c])
            if t["guess"] is not None:
                continue
            if t["low"] is not None:
                q = F.when((q >= t["low"]) & (q <= t["high"]), q)
            share = (t["rank"] - t["before"]) / max(t["size"] - 1, 1)
            margin = 2.0 / accuracy
            points = [max(share - margin, 0.0), min(share + margin, 1.0)]
            brackets.append(F.percentile_approx(q, points, F.lit(accuracy)).alias(f"b{j}"))
        row = base.agg(*brackets).first() if brackets else None
        found = {}
        for j, key in enumerate(keys):
            guess = pending[key]["guess"]
            found[f"b{j}"] = guess if guess is not None else row[f"b{j}"]
            pending[key]["guess"] = None
        # 2. how many values lie below each bracket and inside it
        checks = []
        for j, (c, _) in enumerate(keys):
            q, (low, high) = F.col(names[c]), found[f"b{j}"]
            checks += [F.count_if(q < low).alias(f"lt{j}"), F.count_if((q >= low) & (q <= high)).alias(f"in{j}")]
        tally = base.agg(*checks).first()
        ready = []
        for j, key in enumerate(keys):
            t, (low, high) = pending[key], found[f"b{j}"]
            need = t["rank"] + (1 if t["fraction"] > 0 else 0)
            if not (tally[f"lt{j}"] <= t["rank"] and need < tally[f"lt{j}"] + tally[f"in{j}"]):
                accuracy = min(accuracy * 10, 1_000_000)  # the bracket missed a rank: finer sketches
                continue
            t.update(low=low, high=high, before=tally[f"lt{j}"], size=tally[f"in{j}"])
            if low == high:
                out[key[0]][key[1]] = low
                del pending[key]
            elif t["size"] <= fetch_cap or _distinct(base, names[key[0]], low, high) <= fetch_cap:
                ready.append((j, key))
        if not ready:
            continue
        # 3. one job fetches the grouped values of all brackets that are small enough
        # (column number, value) rows against a literal table of brackets: small generated code
        position = {q: i for i, q in enumerate(names.values())}
        table: list[list[tuple[float, float]]] = [[] for _ in position]
        for _, key in ready:
            table[position[names[key[0]]]].append((pending[key]["low"], pending[key]["high"]))
        limits = F.array(*[
            F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in spans or [(1.0, 0.0)]]) for spans in table
        ])
        long = base.select(F.posexplode(F.array(*[F.col(q) for q in position])).alias("i", "v"))
        inside = long.filter(F.exists(limits[F.col("i")], lambda b: (F.col("v") >= b["low"]) & (F.col("v") <= b["high"])))
        fetched: dict[int, list] = {}
        for r in inside.groupBy("i", "v").agg(F.count("*").alias("n")).collect():
            fetched.setdefault(r["i"], []).append((r["v"], r["n"]))
        grouped = {
            j: [(v, n) for v, n in fetched.get(position[names[key[0]]], []) if pending[key]["low"] <= v <= pending[key]["high"]] for j, key in ready
        }
        for j, key in ready:
            t, seen, values = pending[key], pending[key]["before"], {}
            for v, n in sorted(grouped[j]):
                for rank in (t["rank"], t["rank"] + 1):
                    if seen <= rank < seen + n:
                        values[rank] = v
                seen += n
            low = values[t["rank"]]
            high = values.get(t["rank"] + 1, low)
            out[key[0]][key[1]] = low + (high - low) * t["fraction"]
            del pending[key]
    return out


def median(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in columns}).items()}
