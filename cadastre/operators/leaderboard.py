"""Result tables: means over seeds, labelled mean and deviation, orderings, best configurations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of the base modes and of the models in printed tables.
MODE_ORDER = (
    "baseline", "emb", "rag", "rag_price", "rag_with_price", "emb+rag", "emb+rag_price",
    "emb_with_rag", "emb_with_rag+rag", "emb_with_rag+rag_price", "emb_with_rag_price",
    "fni", "fni+rag", "fni_with_rag", "fni_dual",
)
MODEL_ORDER = ("gbt", "forest", "linear")

# Configuration fields that decide whether a run of a mode is a best-config run.
MODE_FIELDS = {
    "emb": ("pca_dim",),
    "rag": ("rag_k",),
    "rag_price": ("rag_k",),
    "emb+rag": ("pca_dim", "rag_k"),
    "emb_with_rag": ("rag_pca_dim",),
    "emb_with_rag+rag": ("rag_pca_dim", "rag_k"),
}


def mean_by(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], decimals: int = 6) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.round(F.avg(m), decimals).alias(m) for m in metrics])


def config_label(pca: str = "pca_dim", k: str = "rag_k", rag_pca: str = "rag_pca_dim", fni: str | None = "fni_k") -> Column:
    """p16_k8_rp16, fk5 or both joined by "_"; "-" when neither is complete."""
    tag = lambda name, c: F.concat(F.lit(name), F.col(c).cast("bigint").cast("string"))
    parts = [F.concat(tag("p", pca), tag("_k", k), tag("_rp", rag_pca))]
    if fni:
        parts.append(tag("fk", fni))
    return F.coalesce(F.nullif(F.concat_ws("_", *parts), F.lit("")), F.lit("-"))


def short_decimal(c: Column, decimals: int = 4) -> Column:
    """Rounded to `decimals`, trailing zeros dropped but one digit kept."""
    return F.regexp_replace(F.format_string(f"%.{decimals}f", c), "(\\.\\d+?)0*$", "$1")


def mean_std(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], decimals: int = 4) -> DataFrame:
    """Mean and sample deviation (0 for a single run) as numbers and as a "mean ± std" text."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std")]
    out = df.groupBy(*keys).agg(*aggs)
    shown = lambda c: short_decimal(F.round(F.col(c), decimals), decimals)
    return out.withColumns({f"{m}_text": F.concat(shown(f"{m}_mean"), F.lit(" ± "), shown(f"{m}_std")) for m in metrics})


def mode_rank(mode: str = "mode", order: Sequence[str] = MODE_ORDER) -> Column:
    """Position of the text before "@" in the fixed order; unknown modes last."""
    base = F.split(F.col(mode), "@")[0]
    position = F.array_position(F.array(*[F.lit(m) for m in order]), base)
    return F.when(position == 0, F.lit(len(order) + 1)).otherwise(position).cast("int")


def model_rank(model: str = "model", order: Sequence[str] = MODEL_ORDER) -> Column:
    position = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(model))
    return F.when(position == 0, F.lit(len(order) + 1)).otherwise(position).cast("int")


def in_order(df: DataFrame, mode: str = "mode", model: str = "model") -> DataFrame:
    return df.orderBy(mode_rank(mode), mode, model_rank(model), model)


def best_config(df: DataFrame, group: Sequence[str], val: str, carry: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Row with the smallest validation value per group, its other columns carried along.

    A minimum over a struct: partial aggregation, no sort; ties go to the smallest `ties` columns.
    """
    rest = [c for c in carry if c not in ties]
    pick = F.min(F.struct(val, *ties, *rest)).alias("best")
    rows = df.filter(F.col(val).isNotNull())
    out = rows.groupBy(*group).agg(pick) if group else rows.agg(pick)
    return out.select(*group, *[F.col(f"best.{c}").alias(c) for c in (val, *ties, *rest)])


def keep_best_config(
    results: DataFrame, best: Mapping[str, Mapping[str, int]], mode_fields: Mapping[str, Sequence[str]] = MODE_FIELDS
) -> DataFrame:
    """Runs whose mode-relevant settings equal their model's best configuration.

    Models without an entry and modes without fields keep every run. Both tables are constants,
    so the condition is one literal predicate that can be pushed into a scan.
    """
    keep = F.lit(False)
    known = F.lit(False)
    for model, config in best.items():
        is_model = F.col("model") == model
        known = known | is_model
        passes = ~F.col("mode").isin(*mode_fields)
        for mode, fields in mode_fields.items():
            match = F.col("mode") == mode
            for field in fields:
                match = match & F.col(field).eqNullSafe(F.lit(config[field]))
            passes = passes | match
        keep = keep | (is_model & passes)
    return results.filter(keep | ~known)
