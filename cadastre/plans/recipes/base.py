"""A recipe names what is special about a data set; `run` is the same for all of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastre.functions import numeric, strings
from cadastre.functions.text import append
from cadastre.operators import boxcox, encode, impute, interactions, models, neighbors, rows, scale, split, vectors
from cadastre.operators.neighbors import SearchSpace
from cadastre.session import materialize
from cadastre.sources import vector_store


class Fields:
    """Columns of a frame by name; an absent column reads as NULL, so its clauses vanish."""

    def __init__(self, df: DataFrame):
        self.types = dict(df.dtypes)

    def __contains__(self, name: str) -> bool:
        return name in self.types

    def number(self, name: str) -> Column:
        return F.col(f"`{name}`").cast("double") if name in self.types else F.lit(None).cast("double")

    def text(self, name: str) -> Column:
        return F.col(f"`{name}`").cast("string") if name in self.types else F.lit(None).cast("string")

    def whole(self, name: str) -> Column:
        return strings.show_int(self.number(name))

    def fixed(self, name: str, decimals: int) -> Column:
        return strings.show_fixed(self.number(name), decimals)


@dataclass(frozen=True)
class Recipe:
    name: str
    target: str
    numeric: Sequence[str]
    text: Sequence[str]
    spaces: Mapping[str, SearchSpace]
    templates: Mapping[str, Callable[[Fields], Column]]
    neighbor_texts: Mapping[str, Callable[[Fields, int], Column]]
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df  # before the split: parsing, null tokens
    derive: Callable[[DataFrame], DataFrame] = lambda df: df  # after the fills
    ratios: Callable[[DataFrame], DataFrame] = lambda df: df  # derived columns that need a median fill
    ratio_columns: Sequence[str] = ()
    leaking: Sequence[str] = ()
    key: str | None = None
    label: str = "log"  # "log" or "boxcox"
    target_scale: str | None = None  # size column the target is divided by
    error_factor: float = 1.0
    interaction_columns: Sequence[str] = ()
    geo: Sequence[str] = ()
    neighbor_numeric: Sequence[str] = field(default_factory=tuple)
    neighbor_text: Sequence[str] = field(default_factory=tuple)


def hash_keyed(df: DataFrame, bits: int = 64) -> DataFrame:
    """`df` (without repeated rows) with a unique `row_id`: a hash of the row, cut to `bits` bits in tests."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    hashed = lambda *salt: F.shiftright(F.xxhash64(*cells, *salt), 64 - bits) if bits < 64 else F.xxhash64(*cells, *salt)
    df = materialize(df.withColumns({"row_id": hashed(), "__second": F.xxhash64(*cells, F.lit("second"))}), "keyed")
    while True:
        shared = df.groupBy("row_id").agg(F.count("*").alias("n")).filter("n > 1").select("row_id")
        if shared.isEmpty():
            return df.drop("__second")
        place = F.row_number().over(Window.partitionBy("row_id").orderBy("__second"))  # the few rows of one hash
        moved = df.join(shared, "row_id", "left_semi").withColumn("__place", place)
        moved = moved.withColumn("row_id", F.when(F.col("__place") > 1, F.xxhash64("row_id", "__second", "__place")).otherwise(F.col("row_id"))).drop("__place")
        df = materialize(df.join(shared, "row_id", "left_anti").unionByName(moved), "keyed")


def clean(recipe: Recipe, raw: DataFrame, seed: int = 42, ratio: float | None = None) -> DataFrame:
    """Deduplicated, keyed, split, filled and derived rows (stored once).

    Without a key column the key is a hash of the whole row, which does not depend on row order; different
    rows that share it are told apart by their order under a second hash.
    """
    df = rows.dedup(recipe.prepare(numeric.nan_to_null(raw)))
    if recipe.key and recipe.key in df.columns:
        df = df.withColumn("row_id", F.col(recipe.key).cast("bigint"))
    else:
        df = hash_keyed(df)
    if ratio is not None and ratio < 1:
        df = split.exact_sample(df, "row_id", ratio, seed=seed)
    df = materialize(split.hash_split(df, "row_id", seed), "raw")
    present = set(df.columns)
    others = rows.pick_number_columns(df, ["row_id", recipe.target, *recipe.leaking, *([recipe.key] if recipe.key else [])])
    numbers = list(dict.fromkeys([*(c for c in recipe.numeric if c in present), *others]))  # derived sums need every number
    df = impute.fit_clean(df, numbers, [c for c in recipe.text if c in present]).apply(df)
    if recipe.ratio_columns:
        df = materialize(recipe.ratios(df), "ratios")
        df = impute.fit_median(df, recipe.ratio_columns).apply(df)
    if recipe.geo:
        df = vectors.fit_geo_clusters(df, recipe.geo)(df)
    return materialize(recipe.derive(df), "clean")


def texts(recipe: Recipe, df: DataFrame, template: str, neighbor_template: str | None = None, k: int = 0) -> Column:
    fields = Fields(df)
    base = recipe.templates[template](fields)
    if neighbor_template is None:
        return base
    return append(base, recipe.neighbor_texts[neighbor_template](fields, k))


def run(
    recipe: Recipe,
    raw: DataFrame,
    modes: str = "baseline,rag",
    families: Sequence[str] = ("gbt", "forest", "linear"),
    space: str | None = None,
    k: int = 12,
    template: str | None = None,
    neighbor_template: str | None = None,
    dims: int = 16,
    vector_dims: int = 256,
    reduction: str = "svd",
    store: DataFrame | None = None,
    model_name: str = "local",
    seed: int = 42,
    ratio: float | None = None,
    options: Mapping[str, Mapping] | None = None,
    early_stopping: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(results, predictions) of the chosen modes; only the feature groups they need are built."""
    names = models.parse_modes(modes)
    needed = models.needed_groups(names)
    df = clean(recipe, raw, seed, ratio)
    base_numbers = [c for c in rows.pick_number_columns(df, ["row_id", recipe.target, *recipe.leaking])]
    base_texts = rows.pick_text_columns(df, ["split", *recipe.leaking])
    features = df
    for column, ordinal in encode.fit_ordinals(df, base_texts, "minus_one").items():
        features = ordinal.apply(features, f"code_{column}")
    groups: dict[str, list[str]] = {"base": [*base_numbers, *[f"code_{c}" for c in base_texts]]}

    if needed & {"rag", "price", "emb_rag", "fni_with_rag", "fni_rag"}:
        chosen = recipe.spaces[space or next(iter(recipe.spaces))]
        numbers = [c for c in (recipe.neighbor_numeric or recipe.numeric) if c in df.columns]
        labels = [c for c in (recipe.neighbor_text or recipe.text) if c in df.columns]
        edges = neighbors.neighbor_edges(df, k, chosen)
        near = neighbors.neighbor_features(edges, df, "row_id", numbers, labels, recipe.target)
        features = materialize(rows.join_blocks([features, near.withColumnRenamed("query_id", "row_id")]), "neighbors")
        means, mode_columns = [f"rag_mean_{c}" for c in numbers], [f"rag_mode_{c}" for c in labels]
        encoded = features
        for column, ordinal in encode.fit_ordinals(features, mode_columns, "zero").items():
            encoded = ordinal.apply(encoded, f"code_{column}")
        features = impute.fit_median(features, [*means, "neighbour_price"]).apply(encoded)
        groups["rag"] = [*means, *[f"code_{c}" for c in mode_columns]]
        groups["price"] = ["neighbour_price"]

    for group, with_neighbors in (("emb", False), ("emb_rag", True)):
        if group not in needed:
            continue
        chosen_template = template or next(iter(recipe.templates))
        appendix = (neighbor_template or next(iter(recipe.neighbor_texts))) if with_neighbors else None
        written = features.select("row_id", "split", strings.sanitize(texts(recipe, features, chosen_template, appendix, k)).alias("text"))
        known = store if store is not None else written.select(F.lit("").alias("key"), vectors.zero_vector(vector_dims).alias("vector")).limit(0)
        filled = materialize(vector_store.complete(written, known, model_name, vector_dims), "vectors")
        unit = filled.select("row_id", "split", scale.l2_normalize("vector").alias("vector"))
        fit = vectors.fit_svd if reduction == "svd" else vectors.fit_pca
        reduced = vectors.to_columns(fit(unit, "vector", dims).apply(unit, "vector"), "reduced", dims, f"{group}_")
        columns = [f"{group}_{i}" for i in range(dims)]
        features = features.join(reduced.select("row_id", *columns), "row_id", "left")
        groups[group] = columns

    wanted = [c for c in (recipe.interaction_columns or base_numbers) if c in features.columns]
    if needed & {"fni", "fni_with_rag", "fni_rag"}:
        features = materialize(features, "features")
        means = groups.get("rag", [])
        scaled = scale.fit_standard(features, [*wanted, *means]).apply(features, "__z")
        scaled = scaled.withColumn("__log_target", numeric.log_floor(F.col(recipe.target).cast("double")))
        plans = {"fni": wanted, "fni_rag": means, "fni_with_rag": [*wanted, *means]}
        for group, columns in plans.items():
            if group in needed and len(columns) >= 2:
                fitted = interactions.fit_interactions(scaled, [f"{c}__z" for c in columns], "__log_target", prefix=f"{group}_")
                scaled = fitted.apply(scaled)
                groups[group] = fitted.names
        features = scaled

    size = F.col(recipe.target_scale) if recipe.target_scale else F.lit(1.0)
    unit_price = F.try_divide(F.col(recipe.target).cast("double"), size.cast("double"))
    if recipe.label == "boxcox":
        fitted_label = boxcox.fit_boxcox(features.withColumn("__unit", unit_price), "__unit")
        features = fitted_label.apply(features.withColumn("__label_in", unit_price).withColumnRenamed("__label_in", "__unit"), "__label_out")
        undo = fitted_label.undo
    else:
        features, undo = features.withColumn("__label_out", numeric.log_floor(unit_price)), numeric.unlog
    return models.run_modes(
        features, groups, names, families, "__label_out", recipe.target, undo, scale=recipe.target_scale, seed=seed,
        factor=recipe.error_factor, options=options, early_stopping=early_stopping,
    )
