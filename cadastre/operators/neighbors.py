"""Search spaces, stratified search and neighbour features over an edge table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.operators import encode, scale
from cadastre.operators.impute import Fill, fit_median
from cadastre.operators.joins import lookup_join
from cadastre.operators.knn import Limits, knn_join
from cadastre.operators.rows import TRAIN, where
from cadastre.operators.tree_join import TreeLimits, tree_join
from cadastre.session import materialize


@dataclass(frozen=True)
class SearchSpace:
    """Columns that span the distance space.

    `category` says how text columns enter it: "scaled" (ordinal codes standardised together
    with the numbers), "apart" (ordinal codes, unseen = -1, standardised; numbers filled by 0),
    "onehot" (0/1 columns, not scaled; a column of more than `widest` categories stays one column of codes that the
    kernel compares, with the same distances) or "frequency" (training share, not scaled).
    """

    numeric: Sequence[str] = ()
    text: Sequence[str] = ()
    stratify: Sequence[str] = ()
    metric: str = "euclidean"
    category: str = "scaled"
    widest: int = 2_000

    def present(self, df: DataFrame) -> SearchSpace:
        """Only the columns the frame has; an empty space is an error."""
        have = set(df.columns)
        space = replace(
            self,
            numeric=[c for c in self.numeric if c in have],
            text=[c for c in self.text if c in have],
            stratify=list(self.stratify) if all(c in have for c in self.stratify) else [],
        )
        if not space.numeric and not space.text:
            raise ValueError("no column is available for the similarity search")
        return space


@dataclass(frozen=True)
class FittedSpace:
    space: SearchSpace
    fill: object
    ordinals: Mapping[str, encode.Ordinal]
    others: Sequence  # one-hot or frequency encoders
    scaler: scale.Affine
    codes: Mapping[str, encode.Ordinal] = field(default_factory=dict)  # wide one-hot columns

    def with_codes(self, df: DataFrame, out: str = "codes") -> DataFrame:
        """A column with the codes of the wide categories, -1 where unseen."""
        keep = df.columns
        for c, ordinal in self.codes.items():
            df = ordinal.apply(df, f"__c_{c}")
        return df.select(*[F.col(f"`{c}`") for c in keep], F.array(*[F.col(f"`__c_{c}`").cast("double") for c in self.codes]).alias(out))

    def raw(self, df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        """Filled and coded frame, names to scale, names to keep as they are."""
        df = df.withColumns({f"__n_{c}": F.col(f"`{c}`").cast("double") for c in self.space.numeric})
        df = self.fill.apply(df)
        to_scale, plain = [f"__n_{c}" for c in self.space.numeric], []
        for c, ordinal in self.ordinals.items():
            df = ordinal.apply(df, f"__o_{c}")
            to_scale.append(f"__o_{c}")
        for encoder in self.others:
            if isinstance(encoder, encode.OneHot):
                new = {f"__h_{n}": e for n, e in encoder.exprs().items()}
                df = df.withColumns(new)
                plain += list(new)
            else:
                df = encoder.apply(df, f"__f_{encoder.column}")
                plain.append(f"__f_{encoder.column}")
        return df, to_scale, plain

    def apply(self, df: DataFrame, out: str = "features") -> DataFrame:
        keep = df.columns
        coded, to_scale, plain = self.raw(df)
        parts = [self.scaler.expr(c) for c in to_scale] + [F.col(f"`{c}`").cast("double") for c in plain]
        return coded.select(*[F.col(f"`{c}`") for c in keep], F.array(*parts).alias(out))

    def apply_raw(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Unscaled space, for scaling inside strata."""
        keep = df.columns
        coded, to_scale, plain = self.raw(df)
        parts = [F.col(f"`{c}`").cast("double") for c in [*to_scale, *plain]]
        return coded.select(*[F.col(f"`{c}`") for c in keep], F.array(*parts).alias(out))


def fit_space(df: DataFrame, space: SearchSpace, fit_on: str | Column | None = TRAIN) -> FittedSpace:
    space = space.present(df)
    train = where(df, fit_on)
    if space.category == "apart":
        fill = Fill({f"__n_{c}": 0.0 for c in space.numeric})
    else:
        medians = fit_median(train, space.numeric, None).values
        space = replace(space, numeric=[c for c in space.numeric if medians[c] is not None])  # no training value: no distance
        if not space.numeric and not space.text:
            raise ValueError("no column of the search space has a training value")
        fill = Fill({f"__n_{c}": medians[c] for c in space.numeric})
    ordinals, others, codes = {}, [], {}
    if space.category in ("scaled", "apart"):
        unseen = "none" if space.category == "scaled" else "minus_one"
        ordinals = encode.fit_ordinals(train, space.text, unseen, None)
    elif space.category == "onehot":
        counts = encode.value_counts(train, space.text, space.widest)
        others = [encode.OneHot(c, list(found)) for c, found in counts.items() if found is not None]
        codes = encode.fit_ordinals(train, [c for c, found in counts.items() if found is None], "minus_one", None)
        if codes and space.metric != "euclidean":
            raise ValueError(f"{sorted(codes)} have more than {space.widest} categories: use the Euclidean metric")
        if codes and space.stratify:
            raise ValueError(f"{sorted(codes)} have more than {space.widest} categories: search without strata, or raise `widest`")
    elif space.category == "frequency":
        others = [encode.fit_frequency(train, c, None) for c in space.text]
    else:
        raise ValueError(f"unknown category style {space.category!r}")
    fitted = FittedSpace(space, fill, ordinals, others, scale.Affine({}), codes)
    coded, to_scale, _ = fitted.raw(train)
    return replace(fitted, scaler=scale.fit_standard(coded, to_scale, None))


def _stratum_key(columns: Sequence[str]) -> Column:
    """One text key; parts are length-prefixed so different tuples never meet."""
    parts = []
    for c in columns:
        v = encode.text_value(c)
        parts.append(F.concat(F.length(v).cast("string"), F.lit(":"), v))
    return F.concat_ws("|", *parts)


def stratified_edges(
    df: DataFrame, k: int, fitted: FittedSpace, row_id: str, fit_on: str, limits: Limits = Limits(),
) -> DataFrame:
    """Neighbours within the stratum, scaled by the stratum's own training rows.

    Training and validation rows fall back to the global search when their stratum has fewer than
    two training rows, test rows when it has fewer than k. A stratum of 2..k rows gives fewer
    than k neighbours and is not topped up.
    """
    raw = fitted.apply_raw(df.withColumn("__stratum", _stratum_key(fitted.space.stratify)), "__raw")
    raw = raw.select(F.col(row_id).alias("row_id"), "split", "__stratum", "__raw", F.expr(fit_on).alias("__train"))
    width = len(fitted.scaler.params)
    train = raw.filter("__train")
    stats = train.groupBy("__stratum").agg(
        F.count("*").alias("__size"),
        F.array(*[F.avg(F.col("__raw")[i]) for i in range(width)]).alias("__mean"),
        F.array(*[F.stddev_pop(F.col("__raw")[i]) for i in range(width)]).alias("__dev"),
    )
    rows = lookup_join(raw, stats, "__stratum", "left", 64 * (2 + width))
    scaled = F.transform(
        "__raw",
        lambda x, i: F.when(i >= width, x).otherwise(
            (x - F.try_element_at("__mean", i + 1))
            / F.coalesce(F.nullif(F.try_element_at("__dev", i + 1), F.lit(0.0)), F.lit(1.0))
        ),
    )
    rows = rows.withColumn("__own", scaled)
    enough = F.coalesce("__size", F.lit(0)) >= F.when(F.col("split") == "test", k).otherwise(2)
    own = rows.select("row_id", F.col("__stratum").alias("stratum"), F.col("__own").alias("features"), "__train", enough.alias("enough"))
    inside = knn_join(own.filter("enough"), own.filter("__train"), k, by="stratum", limits=limits)
    everywhere = fitted.apply(df.withColumn("row_id", F.col(row_id)), "features")
    lacking = own.filter(~F.col("enough")).select("row_id")
    if lacking.limit(1).count() == 0:
        return inside
    queries = everywhere.join(lacking, "row_id", "left_semi")
    outside = knn_join(queries, where(everywhere, fit_on), k, limits=limits)
    return inside.unionByName(outside)


def neighbor_edges(
    df: DataFrame,
    k: int,
    space: SearchSpace,
    row_id: str = "row_id",
    fit_on: str = TRAIN,
    limits: Limits | TreeLimits = Limits(),
) -> DataFrame:
    """Edges from every row to its k nearest training rows in the given space.

    The search runs through cells, which compare categories by codes too, or through a tree of pivots: where `TreeLimits` are
    given without such categories, and where the candidates would outgrow the cells.

    One table serves all splits and all smaller k (`rank <= k`). The columns of the space are
    stored first, so that the fits and the search do not repeat the plan behind `df`.
    """
    space = space.present(df)
    used = dict.fromkeys([row_id, *(["split"] if "split" in df.columns else []), *space.numeric, *space.text, *space.stratify])
    flagged = df.select(*[F.col(f"`{c}`") for c in used], F.expr(fit_on).alias("__fit"))
    df, fit_on = materialize(flagged, "space"), "__fit"
    fitted = fit_space(df, space, fit_on)
    if fitted.space.stratify:
        return stratified_edges(df, k, fitted, row_id, fit_on, limits)
    points = fitted.apply(df, "features").select(
        F.col(row_id).alias("row_id"), "features", *fitted.codes and [F.col(f"`{c}`") for c in space.text], F.expr(fit_on).alias("__train")
    )
    if fitted.codes:
        points = fitted.with_codes(points).select("row_id", "features", "codes", "__train")
    candidates = points.filter("__train")
    if fitted.codes:
        blocks = limits.blocks() if isinstance(limits, TreeLimits) else limits
        return knn_join(points, candidates, k, limits=blocks, codes_col="codes")
    if isinstance(limits, TreeLimits) or (fitted.space.metric == "euclidean" and candidates.count() > limits.max_pivots * limits.cell_rows):
        tree = limits if isinstance(limits, TreeLimits) else TreeLimits(limits.cell_rows, block_rows=limits.block_rows, query_rows=limits.query_rows)
        return tree_join(points, candidates, k, metric=fitted.space.metric, limits=tree)
    return knn_join(points, points.filter("__train"), k, metric=fitted.space.metric, limits=limits)


def neighbor_features(
    edges: DataFrame,
    source: DataFrame,
    row_id: str,
    numeric: Sequence[str] = (),
    text: Sequence[str] = (),
    target: str | None = None,
    k: int | None = None,
    mean_name: str = "rag_mean_{}",
    mode_name: str = "rag_mode_{}",
    price_name: str = "neighbour_price",
) -> DataFrame:
    """Per query: mean of numbers (NULLs skipped), most frequent text (smallest on a tie), mean target.

    Every group holds at most k edges. Rows without neighbours are absent: left-join the result.
    """
    if k is not None:
        edges = edges.filter(F.col("rank") <= k)
    wanted = [*numeric, *text] + ([target] if target and target not in numeric else [])
    attributes = source.select(F.col(row_id).alias("neighbor_id"), *[F.col(f"`{c}`") for c in wanted])
    joined = lookup_join(edges.select("query_id", "neighbor_id"), attributes, "neighbor_id", "inner", 64 * (1 + len(wanted)))
    aggs = [F.avg(F.col(f"`{c}`").cast("double")).alias(mean_name.format(c)) for c in numeric]
    aggs += [F.mode(F.col(f"`{c}`").cast("string"), True).alias(mode_name.format(c)) for c in text]
    if target:
        aggs.append(F.avg(F.col(f"`{target}`").cast("double")).alias(price_name))
    return joined.groupBy("query_id").agg(*aggs)


def neighbor_gap(df: DataFrame, own: str, mean: str, out: str) -> DataFrame:
    """Own value minus the neighbours' mean."""
    return df.withColumn(out, F.col(own).cast("double") - F.col(mean))


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First k rows of every group; the ranking is pruned before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)
