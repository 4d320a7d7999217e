"""Boston census tracts: Box-Cox target, banded profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.functions.buckets import bucket, cascade
from cadastre.functions.strings import tags
from cadastre.functions.text import Section, Template, delta_phrase, phrase, relative_phrase
from cadastre.operators.neighbors import SearchSpace
from cadastre.plans.recipes.base import Fields, Recipe

# Columns and band tables (upper bounds included).
NUMBERS = ["CRIM", "ZN", "INDUS", "NOX", "RM", "AGE", "DIS", "TAX", "PTRATIO", "B", "LSTAT", "CHAS", "RAD"]
CODES = ["CHAS", "RAD"]
LABELS = {
    "CRIM": "crime rate", "ZN": "residential zoning", "INDUS": "industrial share", "NOX": "nox concentration", "RM": "rooms", "AGE": "building age",
    "DIS": "distance to jobs", "RAD": "highway access index", "TAX": "property tax", "PTRATIO": "pupil-teacher ratio", "B": "B statistic",
    "LSTAT": "lower status share", "CHAS": "charles river access",
}
BANDS = {
    "CRIM": [(1, "low_crime"), (5, "moderate_crime"), (15, "high_crime"), (1e18, "very_high_crime")],
    "ZN": [(5, "low_zoning"), (20, "moderate_zoning"), (50, "high_zoning"), (1e18, "very_high_zoning")],
    "INDUS": [(5, "low_industry"), (12, "moderate_industry"), (20, "high_industry"), (1e18, "very_high_industry")],
    "NOX": [(0.45, "cleaner_air"), (0.55, "moderate_air"), (0.7, "polluted_air"), (1e18, "highly_polluted_air")],
    "RM": [(5.5, "compact_home"), (6.5, "standard_home"), (7.5, "spacious_home"), (1e18, "very_spacious_home")],
    "AGE": [(35, "newer_stock"), (65, "mid_age_stock"), (85, "older_stock"), (1e18, "very_old_stock")],
    "DIS": [(2.5, "very_close_to_jobs"), (5, "close_to_jobs"), (8, "mid_distance_to_jobs"), (1e18, "far_from_jobs")],
    "RAD": [(4, "low_highway_access"), (8, "moderate_highway_access"), (16, "high_highway_access"), (1e18, "very_high_highway_access")],
    "TAX": [(300, "low_tax"), (450, "moderate_tax"), (650, "high_tax"), (1e18, "very_high_tax")],
    "PTRATIO": [(16, "small_class_ratio"), (19, "mid_class_ratio"), (22, "large_class_ratio"), (1e18, "very_large_class_ratio")],
    "B": [(350, "lower_B_stat"), (390, "mid_B_stat"), (395, "higher_B_stat"), (1e18, "very_high_B_stat")],
    "LSTAT": [(7, "low_lstat"), (15, "mid_lstat"), (25, "high_lstat"), (1e18, "very_high_lstat")],
}


def band(f: Fields, name: str, column: str | None = None):
    if name not in BANDS:
        return F.when(f.number(column or name).isNotNull(), "unknown").otherwise("unknown")
    return bucket(f.number(column or name), BANDS[name], closed="right")


def _river(f: Fields):
    return cascade([(f.number("CHAS").cast("int") == 1, "river_bound")], "not_river_bound")


def structured(f: Fields):
    bands = [phrase(f"{c.lower()}_band: ", band(f, c)) for c in BANDS if c in f]
    return Template([phrase("river_relation: ", _river(f)), *bands]).compile()


def semantic(f: Fields):
    signals = tags([
        (f.number("CHAS").cast("int") == 1, "charles_river_premium_proxy"), (f.number("RM") >= 7, "larger_home_signal"),
        (f.number("CRIM") <= 1, "safer_area_signal"), (f.number("PTRATIO") <= 17, "better_school_ratio_signal"),
        (f.number("LSTAT") <= 10, "higher_socioeconomic_area_proxy"),
    ])
    pairs = lambda names: [x for i, (n, c) in enumerate(names) for x in ((", " if i else "") + f"{n}=", band(f, c))]
    return phrase(
        "boston housing profile: river_relation=", _river(f), ", highway_access_band=", band(f, "RAD"), ". neighborhood: ",
        *pairs([("crime_band", "CRIM"), ("zoning_band", "ZN"), ("industry_band", "INDUS"), ("air_quality_band", "NOX"), ("distance_to_jobs_band", "DIS")]),
        ". dwelling: ",
        *pairs([("room_band", "RM"), ("housing_age_band", "AGE"), ("tax_band", "TAX"), ("school_ratio_band", "PTRATIO"), ("B_band", "B"), ("lower_status_band", "LSTAT")]),
        ". signals: ", signals, ".",
    )


def bands_of_neighbors(f: Fields, k: int):
    shown = [phrase(f"rag_mean_{c}_band=", band(f, c, f"rag_mean_{c}"), when=f.number(f"rag_mean_{c}").isNotNull()) for c in NUMBERS]
    shown += [phrase(f"rag_mode_{c}=", f.text(f"rag_mode_{c}")) for c in CODES]
    return Section([F.lit(f"rag_evidence_k={k}"), *shown], sep=" ; ", lead="neighborhood_context: ", tail=".").compile()


def compare(f: Fields, k: int):
    parts = [relative_phrase(f.number(c), f.number(f"rag_mean_{c}"), f"{LABELS[c]} higher than neighbors", f"{LABELS[c]} lower than neighbors", f"{LABELS[c]} comparable to neighbors") for c in NUMBERS]
    parts += [phrase(f"{LABELS[c]} aligned with most neighbors", when=f.text(f"rag_mode_{c}").isNotNull()) for c in CODES]
    return Section(parts, lead="Compared with similar homes: ", tail=".").compile()


def delta(f: Fields, k: int):
    parts = []
    for c in NUMBERS:
        coarse = c not in ("CRIM", "NOX", "CHAS", "RAD")
        to = "neighbor mean" if coarse else "neighbors"
        parts.append(delta_phrase(f.number(c), f.number(f"rag_mean_{c}"), LABELS[c], f"higher than {to}", f"lower than {to}", digits=2 if coarse else 3))
    parts += [phrase(f"{LABELS[c]} consistent with neighbors", when=f.text(f"rag_mode_{c}").isNotNull()) for c in CODES]
    return Section(parts, lead="Relative to neighbors: ", tail=".").compile()


RECIPE = Recipe(
    name="boston", target="MEDV", numeric=NUMBERS, text=[],
    spaces={"hybrid": SearchSpace(NUMBERS, metric="cosine"), "location": SearchSpace([], CODES, metric="cosine", category="onehot")},
    templates={"semantic": semantic, "structured": structured},
    neighbor_texts={"default": bands_of_neighbors, "compare": compare, "delta": delta},
    label="boxcox", error_factor=1000.0, neighbor_text=CODES,
)
