"""Brazilian rentals: log target, cost columns that would leak are dropped from the features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.functions import numeric, strings
from cadastre.functions.buckets import bucket
from cadastre.functions.text import Section, Template, phrase
from cadastre.operators.neighbors import SearchSpace
from cadastre.plans.recipes.base import Fields, Recipe

# Columns and band tables (upper bounds included).
TEXTS = ["city", "floor", "animal", "furniture"]
NUMBERS = ["area", "rooms", "bathroom", "parking_spaces", "floor_is_unknown"]
COSTS = ["hoa", "rent_amount", "property_tax", "fire_insurance"]
AREA_BANDS = [(50, "compact"), (100, "medium"), (200, "spacious"), (1e18, "very_spacious")]
RENT_BANDS = [(2000, "budget"), (5000, "mid_range"), (10000, "premium"), (1e18, "luxury")]
HOA_BANDS = [(500, "low"), (1500, "medium"), (3000, "high"), (1e18, "very_high")]


def prepare(df: DataFrame) -> DataFrame:
    """Null tokens in text, unknown floors flagged and set to "0", numbers read from text, costs dropped."""
    new = {c: strings.null_tokens(c) for c in TEXTS if c in df.columns}
    new |= {c: numeric.coerce_number(c, floor=0) for c in [*NUMBERS, "total"] if c in df.columns}
    df = df.drop(*COSTS).withColumns(new)
    return df.withColumns({"floor_is_unknown": strings.missing_flag("floor").cast("double"), "floor": F.coalesce("floor", F.lit("0"))})


def structured(f: Fields):
    return Template([
        phrase("Located in ", f.text("city")), phrase("floor: ", f.text("floor")), phrase("animal policy: ", f.text("animal")),
        phrase("furniture: ", f.text("furniture")), phrase("area: ", f.fixed("area", 0), " sqm"), phrase(f.whole("rooms"), " rooms"),
        phrase(f.whole("bathroom"), " bathrooms"), phrase(f.whole("parking_spaces"), " parking spaces"), phrase("HOA: ", f.fixed("hoa", 2)),
        phrase("rent: ", f.fixed("rent_amount", 2)), phrase("property tax: ", f.fixed("property_tax", 2)), phrase("fire insurance: ", f.fixed("fire_insurance", 2)),
    ]).compile()


def semantic(f: Fields):
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    room = F.when((f.number("area") > 0) & (f.number("rooms") > 0), numeric.safe_ratio(f.number("area"), f.number("rooms")))
    rent, hoa = (bucket(f.number(c), bands, closed="right") for c, bands in (("rent_amount", RENT_BANDS), ("hoa", HOA_BANDS)))
    signals = strings.tags([
        (room > 50, "spacious_per_room"), (room < 25, "compact_per_room"), (f.text("animal") == "accept", "pet_friendly"),
        (f.text("furniture") == "furnished", "furnished_property"), (f.number("parking_spaces") >= 2, "multiple_parking"),
        (rent.isin("premium", "luxury"), "premium_rental"), (hoa == "low", "low_maintenance_cost"),
    ])
    return phrase(
        "rental property profile: city=", known(f.text("city")), ", floor=", known(f.text("floor")), ", animal_policy=", known(f.text("animal")),
        ", furniture=", known(f.text("furniture")), ". structure: area=", bucket(f.number("area"), AREA_BANDS, closed="right"),
        ", rooms=", known(f.whole("rooms")), ", bathrooms=", known(f.whole("bathroom")), ", parking_spaces=", known(f.whole("parking_spaces")),
        ". costs: rent_band=", rent, ", hoa_band=", hoa, ", property_tax=", known(f.fixed("property_tax", 2)),
        ", fire_insurance=", known(f.fixed("fire_insurance", 2)), ". signals: ", signals, ".",
    )


def dump(f: Fields, k: int):
    shown = [phrase(f"rag_mean_{c}=", f.fixed(f"rag_mean_{c}", 3)) for c in [*NUMBERS[:4], *COSTS]]
    shown += [phrase(f"rag_mode_{c}=", f.text(f"rag_mode_{c}")) for c in TEXTS]
    return Section([F.lit(f"rag_evidence_k={k}"), *shown], sep=" ; ", lead="neighborhood_context: ", tail=".").compile()


RECIPE = Recipe(
    name="brazil", target="total", numeric=NUMBERS, text=TEXTS,
    spaces={"hybrid": SearchSpace(NUMBERS, TEXTS, metric="cosine", category="onehot"), "frequency": SearchSpace(NUMBERS, TEXTS, metric="cosine", category="frequency")},
    templates={"semantic": semantic, "structured": structured}, neighbor_texts={"default": dump}, prepare=prepare,
)
