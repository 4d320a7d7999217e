"""Melbourne sales: Box-Cox target, market-style texts that compare a home with its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions import numeric, strings
from cadastre.functions.buckets import bucket
from cadastre.functions.text import Section, Template, phrase, relative_phrase
from cadastre.operators.neighbors import SearchSpace
from cadastre.plans.recipes.base import Fields, Recipe

# Columns (the data set's own spellings) and band tables.
AS_OF_YEAR = 2026
NUMBERS = ["Rooms", "Bedroom2", "Bathroom", "Car", "Landsize", "BuildingArea", "YearBuilt", "Distance", "Lattitude", "Longtitude", "Postcode", "Propertycount"]
TEXTS = ["Type", "Method", "SellerG", "CouncilArea", "Regionname", "Suburb"]
SLIM = ["Lattitude", "Longtitude", "Distance", "Landsize", "BuildingArea", "Rooms", "Bathroom"]
DWELLING_BANDS = [(100, "compact dwelling"), (180, "medium-sized dwelling"), (300, "large dwelling")]
LAND_BANDS = [(400, "limited land parcel"), (800, "moderate land parcel"), (1500, "larger land parcel")]
RING_BANDS = [(5, "inner"), (15, "middle-ring"), (1e18, "outer")]
HOME_AGES = [(15, "newer home"), (40, "moderately aged home"), (80, "older home"), (1e18, "old house")]
STOCK_AGES = [(15, "newer housing stock"), (40, "mid-aged housing stock"), (1e18, "older housing stock")]


def prepare(df: DataFrame) -> DataFrame:
    """Title-cased council, null tokens, parts of the sale date; address dropped."""
    new = {"CouncilArea": strings.title_case(strings.null_tokens("CouncilArea"))} if "CouncilArea" in df.columns else {}
    if "Date" in df.columns:
        new |= {f"Sale{n.capitalize()}": c.cast("double") for n, c in numeric.date_parts("Date").items()}
    return df.withColumns(new).drop("Address", "Date")


def _positive(value: Column) -> Column:
    return F.when(value > 0, value)


def _dwelling(value: Column) -> Column:
    return bucket(_positive(value), DWELLING_BANDS, "very large dwelling", missing="dwelling")


def _land(value: Column) -> Column:
    return bucket(_positive(value), LAND_BANDS, "large land parcel", missing="land")


def _age(year: Column) -> Column:
    return numeric.bounded_difference(F.lit(AS_OF_YEAR), _positive(year).cast("int"))


def _kind(f: Fields) -> Column:
    code = F.lower(F.trim(f.text("Type")))
    named = strings.contains_rules(code, [(("house",), "detached house"), (("town",), "townhouse"), (("unit",), "apartment")], "property")
    short = F.when(code == "h", "detached house").when(code == "t", "townhouse").when(code == "u", "apartment")
    return F.coalesce(short, F.when(code.isNotNull(), named), F.lit("property"))


def structured(f: Fields):
    return Template([
        phrase("Located in ", f.text("Suburb")), phrase("property type: ", f.text("Type")), phrase("council area: ", f.text("CouncilArea")),
        phrase("region: ", f.text("Regionname")), phrase(f.whole("Rooms"), " rooms"), phrase(f.whole("Bedroom2"), " bedrooms"),
        phrase(f.whole("Bathroom"), " bathrooms"), phrase(f.whole("Car"), " car spaces"), phrase("land size: ", f.fixed("Landsize", 0), " sqm"),
        phrase("building area: ", f.fixed("BuildingArea", 0), " sqm", when=f.number("BuildingArea") > 0),
        phrase("built in ", f.whole("YearBuilt"), when=f.number("YearBuilt") > 0), phrase(f.fixed("Distance", 1), "km from CBD"),
    ]).compile()


def semantic(f: Fields):
    known = lambda c, other="unknown": F.coalesce(c, F.lit(other))
    return phrase(
        "A ", _kind(f), " in ", known(f.text("Suburb")), ", ", known(f.text("Regionname")), ", council area ", known(f.text("CouncilArea")),
        ". This is a ", _dwelling(f.number("BuildingArea")), " with ", known(f.whole("Rooms"), "?"), " rooms, ", known(f.whole("Bedroom2"), "?"),
        " bedrooms, ", known(f.whole("Bathroom"), "?"), " bathrooms. Located in the ", bucket(f.number("Distance"), RING_BANDS, closed="right"),
        ", built as a ", bucket(_age(f.number("YearBuilt")), HOME_AGES, closed="right"), ". Sits on a ", _land(f.number("Landsize")), ".",
    )


def comparison(f: Fields, k: int):
    size, land, year = (f.number(f"rag_mean_{c}") for c in ("BuildingArea", "Landsize", "YearBuilt"))
    same = F.trim(f.text("CouncilArea")) == F.trim(f.text("rag_mode_CouncilArea"))
    level = "This home is similar in size to nearby properties."
    return Section([
        phrase("Similar nearby homes are typically ", F.regexp_replace(_dwelling(size), " dwelling", " dwellings"), ".", when=size > 0),
        phrase("The neighborhood is characterized by ", _land(land), ".", when=land > 0),
        phrase("Nearby properties are generally ", bucket(_age(year), STOCK_AGES, closed="right"), ".", when=year > 0),
        phrase("Neighboring properties are usually located in the same council area.", when=same),
        F.coalesce(relative_phrase(f.number("BuildingArea"), size, "This home is larger than nearby properties.", "This home is smaller than nearby properties.", level, 0.08, True), F.lit(level)),
        F.when(land > 0, relative_phrase(f.number("Landsize"), land, "It sits on a larger lot than typical in the area.", "It has a more compact lot than nearby homes.", "Lot size is in line with the neighborhood.", 0.08, True)),
    ], sep=" ", lead="Neighborhood context: ", tail=f" (based on {k} nearest neighbors).").compile()


def dump(f: Fields, k: int):
    shown = [phrase(f"rag_mean_{c}=", f.fixed(f"rag_mean_{c}", 3)) for c in NUMBERS[:4] + ["Landsize", "BuildingArea", "Distance", "YearBuilt"]]
    shown += [phrase(f"rag_mode_{c}=", f.text(f"rag_mode_{c}")) for c in ("Suburb", "Type", "CouncilArea", "Regionname")]
    return Section([F.lit(f"rag_evidence_k={k}"), *shown], sep=" ; ", tail=".").compile()


RECIPE = Recipe(
    name="melbourne", target="Price", numeric=NUMBERS, text=TEXTS,
    spaces={"slim": SearchSpace(SLIM, ["Type"], metric="cosine", category="onehot"), "full": SearchSpace(NUMBERS, TEXTS, metric="cosine", category="onehot")},
    templates={"semantic": semantic, "structured": structured}, neighbor_texts={"default": comparison, "dump": dump},
    prepare=prepare, label="boxcox", neighbor_text=["Suburb", "Type", "CouncilArea", "Regionname"],
)
