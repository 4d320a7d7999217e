"""Iowa single-family sales: price per quality-weighted size, learnt in log space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.functions import numeric, strings
from cadastre.functions.buckets import bucket, cascade
from cadastre.functions.text import Section, Template, delta_phrase, phrase, relative_phrase
from cadastre.operators.neighbors import SearchSpace
from cadastre.plans.recipes.base import Fields, Recipe

# Column lists, labels, words and thresholds of this data set.
NUMBERS = ["OverallQual", "GrLivArea", "TotalBsmtSF", "GarageCars", "GarageArea", "YearBuilt", "YearRemodAdd",
           "FullBath", "TotRmsAbvGrd", "LotArea", "1stFlrSF", "2ndFlrSF"]
TEXTS = ["Neighborhood", "KitchenQual"]
LABELS = {"OverallQual": "quality", "GrLivArea": "area", "TotalBsmtSF": "basement area", "GarageCars": "garage cars",
          "GarageArea": "garage area", "YearBuilt": "year built", "YearRemodAdd": "year remodeled", "FullBath": "full baths",
          "TotRmsAbvGrd": "rooms", "LotArea": "lot area", "1stFlrSF": "1st flr area", "2ndFlrSF": "2nd flr area",
          "Neighborhood": "neighborhood", "KitchenQual": "kitchen quality"}
AREAS = ["GrLivArea", "TotalBsmtSF", "LotArea", "GarageArea", "1stFlrSF", "2ndFlrSF"]
YEARS = {"YearBuilt": "built", "YearRemodAdd": "remodeled"}
QUALITY_WORDS = {"Ex": "Excellent", "Gd": "Good", "TA": "Average", "Fa": "Fair", "Po": "Poor"}
AREA_BANDS = [(900, "compact"), (1500, "cozy"), (2200, "spacious"), (3200, "very spacious")]
YEAR_BANDS = [(1940, "pre-war"), (1970, "mid-century"), (2000, "modern")]
SPACES = {
    "hybrid": SearchSpace(NUMBERS, TEXTS),
    "quality_year": SearchSpace(["OverallQual", "OverallCond", "YearBuilt", "YearRemodAdd"],
                                ["ExterQual", "KitchenQual", "BsmtQual", "HeatingQC", "GarageQual", "GarageCond"]),
    "location": SearchSpace([], ["Neighborhood", "MSZoning", "Condition1", "Condition2", "Street", "LotConfig", "LandContour", "LandSlope"]),
    "stratified_neighborhood": SearchSpace(["GrLivArea", "TotalBsmtSF", "GarageArea", "OverallQual", "YearBuilt"], stratify=["Neighborhood"]),
    "stratified_bldg": SearchSpace(NUMBERS, stratify=["BldgType", "HouseStyle"]),
}


def derive(df: DataFrame) -> DataFrame:
    c = F.col
    df = df.withColumns({
        "TotalBath": numeric.weighted_sum({"FullBath": 1, "HalfBath": 0.5, "BsmtFullBath": 1, "BsmtHalfBath": 0.5}),
        "HasPool": numeric.flag(c("PoolArea") > 0), "Has2ndFloor": numeric.flag(c("`2ndFlrSF`") > 0),
        "HasGarage": numeric.flag(c("GarageArea") > 0), "HasBsmt": numeric.flag(c("TotalBsmtSF") > 0),
        "HasFireplace": numeric.flag(c("Fireplaces") > 0),
        "BuildingAge": numeric.bounded_difference("YrSold", "YearBuilt"), "RemodAge": c("YrSold") - c("YearRemodAdd"),
        "TotalSF": numeric.weighted_sum({"1stFlrSF": 1, "2ndFlrSF": 1, "TotalBsmtSF": 1, "GrLivArea": 1}),
        "IsRemodeled": numeric.flag(c("YearBuilt") != c("YearRemodAdd")),
        "TotalPorch": numeric.weighted_sum({"OpenPorchSF": 1, "EnclosedPorch": 1, "3SsnPorch": 1, "ScreenPorch": 1}),
    })
    return df.withColumns({
        "IsNew": numeric.flag(c("BuildingAge") <= 2), "OverallQual_TotalSF": c("OverallQual") * c("TotalSF"),
        "OverallQual_GrLivArea": c("OverallQual") * c("GrLivArea"),
    })


def _remodeled(f: Fields):
    return ~f.number("YearRemodAdd").eqNullSafe(f.number("YearBuilt"))


def structured(f: Fields):
    return Template([
        Section([phrase("neighborhood ", f.text("Neighborhood"))]),
        Section([
            phrase(f.whole("BedroomAbvGr"), " bedrooms, ", f.whole("FullBath"), " full baths"),
            phrase(f.whole("GrLivArea"), " sqft living area (", bucket(f.number("GrLivArea"), AREA_BANDS, "estate-sized"), ")"),
            phrase("built ", f.whole("YearBuilt"), " (", bucket(f.number("YearBuilt"), YEAR_BANDS, "recent"), ")"),
            phrase("remodeled ", f.whole("YearRemodAdd"), when=_remodeled(f)),
        ]),
        Section([
            phrase(f.whole("GarageCars"), "-car garage", when=f.number("GarageCars") > 0),
            phrase(f.whole("Fireplaces"), " fireplace(s)", when=f.number("Fireplaces") > 0),
            phrase("kitchen quality ", strings.lookup(f.text("KitchenQual"), QUALITY_WORDS, "Average"), when=f.text("KitchenQual").isNotNull()),
        ]),
        Section([
            phrase("overall quality ", strings.show_number(f.number("OverallQual")), "/10", when=f.number("OverallQual").isNotNull()),
            phrase("condition ", strings.show_number(f.number("OverallCond")), "/10", when=f.number("OverallCond").isNotNull()),
        ]),
    ]).compile()


def descriptive(f: Fields):
    quality = f.number("OverallQual")
    renewed = _remodeled(f) & f.number("YearBuilt").isNotNull() & f.number("YearRemodAdd").isNotNull()
    grade = cascade([(quality >= 8, "excellent"), (quality >= 6, "good"), (quality >= 4, "average")], "fair")
    impact = cascade([(quality >= 8, "significantly drives the property value"), (quality >= 6, "strongly impacts the home's worth"),
                      (quality >= 4, "affects the market price")], "influences the property value")
    note = cascade([(renewed, ", increasing its value.")], ", with location being a major price factor.")
    return Template([
        Section([
            phrase("located in ", f.text("Neighborhood")), phrase("a ", f.text("HouseStyle")),
            phrase("built in ", f.whole("YearBuilt")), phrase("renovated in ", f.whole("YearRemodAdd"), when=renewed),
        ], lead="This property is ", tail=note),
        Section([
            phrase(f.whole("BedroomAbvGr"), " bedrooms and ", f.whole("FullBath"), " bathrooms"), phrase(f.whole("GrLivArea"), " sqft living space"),
        ], lead="It features ", tail=", with size being a key price factor."),
        phrase("Overall quality is ", grade, " (rated ", strings.show_number(quality), "/10), which ", impact, ".", when=quality.isNotNull()),
        Section([
            phrase(f.whole("GarageCars"), "-car garage", when=f.number("GarageCars") > 0),
            phrase(f.whole("TotalBsmtSF"), " sqft basement", when=f.number("TotalBsmtSF") > 0),
        ], lead="It includes ", tail=", adding value."),
        Section([
            phrase(f.whole("Fireplaces"), " fireplace(s)", when=f.number("Fireplaces") > 0), phrase("pool", when=f.number("HasPool") > 0),
        ], lead="Premium features include ", tail=", increasing the property's value."),
    ], sep=" ", end="", empty="This property's value is determined by location, size, and quality.").compile()


def _or_unknown(f: Fields, name: str):
    return F.coalesce(f.text(name), F.lit("unknown"))


def compact_core(f: Fields):
    return Template([
        phrase("Neighborhood ", _or_unknown(f, "Neighborhood")), phrase("OverallQual ", f.whole("OverallQual"), "/10"),
        phrase("GrLivArea ", f.whole("GrLivArea"), " sqft"), phrase("YearBuilt ", f.whole("YearBuilt")),
        phrase("GarageCars ", f.whole("GarageCars")), phrase("KitchenQual ", f.text("KitchenQual")),
    ]).compile()


def location_quality(f: Fields):
    return Template([
        phrase("Home in ", _or_unknown(f, "Neighborhood"), ", zoning ", _or_unknown(f, "MSZoning")),
        phrase("quality ", f.whole("OverallQual"), "/10"), phrase("condition ", f.whole("OverallCond"), "/10"),
        phrase("lot ", f.whole("LotArea"), " sqft"), phrase("last remodel ", f.whole("YearRemodAdd")),
    ]).compile()


def size_age(f: Fields):
    return Template([
        phrase("Living area ", f.whole("GrLivArea"), " sqft"), phrase("Basement ", f.whole("TotalBsmtSF"), " sqft"),
        phrase("Floor split ", f.whole("1stFlrSF"), " + ", f.whole("2ndFlrSF"), " sqft"), phrase("Built ", f.whole("YearBuilt")),
        phrase("Remodeled ", f.whole("YearRemodAdd")), phrase("FullBath ", f.whole("FullBath")),
    ]).compile()


def _suffix(k: int) -> str:
    return f". (based on k={k} nearest neighbors)."


def averages(f: Fields, k: int):
    shown = []
    for c in NUMBERS:
        plain = c in AREAS or c in YEARS
        shown.append(phrase(f"{c} ", f.fixed(f"rag_mean_{c}", 0 if plain else 2), " sqft" if c in AREAS else ""))
    shown += [phrase(f"{c} ", f.text(f"rag_mode_{c}")) for c in TEXTS]
    return Section(shown, lead="Similar homes (avg): ", tail=_suffix(k)).compile()


def compare(f: Fields, k: int):
    parts = [relative_phrase(f.number(c), f.number(f"rag_mean_{c}"), *[f"{LABELS[c]} {w} {p} neighbors" for w, p in
             (("larger", "than"), ("smaller", "than"), ("comparable", "to"))]) for c in NUMBERS]
    parts += [phrase(f"{LABELS[c]} consistent with majority of neighbors", when=f.text(f"rag_mode_{c}").isNotNull()) for c in TEXTS]
    return Section(parts, lead="Compared to similar homes: ", tail=_suffix(k)).compile()


def delta(f: Fields, k: int):
    parts = []
    for c in NUMBERS:
        own, mean = f.number(c), f.number(f"rag_mean_{c}")
        if c in YEARS:
            parts.append(delta_phrase(own, mean, LABELS[c], "years later than neighbors", "years earlier than neighbors", lead=YEARS[c]))
        elif c in AREAS:
            parts.append(delta_phrase(own, mean, LABELS[c], "sqft larger than neighbor mean", "sqft smaller than neighbor mean"))
        else:
            size = F.abs(own - mean)
            shown = F.when(size == F.floor(size), strings.show_int(size)).otherwise(strings.show_fixed(size, 1))
            parts.append(delta_phrase(own, mean, LABELS[c], "higher than neighbor mean", "lower than neighbor mean", shown))
    parts += [phrase(f"{LABELS[c]} consistent with neighbors", when=f.text(f"rag_mode_{c}").isNotNull()) for c in TEXTS]
    return Section(parts, lead="Relative to neighbors: ", tail=_suffix(k)).compile()


RECIPE = Recipe(
    name="iowa", target="SalePrice", numeric=NUMBERS, text=TEXTS, spaces=SPACES,
    templates={"structured": structured, "descriptive": descriptive, "narrative": descriptive, "compact_core": compact_core,
               "location_quality": location_quality, "size_age": size_age},
    neighbor_texts={"default": averages, "compare": compare, "delta": delta},
    derive=derive, key="Id", leaking=["Id"], target_scale="OverallQual_TotalSF",
)
