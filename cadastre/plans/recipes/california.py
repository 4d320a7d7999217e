"""California census blocks: ratios, coast and city distances, feature interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions import numeric, strings
from cadastre.functions.buckets import bucket, cascade
from cadastre.functions.text import Section, Template, phrase
from cadastre.operators.neighbors import SearchSpace
from cadastre.plans.recipes.base import Fields, Recipe

# Columns, anchors, words and thresholds of this data set.
RAW = ["longitude", "latitude", "housing_median_age", "total_rooms", "total_bedrooms", "population", "households", "median_income"]
CORE = ["longitude", "latitude", "housing_median_age", "total_rooms", "total_bedrooms", "population", "households", "median_income",
        "rooms_per_household", "bedrooms_per_room", "population_per_household", "log_median_income", "rooms_per_population", "other_rooms",
        "distance_to_coast", "avg_household_size", "geo_cluster"]
TEXTS = ["ocean_proximity", "coastal_flag", "age_bucket", "income_bucket"]
CITIES = {"sf": (37.7749, -122.4194), "la": (34.0522, -118.2437), "san_diego": (32.7157, -117.1611), "sacramento": (38.5816, -121.4944)}
RATIOS = {
    "rooms_per_household": ("total_rooms", "households"), "bedrooms_per_room": ("total_bedrooms", "total_rooms"),
    "bedrooms_ratio": ("total_bedrooms", "total_rooms"), "population_per_household": ("population", "households"),
    "bedrooms_per_household": ("total_bedrooms", "households"), "rooms_per_person": ("total_rooms", "population"),
    "bedrooms_per_person": ("total_bedrooms", "population"), "rooms_per_population": ("total_rooms", "population"),
    "avg_household_size": ("population", "households"),
}
OCEAN = {"NEAR BAY": "near the bay", "INLAND": "inland", "NEAR OCEAN": "by the ocean", "<1H OCEAN": "within an hour of the ocean", "ISLAND": "on an island"}
AGE_BANDS = [(10, "new"), (20, "relatively new"), (40, "middle-aged"), (55, "old")]
INCOME_BANDS = [(30000, "low"), (60000, "moderate"), (100000, "upper_middle")]
AGE_WORDS = {"new": "newer", "relatively new": "relatively new", "middle-aged": "moderately aged", "old": "older", "very old": "older"}
INCOME_WORDS = {"low": "low income", "moderate": "moderate income", "upper_middle": "upper-middle income", "high": "high income"}
BEDROOM_BANDS = [(0.14, "low bedroom ratio"), (0.22, "balanced bedroom ratio")]
DENSITY_BANDS = [(2.5, "low household density"), (3.5, "moderate household density")]


def age_bucket(c: Column) -> Column:
    return bucket(c, AGE_BANDS, "very old")


def income_bucket(c: Column) -> Column:
    return bucket(c * 10000, INCOME_BANDS, "high")


def coastal_flag(c: Column) -> Column:
    rules = [(("ISLAND",), "island"), (("BAY",), "near bay"), (("OCEAN", "1H"), "coastal")]
    return F.when(c.isNull(), "inland").otherwise(strings.contains_rules(F.upper(c), rules, "inland"))


def ratios(df: DataFrame) -> DataFrame:
    df = df.withColumns({name: numeric.safe_ratio(a, b) for name, (a, b) in RATIOS.items()})
    return df.withColumn("income_per_room", numeric.safe_ratio("median_income", "rooms_per_household"))


def derive(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        **{f"distance_to_{n}": numeric.planar_distance("latitude", "longitude", at) for n, at in CITIES.items()},
        "lat_lon_sum": c("longitude") + c("latitude"), "lat_lon_diff": c("latitude") - c("longitude"),
        "coastal_flag": coastal_flag(c("ocean_proximity")), "income_x_rooms_per_household": c("median_income") * c("rooms_per_household"),
        "age_bucket": age_bucket(c("housing_median_age")), "income_bucket": income_bucket(c("median_income")),
        "log_median_income": numeric.log_floor("median_income"), "other_rooms": c("total_rooms") - c("total_bedrooms"),
        "distance_to_coast": numeric.line_distance("latitude", "longitude"),
    })


def _ocean(f: Fields) -> Column:
    return strings.lookup(F.upper(f.text("ocean_proximity")), OCEAN, "inland")


def _near_ocean(f: Fields) -> Column:
    return F.regexp_replace(_ocean(f), "the ", "")


def _region(f: Fields) -> Column:
    lat, lon = f.number("latitude"), f.number("longitude")
    return cascade([
        (lat >= 38, "Northern California"), ((lat >= 36) & (lon <= -121), "Bay Area / Central Coast"), (lat >= 36, "Central Valley"),
        (lat >= 34.5, "Southern California (LA region)"),
    ], "Southern California (San Diego / Desert)")


def _market(f: Fields) -> Column:
    region = _region(f)
    placed = strings.contains_rules(region, [(("Bay",), "Bay Area type"), (("Northern",), "Northern California type"), (("Southern",), "Southern California type")], "Central Valley type")
    fallback = F.when(f.text("ocean_proximity").isNotNull(), _ocean(f)).otherwise("California")
    return F.when(f.number("latitude").isNull() | f.number("longitude").isNull(), fallback).otherwise(placed)


def _coast(f: Fields) -> Column:
    flag = F.lower(F.coalesce(f.text("coastal_flag"), f.text("ocean_proximity")))
    rules = [(("coastal", "ocean", "1h"), "close to the coast"), (("bay",), "near the bay"), (("island",), "on the island")]
    return F.when(flag.isNull(), "inland").otherwise(strings.contains_rules(flag, rules, "inland"))


def _age(bucketed: Column) -> Column:
    listed = strings.lookup(F.lower(bucketed), AGE_WORDS, None)
    return F.when(bucketed.isNull(), "unknown age").otherwise(F.coalesce(listed, F.replace(F.lower(bucketed), F.lit("_"), F.lit(" "))))


def _income(bucketed: Column) -> Column:
    listed = strings.lookup(F.replace(F.lower(bucketed), F.lit(" "), F.lit("_")), INCOME_WORDS, None)
    upper = F.when(F.lower(bucketed).contains("upper"), "upper-middle income")
    return F.when(bucketed.isNull(), "unknown income").otherwise(F.coalesce(listed, upper, bucketed))


def _rooms(value: Column) -> Column:
    return bucket(value, [(4, "compact homes"), (6, "average-sized homes")], "spacious homes", missing=None)


def _bedrooms(f: Fields) -> Column:
    return bucket(f.number("bedrooms_per_room"), BEDROOM_BANDS, "high bedroom ratio", "mixed", "unknown bedroom ratio")


def _density(value: Column) -> Column:
    return bucket(value, DENSITY_BANDS, "high household density", "mixed", "unknown density")


def _cluster(f: Fields) -> Column:
    return F.coalesce(f.whole("geo_cluster"), F.lit("-1"))


def structured(f: Fields):
    age, income = f.number("housing_median_age").cast("int"), f.number("median_income") * 10000
    grade = bucket(income, [(30000, "low income area"), (60000, "moderate income"), (100000, "upper-middle income")], "high income area", missing=None)
    return Template([
        Section([
            phrase("in ", _region(f), " at (", f.fixed("latitude", 2), ", ", f.fixed("longitude", 2), ")"),
            phrase("ocean proximity ", f.text("ocean_proximity"), " (", _ocean(f), ")"),
        ]),
        Section([
            phrase("housing median age ", f.whole("housing_median_age"), " years (", bucket(age, [(15, "newer homes"), (35, "moderately aged housing")], "older housing stock"), ")"),
            phrase(f.whole("total_rooms"), " total rooms, ", f.whole("total_bedrooms"), " bedrooms"),
            phrase(f.fixed("rooms_per_household", 1), " rooms per household (", _rooms(f.number("rooms_per_household")), ")"),
        ]),
        Section([phrase("population ", f.whole("population"), ", ", f.whole("households"), " households")]),
        Section([phrase(grade, " (median $", strings.show_fixed(income / 1000, 0), "k)")]),
    ]).compile()


def structured_short_plus(f: Fields):
    rooms = f.number("rooms_per_household")
    income = _income(f.text("income_bucket"))
    layout = F.coalesce(
        phrase("Homes are ", F.regexp_replace(_rooms(rooms), " homes", ""), " with ", f.fixed("rooms_per_household", 1), " rooms per household, a ", _bedrooms(f), ", and ", _density(f.number("population_per_household")), "."),
        phrase("Homes with a ", _bedrooms(f), " and ", _density(f.number("population_per_household")), "."),
    )
    place = F.coalesce(phrase(", located at longitude ", f.fixed("longitude", 2), " and latitude ", f.fixed("latitude", 2)), F.lit(""))
    article = F.when(income.startswith("upper"), "an").otherwise("a")
    return Template([
        phrase("A census block in a ", _near_ocean(f), " California area, geo cluster ", _cluster(f), place, "."),
        phrase("This is ", article, " ", income, " neighborhood with ", _age(f.text("age_bucket")), " housing stock."),
        layout,
        phrase("The block is ", _coast(f), " and belongs to a ", _market(f), " housing market."),
    ], sep=" ", end="").compile()


def bucket_only_semantic(f: Fields):
    near = _near_ocean(f)
    area = strings.contains_rules(near, [(("inland",), "Inland"), (("bay",), "Near-bay"), (("ocean", "hour"), "Coastal")], "California")
    age = _age(f.text("age_bucket"))
    return Template([
        phrase(area, " California neighborhood"), phrase(near, " market"), _income(f.text("income_bucket")),
        phrase(F.when(age == "moderately aged", "mid-aged").otherwise(age), " housing"),
        F.coalesce(_rooms(f.number("rooms_per_household")), F.lit("homes")), _bedrooms(f), _density(f.number("population_per_household")),
        _coast(f), phrase("geo cluster ", _cluster(f)),
    ], sep=", ").compile()


def hybrid(f: Fields):
    rooms, people = f.number("rooms_per_household"), f.number("population_per_household")
    detail = F.coalesce(
        phrase("with ", f.fixed("rooms_per_household", 1), " rooms per household, ", f.fixed("bedrooms_per_room", 2), " bedrooms per room, and ",
               f.fixed("population_per_household", 1), " people per household, indicating ", _rooms(rooms), " with ", _density(people)),
        phrase("with ", f.fixed("rooms_per_household", 1), " rooms per household (", _rooms(rooms), ")"),
    )
    income = F.coalesce(phrase(" with median income ", f.fixed("median_income", 1), " (", _income(f.text("income_bucket")), ")"), F.lit(""))
    return Template([
        phrase("A ", _market(f), " / ", _coast(f), " housing block", income, "."),
        Section([phrase("Homes are ", _age(f.text("age_bucket"))), detail], sep=". ", tail="."),
        phrase("The block is ", _coast(f), " and belongs to geo cluster ", _cluster(f), "."),
    ], sep=" ", end="").compile()


def nearby_blocks(f: Fields, k: int):
    income, age = f.number("rag_mean_median_income"), f.number("rag_mean_housing_median_age")
    rooms, people = f.number("rag_mean_rooms_per_household"), f.number("rag_mean_population_per_household")
    shown = F.coalesce(F.when(income.isNotNull(), income_bucket(income)), f.text("rag_mode_income_bucket"))
    return Section([
        F.when(shown.isNotNull(), _income(shown)),
        phrase(_age(age_bucket(age)), " housing", when=age.isNotNull()),
        phrase(f.fixed("rag_mean_rooms_per_household", 1), " rooms per household (", F.regexp_replace(_rooms(rooms), " homes", ""), ")"),
        F.when(people.isNotNull(), _density(people)),
        phrase("geo cluster ", f.whole("rag_mean_geo_cluster")),
    ], lead="Similar nearby blocks average ", tail=".").compile()


RECIPE = Recipe(
    name="california", target="median_house_value", numeric=RAW, text=["ocean_proximity"],
    spaces={"geo": SearchSpace(["longitude", "latitude", "distance_to_coast"], category="apart"), "hybrid": SearchSpace(CORE, category="apart")},
    templates={"structured_short_plus": structured_short_plus, "structured": structured, "bucket_only_semantic": bucket_only_semantic, "hybrid": hybrid},
    neighbor_texts={"default": nearby_blocks}, derive=derive, ratios=ratios, ratio_columns=[*RATIOS, "income_per_room"],
    interaction_columns=CORE, geo=["longitude", "latitude"], neighbor_numeric=CORE, neighbor_text=TEXTS,
)
