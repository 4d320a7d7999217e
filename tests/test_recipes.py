import numpy as np

from cadastre.plans import recipes
from cadastre.plans.recipes import iowa

BLOCK = {"CRIM": 0.5, "ZN": 18.0, "INDUS": 2.3, "NOX": 0.53, "RM": 7.1, "AGE": 65.2, "DIS": 4.1, "TAX": 296.0, "PTRATIO": 15.3,
         "B": 396.9, "LSTAT": 5.0, "CHAS": 1.0, "RAD": 1.0, "MEDV": 24.0}


def tracts(spark, n=160):
    rng = np.random.default_rng(1)
    data = [tuple(float(v * (0.5 + rng.random())) if c not in ("CHAS", "RAD") else float(rng.integers(0, 2)) for c, v in BLOCK.items()) for _ in range(n)]
    return spark.createDataFrame(data, ", ".join(f"{c} double" for c in BLOCK))


def test_boston_texts(spark):
    df = spark.createDataFrame([tuple(BLOCK.values())], ", ".join(f"{c} double" for c in BLOCK))
    recipe = recipes.RECIPES["boston"]
    text = df.select(recipes.texts(recipe, df, "semantic").alias("t")).first()["t"]
    assert text.startswith("boston housing profile: river_relation=river_bound, highway_access_band=low_highway_access. neighborhood: crime_band=low_crime, ")
    assert text.endswith("signals: charles_river_premium_proxy larger_home_signal safer_area_signal better_school_ratio_signal higher_socioeconomic_area_proxy.")
    assert df.select(recipes.texts(recipe, df, "structured").alias("t")).first()["t"].startswith("river_relation: river_bound. crim_band: low_crime. zn_band: moderate_zoning.")


def test_boston_runs_end_to_end(spark):
    results, _ = recipes.run(
        recipes.RECIPES["boston"], tracts(spark), "baseline,rag_price,emb_with_rag,fni", ["linear"], k=4, dims=4, vector_dims=32, neighbor_template="compare"
    )
    got = {(r["mode"], r["split"]): r for r in results.collect()}
    assert all(r["error"] is None and r["rmse"] > 0 for r in got.values())
    assert {m for m, _ in got} == {"baseline", "rag_price", "emb_with_rag", "fni"} and len(got) == 8


def test_iowa_texts_and_features(spark):
    row = {"Neighborhood": "OldTown", "BedroomAbvGr": 3, "FullBath": 2, "HalfBath": 1, "BsmtFullBath": 1, "BsmtHalfBath": 0, "GrLivArea": 1500,
           "YearBuilt": 1950, "YearRemodAdd": 1999, "YrSold": 2008, "GarageCars": 2, "GarageArea": 400, "Fireplaces": 0, "KitchenQual": "Gd",
           "OverallQual": 6, "OverallCond": 5, "PoolArea": 0, "TotalBsmtSF": 800, "OpenPorchSF": 10, "EnclosedPorch": 0, "ScreenPorch": 5}
    extra = {"1stFlrSF": 900, "2ndFlrSF": 600, "3SsnPorch": 0, "rag_mean_GrLivArea": 1200.0, "rag_mean_YearBuilt": 1960.0, "rag_mode_KitchenQual": "Gd"}
    full = {**row, **extra}
    df = spark.createDataFrame([tuple(full.values())], list(full))
    out = iowa.derive(df).first()
    assert (out["TotalBath"], out["BuildingAge"], out["TotalSF"], out["IsRemodeled"], out["IsNew"], out["TotalPorch"]) == (3.5, 58.0, 3800, 1, 0, 15)
    show = lambda t, n=None: df.select(recipes.texts(iowa.RECIPE, df, t, n, 8).alias("t")).first()["t"]
    base = ("neighborhood OldTown. 3 bedrooms, 2 full baths, 1500 sqft living area (spacious), built 1950 (mid-century), remodeled 1999. "
            "2-car garage, kitchen quality Good. overall quality 6/10, condition 5/10.")
    assert show("structured") == base
    assert show("structured", "default") == base + " Similar homes (avg): GrLivArea 1200 sqft, YearBuilt 1960, KitchenQual Gd. (based on k=8 nearest neighbors)."
    assert show("structured", "compare") == base + " Compared to similar homes: area larger than neighbors, year built comparable to neighbors, kitchen quality consistent with majority of neighbors. (based on k=8 nearest neighbors)."
    assert show("structured", "delta") == base + " Relative to neighbors: area 300 sqft larger than neighbor mean, built 10 years earlier than neighbors, kitchen quality consistent with neighbors. (based on k=8 nearest neighbors)."
    assert show("size_age") == "Living area 1500 sqft. Basement 800 sqft. Floor split 900 + 600 sqft. Built 1950. Remodeled 1999. FullBath 2."


def test_california_features_and_texts(spark):
    data = [(-118.3 - i % 7, 34.0 + i % 5, float(5 + i % 50), 1000.0 + i, 200.0 + i % 30 if i % 9 else None, 500.0, float(i % 4 * 100), 2.0 + i % 9, 1e5 + 1000 * i, "NEAR BAY") for i in range(80)]
    raw = spark.createDataFrame(data, ", ".join(f"{c} double" for c in recipes.california.RAW) + ", median_house_value double, ocean_proximity string")
    df = recipes.clean(recipes.RECIPES["california"], raw)
    rows = df.collect()
    assert len(rows) == 80 and all(r["rooms_per_household"] is not None and 0 <= r["geo_cluster"] < 12 for r in rows)
    recipe = recipes.RECIPES["california"]
    shown = df.select(*[recipes.texts(recipe, df, t).alias(t) for t in recipe.templates]).collect()
    assert all(v for r in shown for v in r)
    assert shown[0]["structured_short_plus"].startswith("A census block in a near bay California area, geo cluster ")
    assert "housing market." in shown[0]["structured_short_plus"] and shown[0]["bucket_only_semantic"].startswith("Near-bay California neighborhood, near bay market, ")


def test_brazil_cleaning_and_texts(spark):
    raw = spark.createDataFrame(
        [("Campinas ", "-", "accept", "furnished", "70", 2.0, 1.0, 2.0, 400.0, 3000.0, 10.0, 20.0, 3400.0), ("Recife", "7", "not accept", "not furnished", "bad", None, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0, 900.0)] * 2,
        "city string, floor string, animal string, furniture string, area string, rooms double, bathroom double, parking_spaces double, hoa double, rent_amount double, property_tax double, fire_insurance double, total double")
    recipe = recipes.RECIPES["brazil"]
    df = recipe.prepare(raw).dropDuplicates()
    got = {r["city"]: r for r in df.collect()}
    assert (got["Campinas"]["floor"], got["Campinas"]["floor_is_unknown"], got["Recife"]["area"]) == ("0", 1.0, None) and "hoa" not in df.columns
    texts = {r["city"]: r for r in df.select("city", recipes.texts(recipe, df, "semantic").alias("s"), recipes.texts(recipe, df, "structured").alias("t")).collect()}
    assert texts["Campinas"]["t"] == "Located in Campinas. floor: 0. animal policy: accept. furniture: furnished. area: 70 sqm. 2 rooms. 1 bathrooms. 2 parking spaces."
    assert texts["Campinas"]["s"].endswith("costs: rent_band=unknown, hoa_band=unknown, property_tax=unknown, fire_insurance=unknown. signals: pet_friendly furnished_property multiple_parking.")


def test_melbourne_texts(spark):
    raw = spark.createDataFrame([("Abbotsford", "1 St", "h", "yarra", "Northern", "3/12/2016", 2.0, 2.0, 1.0, 1.0, 500.0, 150.0, 1990.0, 2.5)],
        "Suburb string, Address string, Type string, CouncilArea string, Regionname string, Date string, Rooms double, Bedroom2 double, Bathroom double, Car double, Landsize double, BuildingArea double, YearBuilt double, Distance double")
    recipe = recipes.RECIPES["melbourne"]
    df = recipe.prepare(raw)
    assert (df.first()["SaleYear"], df.first()["SaleWeekday"]) == (2016.0, 5.0) and "Address" not in df.columns
    means = {"rag_mean_BuildingArea": 100.0, "rag_mean_Landsize": 500.0, "rag_mean_YearBuilt": 1930.0}
    from pyspark.sql import functions as F

    df = df.withColumns({n: F.lit(v) for n, v in means.items()}).withColumn("rag_mode_CouncilArea", F.lit("Yarra"))
    text = df.select(recipes.texts(recipe, df, "semantic", "default", 12).alias("t")).first()["t"]
    assert text == (
        "A detached house in Abbotsford, Northern, council area Yarra. This is a medium-sized dwelling with 2 rooms, 2 bedrooms, 1 bathrooms. "
        "Located in the inner, built as a moderately aged home. Sits on a moderate land parcel. Neighborhood context: Similar nearby homes are typically medium-sized dwellings. "
        "The neighborhood is characterized by moderate land parcel. Nearby properties are generally older housing stock. "
        "Neighboring properties are usually located in the same council area. This home is larger than nearby properties. "
        "Lot size is in line with the neighborhood. (based on 12 nearest neighbors).")
