"""Data set recipes: schemas, derived features, templates and search spaces as data."""

from cadastre.plans.recipes import boston, brazil, california, iowa, melbourne
from cadastre.plans.recipes.base import Fields, Recipe, clean, run, texts

RECIPES = {r.RECIPE.name: r.RECIPE for r in (iowa, california, boston, brazil, melbourne)}

__all__ = ["Fields", "Recipe", "RECIPES", "clean", "run", "texts"]
