"""All registered queries."""

from cadastre.plans import cleaning, encoding, learning, reduction, results, search, sweeps, texts  # noqa: F401
from cadastre.plans.registry import ORACLES, QUERIES  # noqa: F401
