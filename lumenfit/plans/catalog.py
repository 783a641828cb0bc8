"""The whole catalogue; importing a module registers its queries."""

from lumenfit.plans import features, models, ordered, scaling, scores  # noqa: F401
from lumenfit.plans.registry import ORACLES, QUERIES  # noqa: F401
