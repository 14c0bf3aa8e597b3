"""All registered queries: importing the plan modules fills the registry."""

from rainloom.plans import decisions, ensembles, grids, joins, scalars, sources, stats, temporal, verify  # noqa: F401
from rainloom.plans.registry import ORACLES, QUERIES  # noqa: F401
from rainloom.plans.flagship import flagship  # noqa: E402,F401
