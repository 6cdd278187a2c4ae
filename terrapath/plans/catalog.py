"""All registered queries."""

from terrapath.plans import event_plans, fan_plans, graph_plans, lift_plans, resort_plans, route_plans, scalar, terrain_plans  # noqa: F401
from terrapath.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "gen4_fan"
