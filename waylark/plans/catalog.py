"""All registered queries. Importing the plan modules fills the registry."""

from waylark.plans import (  # noqa: F401
    drift_plans,
    explain_plans,
    itinerary_plans,
    learning_plans,
    nested_plans,
    rule_plans,
    scalar_plans,
    source_plans,
    table_plans,
    training_plans,
    weather_plans,
)
from waylark.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "itineraries_to_match"
