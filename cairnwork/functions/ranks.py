"""Orders of epistemic status. There are three, they differ, and each operator names the one it uses."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strength of evidence, strongest first.
STRENGTH = ("OBSERVED", "DECLARED", "DERIVED", "INFERRED", "HYPOTHESIS", "SIMULATED", "CONFLICT", "UNKNOWN", "UNSUPPORTED", "IGNORED")
#: Coverage of a dimension, best first; statuses not named rank below all.
COVERAGE = ("OBSERVED", "DERIVED", "INFERRED", "DECLARED", "UNKNOWN", "UNSUPPORTED")
#: How far a capability has come, furthest first.
PROGRESS = ("verified", "implemented_unverified", "unimplemented", "blocked", "excluded")


def rank(order: tuple[str, ...], status: Column) -> Column:
    """Place in an order from 0; statuses it does not name, and null, come last."""
    places = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for i, s in enumerate(order)))
    return F.coalesce(F.try_element_at(places, status), F.lit(len(order)))


def strongest(order: tuple[str, ...], status: Column) -> Column:
    """Aggregate: the status that ranks first."""
    return F.min(F.struct(rank(order, status).alias("r"), status.alias("s")))["s"]


def weakest(order: tuple[str, ...], status: Column) -> Column:
    """Aggregate: the status that ranks last."""
    return F.max(F.struct(rank(order, status).alias("r"), status.alias("s")))["s"]
