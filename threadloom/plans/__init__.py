"""Named queries over the driver tables."""

from threadloom.plans import (  # noqa: F401  (importing registers the queries)
    finding,
    flows,
    patterns,
    talks,
    texts,
    trust,
    usage,
)
from threadloom.plans.catalog import QUERIES

__all__ = ["QUERIES"]
