"""All registered queries; importing the catalogs fills the registry."""

from rotorline.plans import (  # noqa: F401
    catalog_evaluation,
    catalog_quality,
    catalog_scoring,
    catalog_sinks,
    catalog_sources,
    catalog_streams,
)
from rotorline.plans.registry import QUERIES

__all__ = ["QUERIES"]
