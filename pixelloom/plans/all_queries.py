"""All queries of the catalogue; importing the modules registers them."""

from . import queries_files, queries_more, queries_pixels, queries_reach, queries_regions, queries_shapes  # noqa: F401
from .catalogue import INVENTORY, ORACLES, QUERIES

__all__ = ["INVENTORY", "ORACLES", "QUERIES"]
