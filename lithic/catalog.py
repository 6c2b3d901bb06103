"""All queries of the library but those of ``lithic.llm``: importing the modules registers them."""

from __future__ import annotations

from lithic.functions import formats  # noqa: F401
from lithic.operators import audit, catalogue, explore, graph, incremental, snapshots, structure, symbols  # noqa: F401
from lithic.registry import ORACLES, QUERIES
from lithic.sources import archives, connectors, inputs, inventory, paths  # noqa: F401
from lithic.streaming import jobs  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
