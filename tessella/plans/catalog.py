"""All registered map-data queries: importing this module fills the registry."""

import tessella.plans.files  # noqa: F401
import tessella.plans.formats  # noqa: F401
import tessella.plans.queries  # noqa: F401
import tessella.plans.polygons  # noqa: F401
import tessella.plans.tiles  # noqa: F401
from tessella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
