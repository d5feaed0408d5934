"""All registered queries; importing this package fills the registry."""

import importlib

from rollcall.plans.registry import ORACLE, QUERIES

for _part in ("scans", "cleaning", "joins", "aggregates", "ordering", "features", "scalars", "spatial", "series",
              "scoring", "learned", "explaining", "policies", "streams"):
    try:
        importlib.import_module(f"rollcall.plans.{_part}")
    except ModuleNotFoundError as _exc:
        if _exc.name != f"rollcall.plans.{_part}":
            raise

__all__ = ["ORACLE", "QUERIES"]
