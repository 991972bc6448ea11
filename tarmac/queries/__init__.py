"""All registered queries; importing this package registers them."""

import importlib
import pkgutil

from tarmac.queries.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
