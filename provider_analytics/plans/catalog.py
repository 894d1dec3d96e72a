"""All registered queries. Importing the modules registers them."""

from __future__ import annotations

import importlib
import pkgutil

from . import __path__ as _path
from .registry import QUERIES, runner

for _module in sorted(m.name for m in pkgutil.iter_modules(_path) if m.name.startswith("queries_")):
    importlib.import_module(f"{__package__}.{_module}")


def queries():
    return {name: runner(entry) for name, entry in QUERIES.items()}


def oracle_sql():
    return {name: entry.sql for name, entry in QUERIES.items() if entry.sql}
