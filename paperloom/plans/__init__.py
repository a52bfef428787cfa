"""Registered queries over the supplied tables, each with the SQL that checks it."""

import importlib
import pkgutil


def load_all():
    """Import every module of this package and return the registry."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return importlib.import_module(f"{__name__}.registry")
