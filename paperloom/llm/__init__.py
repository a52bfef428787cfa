"""Operators of a training-data pipeline and the queries that apply them. Nothing else in the library imports this package."""

import importlib
import pkgutil
import sys

from pyspark import cloudpickle

# task functions travel whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load_all():
    """Import every module of this package and return the registry."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return importlib.import_module(f"{__name__}.queries")
