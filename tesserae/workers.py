"""Sending functions to Python workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Pickle a module's functions whole, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
