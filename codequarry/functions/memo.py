"""Keeping built column expressions for the life of a Spark context.

Large expressions take thousands of gateway calls to build; they name columns
only, so one build serves every DataFrame.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext

_built: dict = {}
_owner: list = [None]


def per_context(build: Callable) -> Callable:
    """Cache the result of ``build`` for its (hashable) arguments while the context lives."""
    @functools.wraps(build)
    def cached(*args):
        context = SparkContext._active_spark_context
        if _owner[0] is not context:
            _built.clear()
            _owner[0] = context
        key = (build.__module__, build.__qualname__, args)
        if key not in _built:
            _built[key] = build(*args)
        return _built[key]

    return cached
