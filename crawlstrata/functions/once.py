"""Expressions that are made once: long ones take thousands of calls into the Java process, which a stream would repeat for each batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column


def once(build: Callable[[], list[Column]]) -> Callable[[], list[Column]]:
    """The columns that ``build`` makes, made once for each Java process."""
    made: list = []

    @wraps(build)
    def columns() -> list[Column]:
        held = made
        if not held or held[0] is not SparkContext._gateway:
            held = made[:] = [SparkContext._gateway, build()]
        return held[1]

    return columns
