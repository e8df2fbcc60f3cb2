"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` written (and evaluated) once however often ``body`` uses it.

    Columns are trees: a sub-expression used in many places is copied into all of them, and so is what it is
    made of. Parsing steps that feed each other would grow without bound.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def then(state: Column, value: Column, body: Callable[[Column, Column], Column]) -> Column:
    """The next state of a fold, ``body`` of the state and of ``value``, which is evaluated once.

    ``let`` copies what its body returns; a fold's state may be large, and is handed on as it is here.
    """
    return F.aggregate(F.array(value), state, body)
