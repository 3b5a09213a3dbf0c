"""Operator registry: ``"category.name"`` to a function ``f(df, **params) -> DataFrame``."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

_MODULES = ("stats", "clean", "transform", "feature", "nlp", "analysis", "viz")
_OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def operator(op_id: str):
    """Register a function under ``category.name``."""

    def wrap(fn):
        if op_id in _OPERATORS:
            raise ValueError(f"operator {op_id!r} registered twice")
        _OPERATORS[op_id] = fn
        return fn

    return wrap


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"quillframe.operators.{name}")


def available() -> list[str]:
    _load()
    return sorted(_OPERATORS)


def get(op_id: str) -> Callable[..., DataFrame]:
    _load()
    if op_id not in _OPERATORS:
        raise ValueError(f"unknown operator {op_id!r}")
    return _OPERATORS[op_id]


def apply(df: DataFrame, op_id: str, **params) -> DataFrame:
    """Run one operator."""
    return get(op_id)(df, **params)


def run(df: DataFrame, steps: Iterable[tuple[str, dict]]) -> DataFrame:
    """Chain operators; each step sees the result of the one before, as one lazy plan."""
    for op_id, params in steps:
        df = apply(df, op_id, **params)
    return df
