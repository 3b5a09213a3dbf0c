"""Checked queries: one or more per operator, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

_MODULES = ("stats", "clean", "transform", "feature", "nlp", "analysis", "viz", "plans")


def catalogue() -> dict:
    out = {}
    for name in _MODULES:
        module = importlib.import_module(f"quillframe.queries.{name}")
        for key, entry in module.Q.items():
            if key in out:
                raise ValueError(f"query {key!r} defined twice")
            out[key] = entry
    return out
