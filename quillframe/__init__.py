"""Named table operators for Spark DataFrames."""

from quillframe.registry import apply, available, operator, run

__all__ = ["apply", "available", "operator", "run"]
