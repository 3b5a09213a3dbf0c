"""Least squares from sums of products: one matrix per task, added up in Spark, and a k x k solve on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment_matrix(df: DataFrame, columns: Sequence[Column], intercept: bool = True,
                  centre: Sequence[float] | None = None) -> tuple[np.ndarray, int]:
    """Sums of products of all columns over rows where none is null."""
    k = len(columns)
    rows = df.select(*[c.cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).na.drop()
    shift = np.zeros(k) if centre is None else np.asarray(centre, float)
    schema = pa.schema([("cell", pa.int32()), ("value", pa.float64())])

    def products(batches):
        """One matrix per task: sums of products of (1, columns)."""
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[b.column(i).to_numpy(zero_copy_only=False) - shift[i] for i in range(k)]])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], schema=schema)

    cells = rows.mapInArrow(products, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # (k + 1)^2 rows
    out = np.zeros((k + 1) ** 2)
    for r in cells:
        out[r["cell"]] = r["value"]
    out = out.reshape(k + 1, k + 1)
    return (out if intercept else out[1:, 1:]), int(round(out[0, 0]))


def solve(gram: np.ndarray, features: Sequence[int], target: int) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares of ``target`` on ``features`` (indexes into gram)."""
    a = gram[np.ix_(features, features)]
    b = gram[np.ix_(features, [target])][:, 0]
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    rss = gram[target, target] - 2 * beta @ b + beta @ a @ beta
    return beta, max(float(rss), 0.0)
