"""Facts about a table from a few wide aggregations, and the rules that read them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.columns import col, dtype, is_numeric, is_time, num, numeric_cols, text_cols, time_cols
from quillframe.functions.freq import freq_long, modes
from quillframe.functions.profile import fit, matrix, nulls, profile, r, safe_corr, skew_g1
from quillframe.functions.quantile import fit_quantiles
from quillframe.operators.analysis import data_profiling_report, data_quality, report
from quillframe.operators.stats import correlations, duplicate_count, outlier_report, pct

# Words in a column name that suggest a target.
TARGET_WORDS = ("target", "label", "class", "y", "outcome", "price", "churn", "fraud", "default", "rating", "score")


def column_facts(df: DataFrame, distinct: Sequence[str] | None = None) -> dict:
    """{"rows": n, "columns": {name: {nulls, unique, skew, var, min, max, length, kind}}}: one aggregation.

    Exact distinct counts are the costly part; ``distinct`` names the columns that need one.
    """
    aggs = {"n": F.count(F.lit(1))}
    for i, c in enumerate(df.columns):
        aggs[f"m{i}"] = nulls(col(c))
        if distinct is None or c in distinct:
            aggs[f"u{i}"] = F.count_distinct(col(c))
        if is_numeric(df, c):
            aggs |= {f"s{i}": skew_g1(num(c)), f"v{i}": F.var_samp(num(c)), f"a{i}": F.min(num(c)), f"b{i}": F.max(num(c))}
        elif c in text_cols(df):
            aggs[f"l{i}"] = F.avg(F.length(col(c)))
    f = fit(df, **aggs)
    out = {}
    for i, c in enumerate(df.columns):
        kind = "numeric" if is_numeric(df, c) else "datetime" if is_time(df, c) else "text"
        out[c] = {"kind": kind, "nulls": f[f"m{i}"], "unique": f.get(f"u{i}"), "skew": f.get(f"s{i}"), "var": f.get(f"v{i}"), "min": f.get(f"a{i}"),
                  "max": f.get(f"b{i}"), "length": f.get(f"l{i}"), "null_pct": f[f"m{i}"] / f["n"] * 100 if f["n"] else 0.0}
    return {"rows": f["n"], "columns": out}


def context_profile(df: DataFrame) -> DataFrame:
    """Per column: type, null share, flags (null > 40%, |skew| > 1, text with > 50 values, constant) and the suggested target
    (the numeric column of largest variance)."""
    f = column_facts(df)
    spread = {c: x["var"] for c, x in f["columns"].items() if x["var"] is not None}
    best = max(spread, key=spread.get) if spread else None
    return report(df, [(c, dtype(df, c), round(x["null_pct"], 1), x["unique"], x["null_pct"] > 40, abs(x["skew"] or 0.0) > 1,
                        x["kind"] == "text" and x["unique"] > 50, x["unique"] <= 1, c == best) for c, x in f["columns"].items()],
                  "column string, dtype string, null_pct double, unique long, high_null boolean, skewed boolean, high_cardinality boolean, constant boolean, suggested_target boolean")


def column_role(x: Mapping) -> str:
    if x["kind"] != "text":
        return x["kind"]
    return "text" if (x["length"] or 0) > 40 and x["unique"] > 30 else "categorical"


def suggest_encoding(x: Mapping) -> str | None:
    if x["kind"] != "text" or x["unique"] <= 1:
        return None
    return "label" if x["unique"] == 2 else "ordinal" if x["unique"] <= 50 else "frequency"


def suggest_fill(x: Mapping) -> str:
    if x["null_pct"] == 0:
        return "none"
    if x["null_pct"] > 60:
        return "drop"
    if x["kind"] == "numeric":
        return "median" if abs(x["skew"] or 0.0) > 1 else "mean"
    return "mode"


def column_suggestions(df: DataFrame) -> DataFrame:
    def note(x):
        if x["unique"] <= 1:
            return "constant: drop"
        return "high null share" if x["null_pct"] > 60 else "free text: drop" if column_role(x) == "text" else ""

    return report(df, [(c, dtype(df, c), column_role(x), round(x["null_pct"], 1), x["unique"], suggest_fill(x), suggest_encoding(x), note(x))
                       for c, x in column_facts(df)["columns"].items()],
                  "column string, dtype string, role string, null_pct double, n_unique long, null_strategy string, encoding string, note string")


def task_and_targets(df: DataFrame) -> DataFrame:
    """Ranked target columns with their task: 2-20 values classify, other numbers regress."""
    rows = []
    for c, x in column_facts(df)["columns"].items():
        if x["unique"] <= 1 or x["null_pct"] > 80:
            continue
        few = 2 <= x["unique"] <= 20
        if x["kind"] == "numeric":
            rows.append((c, "classification", 30 - x["unique"]) if few else (c, "regression", 5))
        elif few:
            rows.append((c, "classification", 32 - x["unique"]))
    rows.sort(key=lambda t: -t[2])
    return report(df, [t for t in rows if t[1] == rows[0][1]], "column string, task string, score long")


def target_candidates(df: DataFrame, facts: Mapping | None = None) -> DataFrame:
    """Scored columns; ``facts`` are the table's ``column_facts``, if they are known."""
    rows = []
    for c, x in (facts or column_facts(df))["columns"].items():
        score, why, task = 0, [], "regression"
        if c == df.columns[-1]:
            score, why = score + 30, [*why, "last column"]
        if any(w in c.lower() for w in TARGET_WORDS):
            score, why = score + 40, [*why, "name suggests target"]
        if x["kind"] == "numeric":
            few = x["unique"] <= 10
            task, score = ("classification", score + 15) if few else (task, score + 10)
            why.append(f"{x['unique']} discrete values" if few else "continuous numeric")
        elif 2 <= x["unique"] <= 20:
            task, score = "classification", score + 25
            why.append(f"{x['unique']} categories")
        else:
            continue
        rows.append((c, score, task, "; ".join(why)))
    return report(df, sorted(rows, key=lambda t: -t[1]), "column string, score long, task_type string, reason string")


def categorical_balance(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Share of the most frequent value of text columns (null counts as a value)."""
    cols = text_cols(df)[:max_columns]
    filled = df.select(*[F.coalesce(col(c), F.lit("(null)")).alias(c) for c in cols])
    share = F.round(pct(F.col("mode_count"), F.col("total")), 1)
    return modes(freq_long(filled, cols)).select("column", F.col("distinct").alias("n_classes"), F.substring("mode", 1, 50).alias("dominant_value"),
                                                 share.alias("dominant_pct"), (share > 80).alias("imbalanced"))


def high_cardinality(df: DataFrame, limit: int = 50) -> DataFrame:
    p = profile(df, text_cols(df), {"unique": F.count_distinct}).where(F.col("unique") > limit)
    return p.select("column", "unique", F.round(pct(F.col("unique"), F.col("n")), 1).alias("pct_of_rows")).orderBy(F.desc("unique"), "column")


def datetime_summary(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    p = profile(df, time_cols(df)[:max_columns], {"k": F.count, "min": lambda c: F.min(c.cast("timestamp")), "max": lambda c: F.max(c.cast("timestamp")),
                                                  "n_unique": F.count_distinct})
    days = F.floor((F.unix_micros("max") - F.unix_micros("min")) / F.lit(86_400_000_000))
    return p.where(F.col("k") > 0).select("column", "min", "max", days.alias("range_days"), "n_unique", (F.col("n_unique") == F.col("k")).alias("unique_per_row"))


def strong_pairs(df: DataFrame, limit: float = 0.3, top: int = 15, max_columns: int | None = None) -> DataFrame:
    nums = numeric_cols(df)[:max_columns]
    return correlations(df, nums).where(F.abs("r") > limit).select("a", "b", r(F.col("r")).alias("value")).orderBy(F.desc(F.abs("value")), "a", "b").limit(top)


def ml_readiness(df: DataFrame, facts: Mapping | None = None) -> DataFrame:
    """Penalties by factor, and the score they leave (last row); ``facts`` are the table's ``column_facts``, if they are known."""
    f = facts or column_facts(df)
    n, cols = f["rows"], f["columns"]
    rows = [("sample_size", float(n), 40 if n < 50 else 15 if n < 500 else 0)]
    ratio = len(cols) / max(n, 1)
    rows.append(("feature_ratio", round(ratio, 3), 25 if ratio > 0.5 else 10 if ratio > 0.1 else 0))
    full = 100 - sum(x["nulls"] for x in cols.values()) / max(n * len(cols), 1) * 100
    rows.append(("completeness", round(full, 1), 25 if full < 70 else 10 if full < 90 else 0))
    spans = [x["max"] - x["min"] for x in cols.values() if x["max"] is not None and x["max"] != x["min"]]
    nums = numeric_cols(df)
    if len(nums) >= 2 and spans:
        wide = max(spans) / max(min(spans), 1e-9)
        rows.append(("scale_heterogeneity", float(f"{wide:.0e}"), 5 if wide > 1e6 else 0))
        tight = correlations(df, nums).where(F.abs("r") > 0.9).count()
        if tight:
            rows.append(("multicollinearity", float(tight), min(15, tight * 3)))
    score = max(0, 100 - sum(t[2] for t in rows))
    return report(df, [*rows, ("SCORE", float(score), 0)], "factor string, value double, penalty long")


def eda_numbers(df: DataFrame) -> dict[str, DataFrame]:
    """The frames behind an exploratory document; facts and quartiles are made once."""
    f = column_facts(df)
    nums = numeric_cols(df)
    q = fit_quantiles(df, nums, [0.25, 0.5, 0.75]) if nums else {}
    d = duplicate_count(df).first()
    n, k = f["rows"], len(f["columns"])
    missing = sum(x["nulls"] for x in f["columns"].values())
    overview = report(df, [("rows", float(n)), ("columns", float(k)), ("missing_cells", float(missing)), ("completeness_pct", round(100 - missing / max(n * k, 1) * 100, 1)),
                           ("duplicates", float(d["rows"] - d["distinct_rows"])), ("numeric", float(len(numeric_cols(df)))), ("categorical", float(len(text_cols(df))))],
                      "metric string, value double")
    skewed = report(df, [(c, round(x["skew"], 2)) for c, x in f["columns"].items() if x["skew"] is not None and abs(x["skew"]) > 1], "column string, skewness double")
    return {"overview": overview, "correlations": strong_pairs(df), "skewed": skewed, "outliers": outlier_report(df, q), "profiles": data_profiling_report(df, q),
            "quality": data_quality(df, q), "targets": target_candidates(df, f), "balance": categorical_balance(df), "readiness": ml_readiness(df, f)}


def eda_report(df: DataFrame) -> dict[str, DataFrame]:
    """Column profiles, number of columns per type, correlation matrix."""
    kinds: dict[str, int] = {}
    for c in df.columns:
        kinds[dtype(df, c)] = kinds.get(dtype(df, c), 0) + 1
    return {"profiles": data_profiling_report(df), "dtypes": report(df, sorted(kinds.items()), "dtype string, columns long"),
            "correlation": matrix(df, numeric_cols(df), safe_corr)}


def union_results(results: Mapping[str, DataFrame]) -> DataFrame:
    """Stack result tables of one schema with the name of their data set in ``source``."""
    parts = [d.withColumn("source", F.lit(name)) for name, d in results.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def steps_union(tables: Mapping[str, DataFrame], steps: Sequence[tuple[str, dict]]) -> DataFrame:
    """Run one operator chain on several tables and stack the results."""
    from quillframe.registry import run

    return union_results({name: run(d, steps) for name, d in tables.items()})
