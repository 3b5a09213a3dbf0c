"""Queries of the sources and pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.plans import facts as X, features as P, prepare as R, search as S, train as T
from quillframe.queries.base import LI, NUM, TXT, query
from quillframe.queries.feature import LABELLED
from quillframe.queries.stats import KIND
from quillframe.registry import run
from quillframe.sources.io import read_parquet

FACTS = [*NUM, *TXT]
COLS = ", ".join(FACTS)


def fitted(build):
    """Fit on the whole table, then replay on it."""
    def go(t):
        d = t.facts
        steps, tables = build(d)
        return P.Fitted(steps, tables).transform(d)

    return go


def named(c: str) -> bool:
    return any(w in c for w in X.TARGET_WORDS)


def why(c: str) -> str:
    return "'" + ("last column; " if c == FACTS[-1] else "") + ("name suggests target; " if named(c) else "") + "'"


def r6(d, digits=6):
    return d.withColumns({c: F.round(c, digits) for c in d.columns if d.schema[c].dataType.simpleString() == "double"})


def r8(d):
    return r6(d, 8)


def scored(d):
    """Predictions made from the data themselves: the sign of the discount against the tax."""
    return d.where(F.col("l_quantity").isNotNull()).select((F.col("l_quantity") > 25).cast("double").alias("label"), (F.col("l_extendedprice") > 50000).cast("double").alias("prediction"))


CONF = LI + """, p AS (SELECT (l_quantity > 25)::INT y, (l_extendedprice > 50000)::INT h FROM li WHERE l_quantity IS NOT NULL),
 c AS (SELECT count(*)::DOUBLE n, count(*) FILTER (y=1 AND h=1)::DOUBLE tp, count(*) FILTER (y=0 AND h=0)::DOUBLE tn, count(*) FILTER (y=0 AND h=1)::DOUBLE fp, count(*) FILTER (y=1 AND h=0)::DOUBLE fn FROM p),
 m AS (SELECT *, tp/(tp+fp) p1, tp/(tp+fn) r1, tn/(tn+fn) p0, tn/(tn+fp) r0, (tp+fn)/n w1, (tn+fp)/n w0, (tp+tn)/n a, ((tp+fn)*(tp+fp) + (tn+fp)*(tn+fn))/(n*n) e FROM c) """
REG = LI + ", p AS (SELECT l_extendedprice y, l_quantity*1500 h FROM li WHERE l_quantity IS NOT NULL) "
MODES = "(SELECT l_returnflag FROM li WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
FILLED = LI + f", x AS (SELECT coalesce(l_quantity, (SELECT avg(l_quantity) FROM li)) AS l_quantity, l_extendedprice, l_discount, l_tax, coalesce(l_returnflag, {MODES}) AS l_returnflag, l_linestatus FROM li) "


def fence(c):
    return f"quantile_cont(CAST({c} AS DOUBLE), 0.25) - 1.5*(quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25))"


def prepared(mode):
    return lambda t: R.prepare(t.facts, "l_linestatus", mode).train.agg(F.count(F.lit(1)).alias("n"), F.sum("l_linestatus").cast("long").alias("ones"))


FRAME = "(SELECT DISTINCT " + COLS + " FROM li WHERE l_linestatus IS NOT NULL)"


def trained(t, **kw):
    return T.train(LABELLED(t), "quality", names=["logistic_regression", "decision_tree_clf"], folds=2, tune_top=1, **kw)


Q = {
    "sources.read_parquet": query(lambda t: read_parquet(t.spark, f"{t.folder}/nation.parquet"), "SELECT * FROM nation"),
    "plans.operator_chain": query(lambda t: run(t.lineitem, [("transform.filter", {"column": "l_quantity", "operator": ">", "value": 10}),
        ("transform.apply_expr", {"expression": "l_extendedprice * (1 - l_discount)", "new_name": "net"}), ("stats.group_stats", {"column": "l_returnflag", "value_column": "net"})]),
        """SELECT l_returnflag, count(*) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(median(v), 4) AS median, round(max(v), 4) AS max
        FROM (SELECT l_returnflag, l_extendedprice*(1 - l_discount) v FROM lineitem WHERE l_quantity > 10) GROUP BY 1"""),
    "plans.infer_dtypes": query(lambda t: R.infer_dtypes(t.orders.select(F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderstatus")),
        "SELECT o_orderkey::DOUBLE AS k, o_orderdate AS d, o_orderstatus FROM orders"),
    "plans.drop_unusable_columns": query(lambda t: (lambda d: d.drop(*R.unusable_columns(d)))(t.orders.withColumnRenamed("o_orderkey", "order_id").withColumn("one", F.lit(1))), "SELECT * EXCLUDE (o_orderkey) FROM orders"),
    "plans.fill_missing": query(lambda t: r6(fitted(lambda d: ([P.fit_fill(d)], {}))(t)), FILLED + "SELECT round(l_quantity, 6) AS l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM x"),
    "plans.clip_outliers": query(lambda t: r6(fitted(lambda d: ([P.fit_outliers(d, {"l_extendedprice": "winsorize"})], {}))(t)), LI + """, b AS (SELECT quantile_cont(l_extendedprice, 0.05) lo, quantile_cont(l_extendedprice, 0.95) hi FROM li)
        SELECT l_quantity, round(greatest(least(l_extendedprice, hi), lo), 6) AS l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM li, b"""),
    "plans.encode_categoricals": query(fitted(lambda d: (lambda s, tb: ([s], tb))(*P.fit_encode(d, {"l_returnflag": "onehot", "l_linestatus": "label"}))), LI + """SELECT l_quantity, l_extendedprice, l_discount, l_tax, (l_linestatus = 'O')::INT::DOUBLE AS l_linestatus,
        coalesce((l_returnflag = 'A')::INT, 0) AS l_returnflag_A, coalesce((l_returnflag = 'N')::INT, 0) AS l_returnflag_N, coalesce((l_returnflag = 'R')::INT, 0) AS l_returnflag_R FROM li"""),
    "plans.encode_frequency": query(lambda t: r6(fitted(lambda d: (lambda s, tb: ([s], tb))(*P.fit_encode(d.select(*FACTS), {"l_returnflag": "frequency", "l_linestatus": "none"})))(t)), LI + """SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus,
        round(CASE WHEN l_returnflag IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY l_returnflag)::DOUBLE/count(l_returnflag) OVER () END, 6) AS l_returnflag FROM li"""),
    "plans.encode_target": query(lambda t: r8(fitted(lambda d: (lambda s, tb: ([s], tb))(*P.fit_encode(d, {"l_returnflag": "target", "l_linestatus": "none"}, target="l_tax")))(t)), LI + """SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus,
        round(CASE WHEN l_returnflag IS NULL THEN avg(l_tax) OVER () ELSE avg(l_tax) OVER (PARTITION BY l_returnflag) END, 8) AS l_returnflag FROM li"""),
    "plans.scale_features": query(lambda t: r6(fitted(lambda d: ([P.fit_scale(d, "minmax", ["l_tax"])], {}))(t)), LI + "SELECT " + ", ".join(
        f"round(({c} - (SELECT min({c}) FROM li))/(SELECT max({c}) - min({c}) FROM li), 6) AS {c}" for c in NUM[:3]) + ", l_tax, l_returnflag, l_linestatus FROM li"),
    "plans.prepare_cleaning": query(lambda t: r6(R.prepare(t.facts, mode="cleaning").train), FILLED + "SELECT DISTINCT round(l_quantity, 6) AS l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM x"),
    "plans.prepare_clean": query(prepared("clean"), LI + f"SELECT count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS ones FROM {FRAME}"),
    "plans.prepare_full": query(prepared("full"), LI + f"""SELECT (SELECT sum(k - round_even(k*0.2, 0))::BIGINT FROM (SELECT count(*) k FROM {FRAME} GROUP BY l_linestatus)) AS n,
        (SELECT (k - round_even(k*0.2, 0))::BIGINT FROM (SELECT count(*) FILTER (l_linestatus = 'O') k FROM {FRAME})) AS ones"""),
    "plans.prepare_report": query(lambda t: R.prepare(t.facts, "l_linestatus", "clean").report),
    "plans.auto_clean": query(lambda t: r6(R.auto_clean(t.facts)[0]), LI + f""", d AS (SELECT DISTINCT {COLS} FROM li) SELECT round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM d)), 6) AS l_quantity, l_extendedprice, l_discount, l_tax,
        coalesce(l_returnflag, (SELECT l_returnflag FROM d WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag, l_linestatus FROM d"""),
    "plans.context_profile": query(lambda t: X.context_profile(t.facts), LI + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{'double' if c in NUM else 'string'}' AS dtype, round((count(*) - count({c}))*100.0/count(*), 1)::DOUBLE AS null_pct, count(DISTINCT {c}) AS \"unique\", false AS high_null, "
        f"{f'abs(skewness({c})) > 1' if c in NUM else 'false'} AS skewed, false AS high_cardinality, false AS constant, {'true' if c == 'l_extendedprice' else 'false'} AS suggested_target FROM li" for c in FACTS)),
    "plans.union_results": query(lambda t: X.steps_union({"a": t.orders, "b": t.orders.where("o_orderstatus = 'O'")}, [("stats.value_counts", {"column": "o_orderpriority"})]),
        " UNION ALL ".join(f"SELECT o_orderpriority, count(*) AS count, round(count(*)*100.0/sum(count(*)) OVER (), 2)::DOUBLE AS percentage, '{s}' AS source FROM orders {w} GROUP BY 1" for s, w in (("a", ""), ("b", "WHERE o_orderstatus = 'O'")))),
    "plans.strong_pairs": query(lambda t: X.strong_pairs(t.measures.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0.9), LI + """SELECT 'l_extendedprice' AS a, 'net' AS b, round(corr(l_extendedprice, l_extendedprice*(1 - l_discount)), 4) AS value FROM li"""),
    "plans.eda_overview": query(lambda t: X.eda_numbers(t.facts)["overview"], LI + ", s AS (SELECT count(*)::DOUBLE n, sum((l_quantity IS NULL)::INT + (l_returnflag IS NULL)::INT)::DOUBLE m FROM li) " + " UNION ALL ".join(
        f"SELECT '{k}' AS metric, ({e})::DOUBLE AS value FROM s" for k, e in {"rows": "n", "columns": "6", "missing_cells": "m", "completeness_pct": "round(100 - m/(n*6)*100, 1)",
        "duplicates": f"n - (SELECT count(*) FROM (SELECT DISTINCT {COLS} FROM li))", "numeric": "4", "categorical": "2"}.items())),
    "plans.target_candidates": query(lambda t: X.target_candidates(t.facts), LI + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", ({30 if c == 'l_linestatus' else 0} + {40 if named(c) else 0} + """ + (
            f"""CASE WHEN count(DISTINCT {c}) <= 10 THEN 15 ELSE 10 END)::BIGINT AS score, CASE WHEN count(DISTINCT {c}) <= 10 THEN 'classification' ELSE 'regression' END AS task_type,
            {why(c)} || CASE WHEN count(DISTINCT {c}) <= 10 THEN count(DISTINCT {c}) || ' discrete values' ELSE 'continuous numeric' END AS reason FROM li""" if c in NUM else
            f"""25)::BIGINT, 'classification', {why(c)} || count(DISTINCT {c}) || ' categories' FROM li HAVING count(DISTINCT {c}) BETWEEN 2 AND 20""") for c in FACTS)),
    "plans.categorical_balance": query(lambda t: X.categorical_balance(t.facts), LI + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_classes, max_by(v, k) AS dominant_value, round(max(k)*100.0/sum(k), 1)::DOUBLE AS dominant_pct, max(k)*100.0/sum(k) > 80 AS imbalanced FROM (SELECT coalesce({c}, '(null)') v, count(*) k FROM li GROUP BY 1)" for c in TXT)),
    "plans.ml_readiness": query(lambda t: X.ml_readiness(t.facts), LI + """, s AS (SELECT count(*)::DOUBLE n, round(100 - sum((l_quantity IS NULL)::INT + (l_returnflag IS NULL)::INT)::DOUBLE/(count(*)*6)*100, 1) c, (max(l_extendedprice) - min(l_extendedprice))/least(max(l_tax) - min(l_tax), max(l_discount) - min(l_discount)) w FROM li)
        SELECT 'sample_size' AS factor, n AS value, 0::BIGINT AS penalty FROM s UNION ALL SELECT 'feature_ratio', round(6/n, 3), 0 FROM s UNION ALL SELECT 'completeness', c, 0 FROM s UNION ALL
        SELECT 'scale_heterogeneity', round(w/10**floor(log10(w)))*10**floor(log10(w)), CASE WHEN w > 1e6 THEN 5 ELSE 0 END FROM s UNION ALL SELECT 'SCORE', 100 - CASE WHEN w > 1e6 THEN 5 ELSE 0 END, 0 FROM s"""),
    "plans.datetime_summary": query(lambda t: X.datetime_summary(t.events.select("ts")), """SELECT 'ts' AS "column", min(ts) AS min, max(ts) AS max, floor((epoch_us(max(ts)) - epoch_us(min(ts)))/86400000000.0)::BIGINT AS range_days, count(DISTINCT ts) AS n_unique,
        count(DISTINCT ts) = count(ts) AS unique_per_row FROM events"""),
    "plans.high_cardinality": query(lambda t: X.high_cardinality(t.customer), """SELECT 'c_name' AS "column", count(DISTINCT c_name) AS "unique", round(count(DISTINCT c_name)*100.0/count(*), 1)::DOUBLE AS pct_of_rows FROM customer"""),
    "plans.eda_report": query(lambda t: X.eda_report(t.facts)["dtypes"], "SELECT 'double' AS dtype, 4::BIGINT AS columns UNION ALL SELECT 'string', 2"),
    "plans.column_suggestions": query(lambda t: X.column_suggestions(t.facts), LI + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{KIND[c]}' AS dtype, """ + ("'numeric'" if c in NUM else f"CASE WHEN avg(length({c})) > 40 AND count(DISTINCT {c}) > 30 THEN 'text' ELSE 'categorical' END")
        + f""" AS role, round((count(*) - count({c}))*100.0/count(*), 1)::DOUBLE AS null_pct, count(DISTINCT {c}) AS n_unique, CASE WHEN count({c}) = count(*) THEN 'none'
            WHEN count({c}) < 0.4*count(*) THEN 'drop' ELSE """ + (f"CASE WHEN abs(avg(({c} - m)**3)/max(s)**3) > 1 THEN 'median' ELSE 'mean' END" if c in NUM else "'mode'")
        + " END AS null_strategy, " + ("NULL::VARCHAR" if c in NUM else f"CASE WHEN count(DISTINCT {c}) = 2 THEN 'label' WHEN count(DISTINCT {c}) BETWEEN 3 AND 50 THEN 'ordinal' WHEN count(DISTINCT {c}) > 50 THEN 'frequency' END")
        + f" AS encoding, CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant: drop' WHEN count({c}) < 0.4*count(*) THEN 'high null share' ELSE '' END AS note FROM li"
        + (f", (SELECT avg({c}) m, stddev_pop({c}) s FROM li)" if c in NUM else "") for c in FACTS)),
    "plans.task_and_targets": query(lambda t: X.task_and_targets(t.facts), LI + ", t AS (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) BETWEEN 2 AND 20 THEN 'classification' ELSE 'regression' END AS task,
        (CASE WHEN count(DISTINCT {c}) BETWEEN 2 AND 20 THEN {30 if c in NUM else 32} - count(DISTINCT {c}) ELSE 5 END)::BIGINT AS score FROM li
        HAVING count(DISTINCT {c}) > 1 AND count({c}) >= 0.2*count(*)""" + ("" if c in NUM else f" AND count(DISTINCT {c}) <= 20") for c in FACTS)
        + ") SELECT * FROM t WHERE task = (SELECT max_by(task, score) FROM t)"),
    "plans.derive": query(lambda t: r6(P.Fitted([P.fit_derive(t.measures, {"r": {"kind": "ratio", "columns": ["l_quantity", "l_tax"]}, "x": {"kind": "interaction", "columns": ["l_quantity", "l_tax"]}, "g": {"kind": "log", "columns": ["l_extendedprice"]}})]).transform(t.measures)),
        LI + "SELECT l_quantity, l_extendedprice, l_discount, l_tax, round(l_quantity/nullif(l_tax, 0), 6) AS r, round(l_quantity*l_tax, 6) AS x, round(ln(1 + l_extendedprice), 6) AS g FROM li"),
    "plans.zscore_remove": query(lambda t: P.Fitted([P.fit_outliers(t.series, {"value": "zscore_remove"})]).transform(t.series.select("event_id", "value")),
        "SELECT event_id, value FROM events WHERE value BETWEEN (SELECT avg(value) - 3*stddev_samp(value) FROM events) AND (SELECT avg(value) + 3*stddev_samp(value) FROM events)"),
    "plans.rank_and_select": query(lambda t: P.Fitted([P.fit_select(t.facts, "l_tax", "variance", 2)]).transform(t.facts), LI + "SELECT l_quantity, l_extendedprice, l_tax, l_returnflag, l_linestatus FROM li"),
    "plans.reduce": query(lambda t: P.Fitted([P.fit_reduce(t.measures, 2)]).transform(t.measures.na.drop())),
    "plans.feature_pipeline": query(lambda t: r6(P.fit_pipeline(t.facts, P.FeatureConfig(target="l_tax", encode_default="ordinal", scale="standard", outliers={"l_extendedprice": "iqr_clip"})).transform(t.facts)).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.abs(F.avg("l_quantity")), 4).alias("m"), F.round(F.stddev_pop("l_returnflag"), 4).alias("s")), LI + "SELECT count(*) AS n, 0.0::DOUBLE AS m, 1.0::DOUBLE AS s FROM li"),
    "plans.task_detection": query(lambda t: t.spark.createDataFrame([(c, T.detect_task(t.facts, c)) for c in ("l_returnflag", "l_extendedprice", "l_quantity")], "target string, task string"),
        LI + """SELECT 'l_returnflag' AS target, 'classification' AS task UNION ALL SELECT 'l_extendedprice', (SELECT CASE WHEN count(DISTINCT l_extendedprice) > 20 THEN 'regression' ELSE 'classification' END FROM li)
        UNION ALL SELECT 'l_quantity', (SELECT CASE WHEN count(DISTINCT l_quantity) > 20 THEN 'regression' ELSE 'classification' END FROM li)"""),
    "plans.classification_metrics": query(lambda t: T.classification_metrics(scored(t.li)), CONF + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({e}, 6) AS value FROM m" for k, e in {
        "accuracy": "a", "precision": "w1*p1 + w0*p0", "recall": "w1*r1 + w0*r0", "f1": "w1*2*p1*r1/(p1+r1) + w0*2*p0*r0/(p0+r0)", "kappa": "(a-e)/(1-e)", "mcc": "(tp*tn - fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))"}.items())),
    "plans.confusion_matrix": query(lambda t: T.confusion_matrix(scored(t.li)), CONF + "SELECT y::DOUBLE AS label, h::DOUBLE AS prediction, count(*) AS count FROM p GROUP BY 1, 2"),
    "plans.class_report": query(lambda t: T.class_report(scored(t.li)), CONF + """SELECT 1.0::DOUBLE AS class, round(p1, 6) AS precision, round(r1, 6) AS recall, round(2*p1*r1/(p1+r1), 6) AS f1, (tp+fn)::BIGINT AS support FROM m UNION ALL
        SELECT 0.0, round(p0, 6), round(r0, 6), round(2*p0*r0/(p0+r0), 6), (tn+fp)::BIGINT FROM m"""),
    "plans.regression_metrics": query(lambda t: T.regression_metrics(t.li.where("l_quantity is not null").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))), REG + " UNION ALL ".join(
        f"SELECT '{k}' AS metric, round({e}, 6) AS value FROM p" for k, e in {"rmse": "sqrt(avg((y-h)*(y-h)))", "mae": "avg(abs(y-h))", "r2": "1 - avg((y-h)*(y-h))/var_pop(y)", "adjusted_r2": "1 - avg((y-h)*(y-h))/var_pop(y)*(count(*)-1)/(count(*)-2)",
        "mape": "avg(abs(y-h)/abs(y))*100", "explained_variance": "1 - var_pop(y-h)/var_pop(y)"}.items())),
    "plans.score_curve": query(lambda t: T.score_curve(t.li.where("l_quantity is not null").select((F.col("l_quantity") > 25).cast("double").alias("label"), "l_discount"), F.col("l_discount"), 20), LI + """, g AS (SELECT least(floor(l_discount*20), 19)::INT s, count(*)::DOUBLE n, sum((l_quantity > 25)::INT)::DOUBLE p FROM li WHERE l_quantity IS NOT NULL GROUP BY 1),
        w AS (SELECT s, sum(n) OVER (ORDER BY s DESC) n, sum(p) OVER (ORDER BY s DESC) p, sum(n) OVER () tn, sum(p) OVER () tp FROM g) SELECT s/20.0::DOUBLE AS threshold, round((n-p)/(tn-tp), 6) AS false_positive_rate, round(p/tp, 6) AS recall, round(p/n, 6) AS precision FROM w"""),
    "plans.clustering_metrics": query(lambda t: T.clustering_metrics(t.measures.na.drop().withColumn("prediction", (F.col("l_quantity") > 25).cast("int")), ["l_quantity", "l_tax"])),
    "plans.residuals": query(lambda t: T.residual_frame(t.li.where("l_quantity is not null").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")))),
    "plans.residual_histogram": query(lambda t: r6(T.residual_histogram(t.li.where("l_quantity is not null").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")))), REG + """,
        b AS (SELECT min(y-h) lo, (max(y-h) - min(y-h))/30 w FROM p), s AS (SELECT least(floor(((y-h) - lo)/w), 29)::INT AS bin, lo, w FROM p, b)
        SELECT bin, round(any_value(lo) + bin*any_value(w), 6) AS start, count(*) AS count FROM s GROUP BY bin"""),
    "plans.cluster_sizes": query(lambda t: T.cluster_sizes(t.li.withColumn("prediction", F.floor(F.col("l_quantity") / 10).cast("int") - 1)),
        LI + "SELECT floor(l_quantity/10)::INT - 1 AS cluster, count(*) AS count, round(count(*)/sum(count(*)) OVER (), 6) AS share FROM li WHERE l_quantity >= 10 GROUP BY 1"),
    "plans.learning_curve": query(lambda t: T.learning_curve(T.preprocess(t.part.select("p_size", "p_brand", "p_retailprice"), "p_retailprice", "regression"), "regression", "ridge")),
    "plans.search_tuning": query(lambda t: S.search(T.preprocess(t.part.select("p_size", "p_brand", "p_retailprice"), "p_retailprice", "regression"), "regression", "decision_tree_reg", trials=6).trials),
    "plans.train": query(lambda t: trained(t).comparison),
    "plans.predict": query(lambda t: trained(t).predict(LABELLED(t)).groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))),
    "plans.train_regression": query(lambda t: T.train(t.part.select("p_size", "p_brand", "p_retailprice"), "p_retailprice", "regression", names=["ridge", "decision_tree_reg"], folds=2, tune_top=1).comparison),
    "plans.train_clusters": query(lambda t: T.train_clusters(t.customer.select("c_acctbal", "c_nationkey", "c_mktsegment"), ["kmeans", "gaussian_mixture", "dbscan", "hierarchical"]).comparison),
    "plans.auto_features": query(lambda t: P.auto_features(t.measures.withColumn("twin", F.col("l_extendedprice") * 2), "l_tax").transform(t.measures.withColumn("twin", F.col("l_extendedprice") * 2)), LI + "SELECT l_quantity, l_extendedprice, l_tax FROM li"),
}
