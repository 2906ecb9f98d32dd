"""Queries over the driver's tables: diagnostics, sensitivity, splits, trials, term weights, report cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from parhelion.operators import diagnostics, experiments, inference, registry
from parhelion.sources import adapters as src
from parhelion.sources import files, reports

PRIORS, PROPENSITIES = [0.05, 0.3, 0.7], [0.1, 0.5, 1.0]


def _splits(spark, d):
    o = src.table(spark, d, "orders").select("o_orderkey")
    return {"train": o.filter("o_orderkey % 3 = 0"), "valid": o.filter("o_orderkey % 5 = 0"), "test": o.filter("o_orderkey % 2 = 0")}


def _terms(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "text")
    found = files.term_weights(docs, docs, "doc_id", "text", 100)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("largest"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squares"))


def queries() -> dict:
    s = src.scored
    epochs = lambda spark: spark.range(12).select(F.col("id").cast("int").alias("epoch"))
    plan = lambda spark: inference.sampling_plan(spark, [400, 800], [0.2, 0.4, 0.6, 0.8], 3, 500, 500, 100)
    return {
        "diagnostic_metrics": lambda spark, d: diagnostics.diagnostic_metrics(s(spark, d), 0.4, truth="y_true"),
        "diagnostic_metrics_unaudited": lambda spark, d: diagnostics.diagnostic_metrics(s(spark, d), None, score=None),
        "prediction_issues": lambda spark, d: diagnostics.prediction_issues(s(spark, d).withColumns({"pred": F.lit(1), "score": F.lit(2.0)})),
        "sensitivity_two_axes": lambda spark, d: diagnostics.sensitivity(s(spark, d), PRIORS, PROPENSITIES),
        "sensitivity_spans": lambda spark, d: diagnostics.sensitivity_spans(diagnostics.sensitivity(s(spark, d), PRIORS, PROPENSITIES)),
        "scar_diagnostic": lambda spark, d: spark.createDataFrame([diagnostics.scar_diagnostic(src.vectors(spark, d).select("vec_id", "y_pu", "y_true", *[F.col("features")[i].cast("double").alias(f"f{i}") for i in range(64)]), "y_pu", [f"f{i}" for i in range(64)], "vec_id", "y_true")], "separability_auc double, status string, evidence string, is_identifying boolean"),
        "trust_schedule": lambda spark, d: epochs(spark).select("epoch", diagnostics.trust_target(F.col("epoch"), 3, 9, 1000).alias("target")),
        "positive_probability": lambda spark, d: diagnostics.positive_probability(s(spark, d), "g").groupBy("l_quantity").agg(F.round(F.max("p"), 9).alias("p")),
        "unit_probability": lambda spark, d: diagnostics.positive_probability(s(spark, d), "l_discount").groupBy("l_discount").agg(F.round(F.max("p"), 9).alias("p")),
        "split_overlap": lambda spark, d: diagnostics.overlap_audit(_splits(spark, d), "o_orderkey"),
        "best_trials": lambda spark, d: diagnostics.best_trials(src.trials(spark, d), ["method"], "seed", "price", True),
        "shard_summary": lambda spark, d: experiments.trial_summary(src.trials(spark, d).withColumn("shard", F.col("seed") % 4), ["method", "shard"], ["price"]),
        "plan_summary": lambda spark, d: diagnostics.plan_summary(plan(spark), ["prior"]),
        "method_warnings": lambda spark, d: diagnostics.method_warnings(registry.methods(spark, trainable_only=True), "at_risk"),
        "max_scaled": lambda spark, d: files.max_scaled(s(spark, d), ["l_quantity", "l_tax"]).agg(F.round(F.max("l_quantity"), 9).alias("top_quantity"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.avg("l_tax"), 6).alias("mean_tax")),
        "positive_class": lambda spark, d: src.table(spark, d, "embeddings").select("vec_id", files.positive_class("usps", F.col("label")).alias("odd"), files.positive_class("mushrooms", F.col("label")).alias("two"), files.positive_class("", F.col("label")).alias("one")),
        "term_weights": _terms,
        "report_cells": lambda spark, d: src.table(spark, d, "supplier").select("s_suppkey", reports.value_text(F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))).alias("balance"), reports.cell_text(F.concat("s_name", F.lit("|\n"))).alias("name"), reports.finite_or_null(F.when(F.col("s_suppkey") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("s_acctbal"))).alias("finite")),
    }


def oracle_sql(scored: str) -> dict[str, str]:
    """SQL of the queries; scored is the common table expression of the scored rows (s)."""
    real = lambda x: f"CAST({x} AS DOUBLE)"
    one = scored + ", o AS (SELECT " + ", ".join(f"{real(f'count(*) FILTER ({c})')} AS {n}" for n, c in {"k": "true", "kp": "y_pu = 1", "ku": "y_pu = 0", "kh": "pred = 1", "kph": "y_pu = 1 AND pred = 1", "kuh": "y_pu = 0 AND pred = 1", "kt": "y_true = 1", "kth": "y_true = 1 AND pred = 1", "kr": "y_true = pred"}.items()) + " FROM s) "
    area = ", b AS (SELECT score, CAST(count(*) FILTER (y_true = 1) AS DOUBLE) AS bp, CAST(count(*) FILTER (y_true = 0) AS DOUBLE) AS bu FROM s GROUP BY score), r AS (SELECT bp, bu, coalesce(sum(bu) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b), e AS (SELECT sum(bp * (before + bu / 2)) / (sum(bp) * sum(bu)) AS area FROM r) "
    line = lambda m, v, b: f"SELECT '{m}' AS metric, round(CAST({v} AS DOUBLE), 9) AS value, '{b}' AS basis, CAST(NULL AS VARCHAR) AS reason FROM o, e"
    none = lambda m, why: f"SELECT '{m}' AS metric, CAST(NULL AS DOUBLE) AS value, 'unavailable' AS basis, '{why}' AS reason"
    observed = [("labeled_positive_recall", "kph / kp"), ("unlabeled_negative_rate", "(ku - kuh) / ku"), ("predicted_positive_rate", "kh / k")]
    known = [line(m, v, "pu_observed") for m, v in observed]
    assumed = [("pu_estimated_precision", f"least({real(1)}, {real(0.4)} * (kph / kp) * k / kh)"), ("pu_zero_one_risk", f"{real(0.8)} * (1 - kph / kp) + kuh / ku - {real(0.4)}")]
    true = [("accuracy", "kr / k"), ("f1", "2 * kth / (kh + kt)"), ("roc_auc", "area")]
    full = known + [line(m, v, "class_prior_dependent") for m, v in assumed] + [line(m, v, "supervised_oracle") for m, v in true]
    bare = known + [none(m, "no_class_prior") for m, _ in assumed] + [none(m, "no_true_labels") for m, _ in true]
    grid = "SELECT axis, v, CASE WHEN axis = 'class_prior' THEN v ELSE kp / k / v END AS pi, kp / k / v AS implied, k, ku, kh, kuh, kph / kp AS recall FROM o, (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, {real(v)} AS v" for a, vs in (("class_prior", PRIORS), ("label_propensity", PROPENSITIES)) for v in vs) + ")"
    points = one + f", g AS ({grid}), pts AS (SELECT axis, v AS grid_value, round(pi, 9) AS class_prior, round(CASE WHEN axis = 'class_prior' THEN implied ELSE v END, 9) AS label_propensity, implied <= 1 + 1e-12 AS is_consistent, CASE WHEN pi > 0 AND pi < 1 THEN round(least({real(1)}, pi * recall * k / kh), 9) END AS precision, CASE WHEN pi > 0 AND pi < 1 THEN round(2 * pi * (1 - recall) + kuh / ku - pi, 9) END AS risk FROM g) "
    trials = "WITH r AS (SELECT p_brand AS method, p_size AS seed, p_retailprice AS price FROM part) "
    plan = "WITH u AS (SELECT CAST(unnest([400, 800]) AS INTEGER) AS n_unlabeled), q AS (SELECT CAST(unnest([0.2, 0.4, 0.6, 0.8]) AS DOUBLE) AS prior), z AS (SELECT prior, n_unlabeled, CAST(round_even(n_unlabeled * prior, 0) AS INTEGER) AS need FROM u, q, (SELECT unnest([0, 1, 2]))) "
    trainable = [m for m in registry.METHODS if m[2] != "class_prior_estimation"]
    warned = [(m[0], code) for m in trainable for code, on in (("scar_may_not_hold", m[4] == "scar"), ("experimental", m[8] == "experimental"), ("class_prior_sensitive", m[5])) if on]
    terms = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]{2,})', 1)) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), t AS (SELECT term, ln((1 + (SELECT CAST(count(*) AS DOUBLE) FROM documents)) / (1 + count(*))) + 1 AS idf, sum(tf) AS total FROM c GROUP BY term ORDER BY total DESC, term LIMIT 100), x AS (SELECT doc_id, tf * idf AS w FROM c JOIN t USING (term)), y AS (SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x) SELECT doc_id, count(*) AS n_terms, round(max(w), 6) AS largest, round(sum(w * w), 6) AS squares FROM y GROUP BY doc_id"
    sets = {"train": 3, "valid": 5, "test": 2}
    pairs = [("train", "valid"), ("train", "test"), ("valid", "test")]
    return {
        "diagnostic_metrics": one + area + " UNION ALL ".join(full),
        "diagnostic_metrics_unaudited": one + area + " UNION ALL ".join(bare),
        "prediction_issues": "SELECT 'constant_predictions' AS code, 'warning' AS severity UNION ALL SELECT 'constant_scores', 'warning'",
        "sensitivity_two_axes": points + "SELECT * FROM pts",
        "sensitivity_spans": points + "SELECT axis, metric, min(value) AS low, max(value) AS high, round(max(value) - min(value), 9) AS span, count(value) AS n FROM (SELECT axis, 'precision' AS metric, precision AS value FROM pts WHERE is_consistent UNION ALL SELECT axis, 'risk', risk FROM pts WHERE is_consistent) GROUP BY axis, metric",
        "trust_schedule": "SELECT CAST(e AS INTEGER) AS epoch, CAST(CASE WHEN e < 3 THEN 0 WHEN e >= 9 THEN 1000 ELSE (e - 3) * 1000 // 6 END AS BIGINT) AS target FROM range(12) t(e)",
        "positive_probability": scored + "SELECT l_quantity, round(max(1 / (1 + exp(-g))), 9) AS p FROM s GROUP BY l_quantity",
        "unit_probability": scored + "SELECT l_discount, round(CAST(l_discount AS DOUBLE), 9) AS p FROM s GROUP BY l_discount",
        "split_overlap": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderkey % {sets[a]} = 0 AND o_orderkey % {sets[b]} = 0" for a, b in pairs),
        "best_trials": trials + "SELECT method, seed, CAST(price AS DOUBLE) AS price FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY price DESC, seed) AS i FROM r) WHERE i = 1",
        "plan_summary": plan + "SELECT prior, count(*) AS n, count(*) FILTER (need + 100 <= 500 AND n_unlabeled - need <= 500) AS n_feasible, count(*) FILTER (NOT (need + 100 <= 500 AND n_unlabeled - need <= 500)) AS n_infeasible FROM z GROUP BY prior",
        "method_warnings": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in warned) + ") AS w(name, code)",
        "max_scaled": scored + "SELECT round(CAST(max(l_quantity) / max(l_quantity) AS DOUBLE), 9) AS top_quantity, round(avg(CAST(l_quantity AS DOUBLE)) / max(CAST(l_quantity AS DOUBLE)), 6) AS mean_quantity, round(avg(CAST(l_tax AS DOUBLE)) / max(CAST(l_tax AS DOUBLE)), 6) AS mean_tax FROM s",
        "positive_class": "SELECT vec_id, CAST(label % 2 = 1 AS INTEGER) AS odd, CAST(label = 2 AS INTEGER) AS two, CAST(label = 1 AS INTEGER) AS one FROM embeddings",
        "term_weights": terms,
        "report_cells": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'unavailable' ELSE format('{:.6f}', CAST(s_acctbal AS DOUBLE)) END AS balance, s_name || '\\| ' AS name, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_acctbal AS DOUBLE) END AS finite FROM supplier",
    }
