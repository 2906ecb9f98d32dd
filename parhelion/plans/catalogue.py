"""Queries over the driver's tables and their SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from parhelion.operators import experiments, learners, losses, metrics, profile, sampling, shift
from parhelion.plans import diagnosis, extended
from parhelion.sources import adapters as src

PRIOR = 0.4
PRIORS = [0.1, 0.2, 0.33, 0.5, 0.8]
DOMAIN_PRIORS = {"source": 0.4, "target": 0.5}
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def queries() -> dict:
    s, v, t = src.scored, src.vectors, src.text_labels
    out = {n: (lambda spark, d, n=n: metrics.scalar_metric(s(spark, d), n, PRIOR)) for n in metrics.NAMES}
    return out | extended.queries() | diagnosis.queries() | {
        "pu_auc_roc": lambda spark, d: metrics.auc(s(spark, d)),
        "metric_panel": lambda spark, d: metrics.panel(s(spark, d), PRIOR),
        "average_precision": lambda spark, d: metrics.average_precision(s(spark, d)),
        "brier": lambda spark, d: metrics.brier(s(spark, d)),
        "normalize_pu_labels": lambda spark, d: profile.normalize_labels(t(spark, d), "y_pnu").groupBy("y_pu").agg(F.count("*").alias("n")),
        "label_value_audit": lambda spark, d: profile.label_audit(t(spark, d), "y_pnu"),
        "pu_summary": lambda spark, d: profile.pu_summary(s(spark, d)),
        "pnu_summary": lambda spark, d: profile.pnu_summary(t(spark, d)),
        "feature_statistics": lambda spark, d: profile.feature_statistics(s(spark, d), FEATURES),
        "profile_issues": lambda spark, d: profile.profile_issues(s(spark, d), "y_pu", 10**9, 3.0),
        "prediction_statistics": lambda spark, d: profile.prediction_statistics(s(spark, d)),
        "sensitivity_points": lambda spark, d: shift.sensitivity_points(s(spark, d), PRIORS),
        "sensitivity_ranges": lambda spark, d: shift.sensitivity_ranges(shift.sensitivity_points(s(spark, d), PRIORS)),
        "scar_labels": lambda spark, d: sampling.scar_labels(v(spark, d), 0.3, "vec_id"),
        "case_control_labels": lambda spark, d: sampling.case_control_labels(v(spark, d), 25, "vec_id"),
        "pnu_labels": lambda spark, d: sampling.pnu_labels(v(spark, d), 40, "vec_id"),
        "pu_kfold": lambda spark, d: sampling.kfold(v(spark, d), 5, "vec_id"),
        "pu_shuffle_split": lambda spark, d: sampling.shuffle_split(v(spark, d), 3, 0.25, "vec_id"),
        "rbf_center_sample": lambda spark, d: sampling.first_by_order(v(spark, d), 200, "vec_id"),
        "upu_risk_logistic": lambda spark, d: losses.upu_risk(s(spark, d), PRIOR),
        "upu_risk_squared": lambda spark, d: losses.upu_risk(s(spark, d), PRIOR, "squared"),
        "nnpu_risk": lambda spark, d: losses.nnpu_risk(s(spark, d), PRIOR),
        "pnu_risk": lambda spark, d: losses.pnu_risks(t(spark, d), PRIOR, 0.3),
        "risk_components": lambda spark, d: losses.risk_components(t(spark, d), PRIOR),
        "llsvm_calibration": lambda spark, d: losses.label_calibration(s(spark, d), PRIOR),
        "llsvm_objective": lambda spark, d: losses.llsvm_parts(s(spark, d)),
        "pu_smi": lambda spark, d: losses.smi_objective(s(spark, d)),
        "domain_assumptions": lambda spark, d: shift.domain_assumptions(src.domains(spark, d), DOMAIN_PRIORS),
        "domain_sensitivity_grid": lambda spark, d: shift.domain_sensitivity_grid(src.domains(spark, d), DOMAIN_PRIORS),
        "prior_logit_shift": lambda spark, d: shift.calibrate_prior(v(spark, d), PRIOR).select("vec_id", F.round("probability", 6).alias("probability")),
        "relative_weights": lambda spark, d: shift.importance_weights(v(spark, d)).select("vec_id", F.round("weight", 6).alias("weight")),
        "importance_weight_stats": lambda spark, d: shift.weight_statistics(shift.importance_weights(s(spark, d))),
        "monitor_windows": lambda spark, d: shift.monitor_windows(src.windows(spark, d)),
        "review_queue": lambda spark, d: shift.review_queue(v(spark, d), 20, "vec_id"),
        "selective_summary": lambda spark, d: shift.selective_summary(s(spark, d)),
        "trusted_set": lambda spark, d: shift.trusted_set(v(spark, d), 60, "vec_id"),
        "trial_summary": lambda spark, d: experiments.trial_summary(src.trials(spark, d), ["method"], ["price", "size"]),
        "duplicate_trials": lambda spark, d: experiments.duplicate_keys(src.trials(spark, d), ["method", "seed"]),
        "centroid_covariance": lambda spark, d: experiments.gram(v(spark, d), "features", [0, 1, 2]),
        "upu_squared_2f": lambda spark, d: learners.upu_squared(s(spark, d), PRIOR, "g", "l_discount"),
        "elkan_noto": lambda spark, d: learners.ElkanNoto("vec_id").fit(v(spark, d)).transform(v(spark, d)).select("vec_id", "probability", "prediction"),
    }


_SCORED = """WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
    CASE WHEN l_returnflag = 'R' AND substr(md5(concat('7:', l_orderkey, ':', l_linenumber, ':', l_partkey, ':', l_suppkey)), 1, 1) < '8' THEN 1 ELSE 0 END AS y_pu,
    l_quantity - 25 AS score, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS pred, (l_quantity - 25) / 10 AS g, 1 / (1 + exp(-(l_quantity - 25) / 10)) AS probability,
    l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
    a AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (y_pu = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (y_pu = 0) AS DOUBLE) AS u,
    CAST(count(*) FILTER (pred = 1) AS DOUBLE) AS hit, CAST(count(*) FILTER (y_pu = 1 AND pred = 1) AS DOUBLE) AS p_hit, CAST(count(*) FILTER (y_pu = 0 AND pred = 1) AS DOUBLE) AS u_hit,
    CAST(count(*) FILTER (y_pu = 1 AND score <= 0) AS DOUBLE) AS p_low, CAST(count(*) FILTER (y_pu = 0 AND score > 0) AS DOUBLE) AS u_high FROM s) """
_VECTORS = """WITH v AS (SELECT vec_id, embedding, CASE WHEN label < 3 THEN 1 ELSE 0 END AS y_true,
    CASE WHEN label < 3 AND substr(md5(concat('7:', vec_id)), 1, 1) < '8' THEN 1 ELSE 0 END AS y_pu, 1 / (1 + exp(-(CAST(embedding[1] AS DOUBLE) * 4))) AS probability FROM embeddings) """
_TEXT = """WITH t AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN -1 ELSE 0 END AS y_pnu, ln(n_chars + CAST(1 AS DOUBLE)) - 7 AS g FROM documents LEFT JOIN labels USING (doc_id)) """
_METRIC = {
    "pu_zero_one_risk": "CASE WHEN p = 0 OR u = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 2 * 0.4 * p_low / p + u_high / u - 0.4 END",
    "pu_recall": "CASE WHEN p = 0 THEN 0 ELSE p_hit / p END",
    "pu_estimated_precision": "CASE WHEN hit = 0 THEN 0 ELSE least(1, CAST(0.4 AS DOUBLE) * (p_hit / p) * n / hit) END",
    "pu_negative_rate": "CASE WHEN u = 0 THEN 0 ELSE (u - u_hit) / u END",
    "pu_accuracy": "(p_hit + u - u_hit) / n",
    "pu_f1": "CASE WHEN hit + p = 0 THEN 0 ELSE 2 * p_hit / (hit + p) END",
}
_AUC = """, b AS (SELECT score, CAST(count(*) FILTER (y_pu = 1) AS DOUBLE) AS bp, CAST(count(*) FILTER (y_pu = 0) AS DOUBLE) AS bu FROM s GROUP BY score),
    r AS (SELECT bp, bu, bp * (coalesce(sum(bu) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + bu / 2) AS won FROM b)"""
_GRID = _SCORED + """, grid AS (SELECT CAST(x AS DOUBLE) AS prior FROM (SELECT unnest([0.1, 0.2, 0.33, 0.5, 0.8]) AS x)),
    pts AS (SELECT prior, round(p / n / prior, 9) AS propensity, p / n / prior <= 1 + 1.7763568394002505e-15 AS consistent,
    round(CASE WHEN hit = 0 THEN 0 ELSE least(1, prior * (p_hit / p) * n / hit) END, 9) AS precision, round(2 * prior * (1 - p_hit / p) + u_hit / u - prior, 9) AS risk FROM a, grid) """
_SIG = "1 / (1 + exp({}))"


def _ranked(stratum: str) -> str:
    return _VECTORS + f", r AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY md5(concat('0:', vec_id)), vec_id) AS r, count(*) OVER (PARTITION BY {stratum}) AS n FROM v) "


def oracle_sql() -> dict[str, str]:
    one = {n: f"{_SCORED} SELECT round({e}, 9) AS {n} FROM a" for n, e in _METRIC.items()}
    auc = "round((SELECT sum(won) / (sum(bp) * sum(bu)) FROM r), 9)"
    mean = "avg({1}) FILTER (y_pu = {0})"
    soft = "greatest(g, 0) + ln(1 + exp(-abs(g)))"
    stat = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(0 AS BIGINT) + count(*) FILTER ({f} IS NULL OR isnan({f})) AS missing, count(*) FILTER (isinf({f})) AS infinite, min({f}) = max({f}) AS constant, min({f}) <> max({f}) AND var_pop({f}) <= 1e-12 AS low_variance, round(sqrt(var_pop({f})), 6) AS stddev FROM s" for f in FEATURES)
    quant = ", ".join(f"round(quantile_cont(weight, CAST({q} AS DOUBLE)), 6) AS {n}" for q, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95")))
    ratio = "least(greatest(probability, 1e-6), CAST(1 AS DOUBLE) - 1e-6)"
    raw = f"({ratio} / (1 - {ratio})) / (CAST(0.1 AS DOUBLE) * ({ratio} / (1 - {ratio})) + CAST(0.9 AS DOUBLE))"
    gram = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round((sum(CAST(embedding[{i + 1}] AS DOUBLE) * CAST(embedding[{j + 1}] AS DOUBLE)) - sum(CAST(embedding[{i + 1}] AS DOUBLE)) * sum(CAST(embedding[{j + 1}] AS DOUBLE))) / (CAST(count(*) AS DOUBLE) * count(*)), 6) AS value FROM v" for i in range(3) for j in range(3))
    ratio_of = "round(coalesce(CAST({0} AS DOUBLE) / nullif({1}, 0), CAST('Infinity' AS DOUBLE)), 9)"
    return one | extended.oracle_sql(_SCORED, _VECTORS, _TEXT) | diagnosis.oracle_sql(_SCORED) | {
        "pu_auc_roc": f"{_SCORED}{_AUC} SELECT {auc} AS pu_auc_roc",
        "metric_panel": f"{_SCORED}{_AUC} " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(CAST({e} AS DOUBLE), 9) AS value FROM a" for n, e in _METRIC.items()) + f" UNION ALL SELECT 'pu_auc_roc', {auc}",
        "average_precision": _SCORED + ", b AS (SELECT score, CAST(count(*) FILTER (y_true = 1) AS DOUBLE) AS bp, CAST(count(*) AS DOUBLE) AS bn FROM s GROUP BY score), r AS (SELECT bp, sum(bp) OVER w AS tp, sum(bn) OVER w AS seen FROM b WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT round(sum(bp * tp / seen) / sum(bp), 9) AS average_precision FROM r",
        "brier": _SCORED + "SELECT round(avg((probability - y_true) * (probability - y_true)), 9) AS brier FROM s",
        "normalize_pu_labels": _TEXT + "SELECT CAST(CASE WHEN y_pnu = 1 THEN 1 ELSE 0 END AS INTEGER) AS y_pu, count(*) AS n FROM t GROUP BY 1",
        "label_value_audit": _TEXT + "SELECT y_pnu AS value, count(*) AS n, y_pnu IN (-1, 0, 1) AS valid FROM t GROUP BY y_pnu",
        "pu_summary": _SCORED + f"SELECT CAST(n AS BIGINT) AS n_samples, CAST(p AS BIGINT) AS n_positives, CAST(u AS BIGINT) AS n_unlabeled, {ratio_of.format('u', 'p')} AS pu_ratio, round(p / n, 9) AS positive_fraction FROM a",
        "pnu_summary": _TEXT + f", c AS (SELECT count(*) AS k, count(*) FILTER (y_pnu = 1) AS p, count(*) FILTER (y_pnu = -1) AS n, count(*) FILTER (y_pnu = 0) AS u FROM t) SELECT k AS n_samples, p AS n_positives, n AS n_negatives, u AS n_unlabeled, {ratio_of.format('u', 'p')} AS pu_ratio, {ratio_of.format('u', 'n')} AS nu_ratio, {ratio_of.format('p', 'n')} AS pn_ratio FROM c",
        "feature_statistics": _SCORED + stat,
        "profile_issues": _SCORED + "SELECT 'no_labeled_positives' AS code, 'error' AS severity FROM a WHERE p = 0 UNION ALL SELECT 'few_labeled_positives', 'warning' FROM a WHERE p > 0 AND p < 1000000000 UNION ALL SELECT 'no_unlabeled_samples', 'error' FROM a WHERE u = 0 UNION ALL SELECT 'extreme_pu_imbalance', 'warning' FROM a WHERE p > 0 AND u > 3 * p",
        "prediction_statistics": _SCORED + "SELECT count(*) AS n, count(*) FILTER (pred = 1) AS n_positive, round(CAST(count(*) FILTER (pred = 1) AS DOUBLE) / count(*), 9) AS positive_fraction, count(score) AS n_finite, min(score) AS min_score, quantile_cont(score, CAST(0.5 AS DOUBLE)) AS median_score, max(score) AS max_score FROM s",
        "sensitivity_points": _GRID + "SELECT * FROM pts",
        "sensitivity_ranges": _GRID + "SELECT metric, min(value) AS low, max(value) AS high, round(max(value) - min(value), 9) AS span, count(value) AS n FROM (SELECT 'precision' AS metric, precision AS value FROM pts WHERE consistent UNION ALL SELECT 'risk', risk FROM pts WHERE consistent) GROUP BY metric",
        "scar_labels": _ranked("y_true") + "SELECT vec_id, CASE WHEN y_true = 1 AND r <= least(greatest(1, round_even(n * CAST(0.3 AS DOUBLE), 0)), n) THEN 1 ELSE 0 END AS y_pu FROM r",
        "case_control_labels": _ranked("y_true") + "SELECT vec_id, CASE WHEN y_true = 1 AND r <= 25 THEN 1 ELSE 0 END AS y_pu FROM r",
        "pnu_labels": _ranked("y_true") + "SELECT vec_id, CASE WHEN y_true = 1 THEN 1 WHEN r <= 40 THEN -1 ELSE 0 END AS y_pnu FROM r",
        "pu_kfold": _ranked("y_pu") + "SELECT vec_id, CAST((r - 1) % 5 AS INTEGER) AS fold FROM r",
        "pu_shuffle_split": _VECTORS + ", k AS (SELECT vec_id, y_pu, split FROM v, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS split)), r AS (SELECT *, row_number() OVER (PARTITION BY split, y_pu ORDER BY md5(concat('0:', split, ':', vec_id)), vec_id) AS r, count(*) OVER (PARTITION BY split, y_pu) AS n FROM k) SELECT split, vec_id, CASE WHEN r <= CASE WHEN y_pu = 1 THEN greatest(1, round_even(n * CAST(0.25 AS DOUBLE), 0)) ELSE round_even(n * CAST(0.25 AS DOUBLE), 0) END THEN 1 ELSE 0 END AS is_test FROM r",
        "rbf_center_sample": _VECTORS + "SELECT vec_id FROM v ORDER BY md5(concat('0:', vec_id)), vec_id LIMIT 200",
        "upu_risk_logistic": f"{_SCORED} SELECT round(-0.4 * {mean.format(1, 'g')} + {mean.format(0, soft)}, 6) AS risk FROM s",
        "upu_risk_squared": f"{_SCORED} SELECT round(-0.4 * {mean.format(1, 'g')} + {mean.format(0, '(g + 1) * (g + 1) / 4')}, 6) AS risk FROM s",
        "nnpu_risk": f"{_SCORED}, m AS (SELECT {mean.format(1, _SIG.format('g'))} AS ra, {mean.format(1, _SIG.format('-g'))} AS rb, {mean.format(0, _SIG.format('-g'))} AS rc FROM s) SELECT round(ra, 6) AS positive_risk, round(rc - 0.4 * rb, 6) AS negative_part, round(0.4 * ra + rc - 0.4 * rb, 6) AS upu, round(0.4 * ra + greatest(0, rc - 0.4 * rb), 6) AS nnpu FROM m",
        "pnu_risk": _TEXT + ", m AS (SELECT avg(g) FILTER (y_pnu = 1) AS p, avg(g) FILTER (y_pnu = -1) AS n, avg(g) FILTER (y_pnu = 0) AS u FROM t) SELECT round(-0.4 * p + 0.6 * n, 6) AS pn, round(-0.4 * p + u, 6) AS pu, round(0.6 * n - u, 6) AS nu, round(0.7 * (-0.4 * p + 0.6 * n) + 0.3 * (-0.4 * p + u), 6) AS mix FROM m",
        "llsvm_objective": _SCORED + "SELECT round(sum(greatest(1 - g, 0) * greatest(1 - g, 0)) FILTER (y_pu = 1), 4) AS hinge, round(sum(exp(-5 * g * g)) FILTER (y_pu = 0), 4) AS hat FROM s",
        "pu_smi": f"{_SCORED} SELECT round({mean.format(0, 'g * g')} / 2 - {mean.format(1, 'g')}, 6) AS pu_smi FROM s",
        "risk_components": _TEXT + ", m AS (SELECT avg(g) FILTER (y_pnu = 1) AS p, avg(g) FILTER (y_pnu = -1) AS n, avg(g) FILTER (y_pnu = 0) AS u FROM t) SELECT 'pn' AS component, round(-0.4 * p + 0.6 * n, 6) AS value FROM m UNION ALL SELECT 'pu', round(-0.4 * p + u, 6) FROM m UNION ALL SELECT 'nu', round(0.6 * n - u, 6) FROM m",
        "llsvm_calibration": _SCORED + "SELECT round(10 * avg(power(greatest(10 / pi() * atan(g) + 0.2, 0), 2)) FILTER (y_pu = 0), 6) AS calibration FROM s",
        "domain_sensitivity_grid": "WITH d AS (SELECT o_orderdate < TIMESTAMP '1998-01-01' AS src, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y FROM orders), r AS (SELECT CAST(sum(y) FILTER (src) AS DOUBLE) / count(*) FILTER (src) AS rs, CAST(sum(y) FILTER (NOT src) AS DOUBLE) / count(*) FILTER (NOT src) AS rt FROM d), a AS (SELECT CAST(unnest([0.35, 0.4, 0.45]) AS DOUBLE) AS ps), b AS (SELECT CAST(unnest([0.45, 0.5, 0.55]) AS DOUBLE) AS pt) SELECT round(ps, 9) AS source_prior, round(pt, 9) AS target_prior, round(rs / ps, 9) AS source_propensity, round(rt / pt, 9) AS target_propensity, round(rt / pt - rs / ps, 9) AS propensity_change FROM r, a, b",
        "domain_assumptions": "WITH d AS (SELECT o_orderdate < TIMESTAMP '1998-01-01' AS src, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y FROM orders), r AS (SELECT CAST(sum(y) FILTER (src) AS DOUBLE) / count(*) FILTER (src) AS rs, CAST(sum(y) FILTER (NOT src) AS DOUBLE) / count(*) FILTER (NOT src) AS rt FROM d) SELECT round(rs, 9) AS source_rate, round(rt, 9) AS target_rate, round(rs / CAST(0.4 AS DOUBLE), 9) AS source_propensity, round(rt / CAST(0.5 AS DOUBLE), 9) AS target_propensity, round(rt / CAST(0.5 AS DOUBLE) - rs / CAST(0.4 AS DOUBLE), 9) AS propensity_change, CASE WHEN rs > CAST(0.4 AS DOUBLE) OR rt > CAST(0.5 AS DOUBLE) THEN 'inconclusive' WHEN abs(rt / CAST(0.5 AS DOUBLE) - rs / CAST(0.4 AS DOUBLE)) >= 0.05 THEN 'both_shift' ELSE 'class_prior_shift' END AS conclusion FROM r",
        "relative_weights": f"{_VECTORS}, w AS (SELECT vec_id, {raw} AS raw FROM v) SELECT vec_id, round(raw / (SELECT avg(raw) FROM w), 6) AS weight FROM w",
        "importance_weight_stats": f"{_SCORED}, q AS (SELECT {raw} AS raw FROM s), w AS (SELECT raw / (SELECT avg(raw) FROM q) AS weight FROM q) SELECT round(min(weight), 6) AS min_weight, {quant}, round(max(weight), 6) AS max_weight, round(avg(weight), 6) AS mean_weight, round(sum(weight) * sum(weight) / sum(weight * weight), 4) AS ess, round(sum(weight) * sum(weight) / sum(weight * weight) / count(*), 6) AS ess_fraction FROM w",
        "monitor_windows": "WITH w AS (SELECT strftime(ts, '%Y-%m-%d') AS window_id, count(*) AS n, avg(CASE WHEN event_type = 'purchase' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS rate FROM events GROUP BY 1), c AS (SELECT *, rate - lag(rate) OVER (ORDER BY window_id) AS change FROM w) SELECT window_id, n, round(rate, 9) AS label_rate, round(change, 9) AS label_rate_change, CASE WHEN abs(change) >= 0.05 THEN 'warning' ELSE 'none' END AS level FROM c",
        "review_queue": _VECTORS + ", q AS (SELECT vec_id, 1 - 2 * abs(probability - CAST(0.5 AS DOUBLE)) AS uncertainty FROM v WHERE y_pu = 0) SELECT CAST(row_number() OVER (ORDER BY uncertainty DESC, vec_id) AS INTEGER) AS rank, vec_id, round(uncertainty, 9) AS uncertainty FROM q ORDER BY q.uncertainty DESC, vec_id LIMIT 20",
        "selective_summary": _SCORED + ", k AS (SELECT 2 * abs(probability - 0.5) >= 0.5 AS sure, (probability >= 0.5) = (y_true = 1) AS good FROM s) SELECT count(*) AS n, count(*) FILTER (sure) AS n_kept, round(CAST(count(*) FILTER (sure) AS DOUBLE) / count(*), 9) AS coverage, round(CAST(count(*) FILTER (sure AND good) AS DOUBLE) / count(*) FILTER (sure), 9) AS selective_accuracy FROM k",
        "trusted_set": _VECTORS + "SELECT vec_id, 'negative' AS side FROM (SELECT vec_id FROM v ORDER BY probability, vec_id LIMIT 30) UNION ALL SELECT vec_id, 'positive' FROM (SELECT vec_id FROM v ORDER BY probability DESC, vec_id DESC LIMIT 30)",
        "trial_summary": "WITH r AS (SELECT p_brand AS method, 'price' AS metric, p_retailprice AS value FROM part UNION ALL SELECT p_brand, 'size', CAST(p_size AS DOUBLE) FROM part) SELECT method, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n FROM r WHERE value IS NOT NULL GROUP BY method, metric",
        "duplicate_trials": "SELECT p_brand AS method, p_size AS seed, count(*) AS n FROM part GROUP BY p_brand, p_size HAVING count(*) > 1",
        "centroid_covariance": _VECTORS + gram,
        "upu_squared_2f": f"{_SCORED}, m AS (SELECT {mean.format(0, 'g * g')} / 2 + 0.01 AS m11, {mean.format(0, 'g * l_discount')} / 2 AS m12, {mean.format(0, 'l_discount * l_discount')} / 2 + 0.01 AS m22, 0.4 * {mean.format(1, 'g')} - {mean.format(0, 'g')} / 2 AS r1, 0.4 * {mean.format(1, 'l_discount')} - {mean.format(0, 'l_discount')} / 2 AS r2 FROM s) SELECT round((m22 * r1 - m12 * r2) / (m11 * m22 - m12 * m12), 6) AS w1, round((m11 * r2 - m12 * r1) / (m11 * m22 - m12 * m12), 6) AS w2 FROM m",
    }
