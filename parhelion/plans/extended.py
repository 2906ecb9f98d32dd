"""Further queries over the driver's tables: validation, priors, learners, audits, experiments, methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from parhelion.operators import audit, inference, linear, priors, registry, selection, validation
from parhelion.sources import adapters as src

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIR = ["f0", "f1"]
THETAS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
POOLS = {"unlabeled": [400, 800], "priors": [0.2, 0.4, 0.6, 0.8], "repetitions": 3, "positives": 500, "negatives": 500, "labeled": 100}


def _pair(spark, d):
    """The vectors with their first two components as columns."""
    v = src.vectors(spark, d)
    return v.select("vec_id", "y_true", "y_pu", "probability", *[F.col("features")[i].cast("double").alias(f) for i, f in enumerate(PAIR)])


def _summary(spark, d):
    s = src.scored(spark, d)
    weights = audit.weight_summary(audit.density_weights(s, "probability", 1, 2))
    rates = s.agg(F.avg(F.col("y_pu").cast("double")).alias("source_rate"), F.avg(F.col("y_true").cast("double")).alias("target_rate"))
    return weights.crossJoin(F.broadcast(rates)).withColumn("severity", audit.severity(F.lit(0.7)))


def _windows(spark, d):
    w = src.windows(spark, d).groupBy("window_id").agg(F.count("*").alias("n"), F.avg(F.col("y_pu").cast("double")).alias("label_rate"))
    auc = 0.5 + F.col("label_rate")
    return audit.alerts(w.withColumns({"domain_auc": auc, "severity": audit.severity(auc), "adaptation_ready": F.col("n") % 3 != 0}), "window_id")


def _weights(spark, model, names):
    return spark.createDataFrame([(n, float(w)) for n, w in zip([*names, "bias"], model.weights)], "feature string, weight double").select("feature", F.round("weight", 6).alias("weight"))


def _bootstrap(spark, d):
    t = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderdate") < "1998-01-01", "source").otherwise("target").alias("domain"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y_pu"))
    return audit.percentile_interval(audit.bootstrap_rates(t, "domain", "y_pu"), ["domain"], "rate")


def _domain_auc(spark, d):
    p = _pair(spark, d)
    from parhelion.operators import metrics

    both = audit.domain_scores(audit.with_domain(p.filter("y_true = 0"), p.filter("y_true = 1")), PAIR, "vec_id")
    auc = metrics.auc(both.select(F.col("domain").alias("y_pu"), F.col("p").alias("score")))
    return auc.select(audit.separability(F.col("pu_auc_roc")).alias("domain_auc"))


def _scored_by(model, spark, d):
    p = _pair(spark, d)
    return model.fit(p).transform(p).select("vec_id", F.round("score", 6).alias("score"), "prediction")


def _prior(spark, name, value):
    return spark.createDataFrame([(name, float(value))], "estimator string, prior double")


def _recpe(spark, d):
    p = _pair(spark, d)
    again = priors.regrouped(p, "y_pu", "probability", "vec_id")
    return _prior(spark, "recpe", priors.kernel_mean(again, "y_regrouped", PAIR, "vec_id"))


def queries() -> dict:
    s, t, pair = src.scored, src.text_labels, _pair
    trials = src.trials
    return {
        "normalize_pnu_labels": lambda spark, d: validation.normalize_pnu(t(spark, d), "y_pnu", "y").groupBy("y").agg(F.count("*").alias("n")),
        "validate_pu": lambda spark, d: validation.pu_report(s(spark, d), "y_pu", FEATURES),
        "validate_pnu": lambda spark, d: validation.pnu_report(t(spark, d), "y_pnu", ["g"]),
        "audit_label_consistency": lambda spark, d: validation.true_label_report(s(spark, d), "y_true", "y_pu"),
        "weight_audit": lambda spark, d: validation.weight_report(s(spark, d), "l_tax"),
        "prior_quantile_predict": lambda spark, d: priors.prior_quantile_predict(pair(spark, d), "probability", 0.3).select("vec_id", "prediction"),
        "regrouped_positives": lambda spark, d: priors.regrouped(pair(spark, d), "y_pu", "probability", "vec_id").select("vec_id", "y_regrouped"),
        "rbf_means": lambda spark, d: priors.rbf_means(pair(spark, d), PAIR, priors.first_rows(pair(spark, d), PAIR, 20, "vec_id"), 0.5, "y_pu").select("y_pu", "center", F.round("mean", 6).alias("mean")),
        "pen_l1_objective": lambda spark, d: priors.penalized_objective(priors.rbf_means(pair(spark, d), PAIR, priors.first_rows(pair(spark, d), PAIR, 20, "vec_id"), 0.5, "y_pu"), "y_pu", THETAS).select("theta", F.round("objective", 5).alias("objective")),
        "pen_l1_prior": lambda spark, d: _prior(spark, "pen_l1", priors.pen_l1(pair(spark, d), "y_pu", PAIR, "vec_id")),
        "km2": lambda spark, d: _prior(spark, "km2", priors.kernel_mean(pair(spark, d), "y_pu", PAIR, "vec_id")),
        "recpe": _recpe,
        "sar_projection": lambda spark, d: selection.projection(pair(spark, d), "y_true", PAIR, [3.0, 4.0]).select("vec_id", F.round("projection", 6).alias("projection")),
        "sar_propensity_mean": lambda spark, d: selection.sar_propensity(pair(spark, d), "y_true", PAIR, "nonlinear", 0.3, 2.0).filter("y_true = 1").agg(F.round(F.avg("propensity"), 6).alias("mean_propensity")),
        "sar_bernoulli_labels": lambda spark, d: selection.bernoulli_labels(pair(spark, d).withColumn("propensity", F.col("y_true") * F.col("probability")), "propensity", "vec_id").select("vec_id", "y_pu"),
        "pnu_closed_form": lambda spark, d: _weights(spark, linear.PNU(["g"], class_prior=0.4, eta=0.3).fit(t(spark, d)), ["g"]),
        "nnpu_linear": lambda spark, d: _scored_by(linear.NonNegativePU(PAIR, class_prior=0.3), spark, d),
        "upu_logistic": lambda spark, d: _scored_by(linear.LogisticUPU(PAIR, class_prior=0.3), spark, d),
        "pusb": lambda spark, d: _scored_by(linear.BiasedPU(PAIR), spark, d),
        "lbe": lambda spark, d: _scored_by(linear.LabelingBias(PAIR, rounds=3), spark, d),
        "domain_auc": _domain_auc,
        "shift_issues": lambda spark, d: audit.shift_issues(_summary(spark, d)),
        "shift_weight_summary": lambda spark, d: _summary(spark, d).drop("severity", "source_rate", "target_rate"),
        "shift_alerts": lambda spark, d: _windows(spark, d).select("window_id", "auc_change", "label_rate_change", "codes", "level"),
        "domain_bootstrap": _bootstrap,
        "t_interval": lambda spark, d: inference.t_intervals(trials(spark, d), ["method"], "price"),
        "paired_summary": lambda spark, d: inference.paired_summary(trials(spark, d).withColumn("other", F.col("size") * 50), ["method"], "price", "other"),
        "fold_summary": lambda spark, d: inference.fold_summary(trials(spark, d), ["method"], "size"),
        "trial_key_audit": lambda spark, d: inference.key_audit(trials(spark, d).filter("seed % 2 = 0"), trials(spark, d).filter("seed % 3 = 0"), ["method", "seed"]),
        "strict_trial_audit": lambda spark, d: inference.strict_audit(trials(spark, d), ["method", "seed"], ["price", "size"], ["method"], 8),
        "sampling_plan": lambda spark, d: inference.sampling_plan(spark, **{**POOLS, "priors": POOLS["priors"]}),
        "sampling_audit": lambda spark, d: inference.sampling_audit(inference.sampling_plan(spark, **POOLS)),
        "spearman": lambda spark, d: inference.spearman(s(spark, d), "l_quantity", "l_discount"),
        "list_methods": lambda spark, d: registry.methods(spark, assumption="sar").select("position", "name", "family", "requires_prior", "backend"),
        "score_parts": lambda spark, d: registry.score_parts(registry.methods(spark, trainable_only=True), 500, "at_risk", True, None, True, True),
        "recommend_topk": lambda spark, d: registry.recommend(spark, 5000, None, top=5),
        "resolve_aliases": lambda spark, d: registry.resolved(spark.createDataFrame([(x,) for x in ("NN-PU", "ldce", "wconpu", "nobody", "PUSB")], "alias string"), "alias").select("alias", "method"),
    }


def oracle_sql(scored: str, vectors: str, text: str) -> dict[str, str]:
    """SQL of the queries; the arguments are the common table expressions of the roles (s, v, t)."""
    pair = vectors + ", p AS (SELECT vec_id, y_true, y_pu, probability, CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1 FROM v) "
    trials = "WITH r AS (SELECT p_brand AS method, p_size AS seed, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size FROM part) "
    centers = pair + ", c AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS center, f0 AS a, f1 AS b FROM (SELECT * FROM p ORDER BY vec_id LIMIT 20)), k AS (SELECT y_pu, center, avg(exp(-(((f0 - a) * (f0 - a)) + ((f1 - b) * (f1 - b))) / CAST(0.5 AS DOUBLE))) AS mean FROM p, c GROUP BY y_pu, center) "
    weights = "least(greatest(probability, 1e-6), CAST(1 AS DOUBLE) - 1e-6)"
    ratio = f"({weights} / (1 - {weights})) * CAST(0.5 AS DOUBLE)"
    summary = scored + f", q AS (SELECT {ratio} / (CAST(0.1 AS DOUBLE) * {ratio} + CAST(0.9 AS DOUBLE)) AS raw, probability < 1e-6 OR probability > CAST(1 AS DOUBLE) - 1e-6 AS clipped FROM s), z AS (SELECT sum(raw) * sum(raw) / sum(raw * raw) / count(*) AS effective_fraction, avg(CASE WHEN clipped THEN CAST(1 AS DOUBLE) ELSE 0 END) AS clip_fraction, avg(CASE WHEN raw >= CAST(0.99 AS DOUBLE) / CAST(0.1 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS boundary_fraction, avg(raw) AS raw_mean FROM q), g AS (SELECT avg(CAST(y_pu AS DOUBLE)) AS source_rate, avg(CAST(y_true AS DOUBLE)) AS target_rate FROM s) "
    methods = ", ".join(f"({i}, '{m[0]}', '{m[2]}', '{m[4]}', {str(m[5]).lower()}, {str(m[6]).lower()}, '{m[7]}', '{m[8]}', '{m[9]}', '{m[10]}')" for i, m in enumerate(registry.METHODS))
    table = f"WITH m(position, name, family, assumptions, requires_prior, supports_gpu, backend, maturity, source_status, training_cost) AS (VALUES {methods}) "
    lookup = lambda c, values: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in values.items()) + " ELSE CAST(0 AS DOUBLE) END"
    aliases = " UNION ALL ".join(f"SELECT '{x}' AS alias, {repr(y) if y else 'NULL'} AS method" for x, y in (("NN-PU", "nnpu"), ("ldce", "centroid_pu"), ("wconpu", "weighted_contrastive_pu"), ("nobody", None), ("PUSB", "pusb")))
    bucket = "CAST('0x' || substr(md5({}), 1, 7) AS BIGINT) % 64"
    plan = "WITH u AS (SELECT CAST(unnest([400, 800]) AS INTEGER) AS n_unlabeled), pr AS (SELECT CAST(unnest([0.2, 0.4, 0.6, 0.8]) AS DOUBLE) AS prior), rp AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS repetition), pl AS (SELECT n_unlabeled, prior, repetition, CAST(row_number() OVER (ORDER BY n_unlabeled, prior, repetition) - 1 AS INTEGER) AS seed, CAST(round_even(n_unlabeled * prior, 0) AS INTEGER) AS need FROM u, pr, rp), fp AS (SELECT n_unlabeled, prior, repetition, seed, need + 100 AS need_positive, n_unlabeled - need AS need_negative, CASE WHEN need + 100 > 500 THEN 'positives' WHEN n_unlabeled - need > 500 THEN 'negatives' ELSE '' END AS reason FROM pl) "
    grouped = "CAST(count(*) FILTER ({}) AS BIGINT)"
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / CAST(2 AS DOUBLE)"
    return {
        "normalize_pnu_labels": text + "SELECT CAST(y_pnu AS INTEGER) AS y, count(*) AS n FROM t GROUP BY 1",
        "validate_pu": scored + "SELECT CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS n_positive, CAST(u AS BIGINT) AS n_unlabeled, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_infinite, round(u / p, 9) AS ratio, CASE WHEN p < 2 THEN 'too_few_positives' ELSE '' END AS error, CASE WHEN u / p > 1000 THEN 'large_imbalance' ELSE '' END AS warning FROM a",
        "validate_pnu": text + f", c AS (SELECT count(*) AS n, {grouped.format('y_pnu = 1')} AS n_positive, {grouped.format('y_pnu = -1')} AS n_negative, {grouped.format('y_pnu = 0')} AS n_unlabeled FROM t) SELECT n, n_positive, n_negative, n_unlabeled, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_infinite, round(CAST(n_unlabeled AS DOUBLE) / least(n_positive, n_negative), 9) AS ratio, '' AS error, CASE WHEN CAST(n_unlabeled AS DOUBLE) / least(n_positive, n_negative) > 1000 THEN 'large_imbalance' ELSE '' END AS warning FROM c",
        "audit_label_consistency": scored + "SELECT count(*) AS n, count(*) FILTER (y_true NOT IN (0, 1)) AS n_invalid, count(*) FILTER (y_pu = 1 AND y_true <> 1) AS n_contradicting FROM s",
        "weight_audit": scored + "SELECT count(*) AS n, count(*) FILTER (l_tax < 0) AS n_invalid, round(min(l_tax), 9) AS min_weight, round(max(l_tax), 9) AS max_weight, round(avg(l_tax), 9) AS mean_weight, round(sum(l_tax) * sum(l_tax) / sum(l_tax * l_tax), 6) AS ess, sum(l_tax) > 0 AS usable FROM s",
        "prior_quantile_predict": pair + ", o AS (SELECT probability, row_number() OVER (ORDER BY probability) AS r, count(*) OVER () AS n FROM p), th AS (SELECT min(probability) AS x FROM o WHERE r > floor(n * (1 - CAST(0.3 AS DOUBLE)) + 1e-9)) SELECT vec_id, CAST(probability > x AS INTEGER) AS prediction FROM p, th",
        "regrouped_positives": pair + ", o AS (SELECT vec_id, row_number() OVER (ORDER BY probability DESC, vec_id DESC) AS r, count(*) OVER () AS n FROM p WHERE y_pu = 0) SELECT p.vec_id, CAST(y_pu = 1 OR coalesce(r <= ceil(n * CAST(0.1 AS DOUBLE)), FALSE) AS INTEGER) AS y_regrouped FROM p LEFT JOIN o USING (vec_id)",
        "rbf_means": centers + "SELECT y_pu, center, round(mean, 6) AS mean FROM k",
        "pen_l1_objective": centers + ", b AS (SELECT theta, theta * kp.mean - ku.mean AS b FROM k kp JOIN k ku ON kp.center = ku.center AND kp.y_pu = 1 AND ku.y_pu = 0, (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS DOUBLE) AS theta)) SELECT theta, round(sum(greatest(b, 0) * b) / CAST(0.01 AS DOUBLE) - theta + 1, 5) AS objective FROM b GROUP BY theta",
        "sar_projection": pair + ", z AS (SELECT avg(f0) AS m0, stddev_pop(f0) AS s0, avg(f1) AS m1, stddev_pop(f1) AS s1 FROM p WHERE y_true = 1) SELECT vec_id, round((f0 - m0) / s0 * CAST(0.6 AS DOUBLE) + (f1 - m1) / s1 * CAST(0.8 AS DOUBLE), 6) AS projection FROM p, z",
        "sar_propensity_mean": "SELECT CAST(0.3 AS DOUBLE) AS mean_propensity",
        "sar_bernoulli_labels": pair + "SELECT vec_id, CAST(CAST('0x' || substr(md5(concat('0:', vec_id)), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < y_true * probability AS INTEGER) AS y_pu FROM p",
        "pnu_closed_form": text + ", m AS (SELECT avg(g) FILTER (y_pnu = 1) AS p, avg(g * g) FILTER (y_pnu = 1) AS pp, avg(g) FILTER (y_pnu = -1) AS n, avg(g * g) FILTER (y_pnu = -1) AS nn, avg(g) FILTER (y_pnu = 0) AS u, avg(g * g) FILTER (y_pnu = 0) AS uu FROM t), h AS (SELECT 0.7 * (0.4 * pp + 0.6 * nn) + 0.3 * uu + 0.001 AS a, 0.7 * (0.4 * p + 0.6 * n) + 0.3 * u AS b, CAST(1 AS DOUBLE) AS d, 0.7 * (0.4 * p - 0.6 * n) + 0.3 * (0.8 * p - u) AS r, 0.7 * (0.4 - 0.6) + 0.3 * (0.8 - 1) AS q FROM m) SELECT 'g' AS feature, round((d * r - b * q) / (a * d - b * b), 6) AS weight FROM h UNION ALL SELECT 'bias', round((a * q - b * r) / (a * d - b * b), 6) FROM h",
        "shift_weight_summary": summary + "SELECT round(effective_fraction, 6) AS effective_fraction, round(clip_fraction, 9) AS clip_fraction, round(boundary_fraction, 9) AS boundary_fraction, round(raw_mean, 6) AS raw_mean FROM z",
        "shift_issues": summary + "SELECT 'domain_shift_moderate' AS code, 'info' AS level UNION ALL SELECT 'low_effective_sample_size', 'warning' FROM z WHERE effective_fraction < 0.5 UNION ALL SELECT 'relative_weight_boundary', 'warning' FROM z WHERE boundary_fraction > 0.05 UNION ALL SELECT 'low_source_target_overlap', 'warning' FROM z WHERE raw_mean < 0.1 UNION ALL SELECT 'observed_label_rate_shift', 'warning' FROM g WHERE abs(target_rate - source_rate) >= 0.1",
        "shift_alerts": "WITH w AS (SELECT strftime(ts, '%Y-%m-%d') AS window_id, count(*) AS n, avg(CASE WHEN event_type = 'purchase' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS rate FROM events GROUP BY 1), c AS (SELECT window_id, n % 3 <> 0 AS ready, 0.5 + rate AS auc, round((0.5 + rate) - lag(0.5 + rate) OVER (ORDER BY window_id), 9) AS auc_change, round(rate - lag(rate) OVER (ORDER BY window_id), 9) AS label_rate_change FROM w), k AS (SELECT *, concat_ws(',', CASE WHEN auc >= 0.75 THEN 'high_domain_shift' END, CASE WHEN NOT ready THEN 'adaptation_not_ready' END, CASE WHEN abs(auc_change) >= 0.1 THEN 'domain_auc_jump' END, CASE WHEN abs(label_rate_change) >= 0.05 THEN 'label_rate_jump' END) AS codes FROM c) SELECT window_id, auc_change, label_rate_change, codes, CASE WHEN auc >= 0.75 OR NOT ready THEN 'critical' WHEN codes <> '' THEN 'warning' WHEN auc >= 0.6 THEN 'info' ELSE 'none' END AS level FROM k",
        "domain_bootstrap": f"WITH c AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'source' ELSE 'target' END AS domain, {bucket.format('CAST(o_orderkey AS VARCHAR)')} AS bucket, count(*) AS n, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY 1, 2), dr AS (SELECT i // 64 AS replicate, {bucket.format(chr(39) + 'draw:' + chr(39) + ' || CAST(i AS VARCHAR)')} AS bucket FROM range(3200) x(i)), b AS (SELECT replicate, domain, CAST(sum(p) AS DOUBLE) / sum(n) AS rate FROM dr JOIN c USING (bucket) GROUP BY 1, 2) SELECT domain, count(*) AS n, round(avg(rate), 6) AS estimate, round(quantile_cont(rate, CAST(0.025 AS DOUBLE)), 6) AS low, round(quantile_cont(rate, CAST(0.975 AS DOUBLE)), 6) AS high FROM b GROUP BY domain",
        "paired_summary": trials + "SELECT method, count(*) AS n, round(avg(price - size * 50), 6) AS mean_difference, round(coalesce(stddev_samp(price - size * 50), 0), 6) AS std_difference, round(avg(CASE WHEN price < size * 50 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS win_rate FROM r GROUP BY method",
        "fold_summary": trials + "SELECT method, count(size) AS n, round(avg(size), 6) AS mean, round(CASE WHEN count(size) >= 2 THEN stddev_pop(size) END, 6) AS std FROM r GROUP BY method",
        "trial_key_audit": trials + ", pl AS (SELECT DISTINCT method, seed FROM r WHERE seed % 2 = 0), ac AS (SELECT method, seed, count(*) AS n FROM r WHERE seed % 3 = 0 GROUP BY 1, 2) SELECT coalesce(pl.method, ac.method) AS method, coalesce(pl.seed, ac.seed) AS seed, CASE WHEN n IS NULL THEN 'missing' WHEN pl.method IS NULL THEN 'unexpected' ELSE 'duplicated' END AS finding, CAST(coalesce(n, 0) AS BIGINT) AS n FROM pl FULL JOIN ac ON pl.method = ac.method AND pl.seed = ac.seed WHERE n IS NULL OR pl.method IS NULL OR n > 1",
        "strict_trial_audit": trials + "SELECT 'duplicate_keys' AS rule, count(*) AS violations FROM (SELECT 1 FROM r GROUP BY method, seed HAVING count(*) > 1) UNION ALL SELECT 'non_finite_metrics', count(*) FILTER (price IS NULL OR size IS NULL OR NOT isfinite(price) OR NOT isfinite(size)) FROM r UNION ALL SELECT 'repetitions', count(*) FROM (SELECT 1 FROM r GROUP BY method HAVING count(*) <> 8)",
        "sampling_plan": plan + "SELECT *, reason = '' AS feasible FROM fp",
        "sampling_audit": plan + "SELECT n_unlabeled, prior, count(*) AS n, count(*) FILTER (reason = '') AS n_feasible, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (reason <> ''), '') AS reasons FROM fp GROUP BY 1, 2",
        "spearman": scored + f", k AS (SELECT {rank.format('l_quantity')} AS x, {rank.format('l_discount')} AS y FROM s) SELECT round(corr(x, y), 6) AS spearman FROM k",
        "list_methods": table + "SELECT CAST(position AS INTEGER) AS position, name, family, requires_prior, backend FROM m WHERE assumptions LIKE '%sar'",
        "score_parts": table + f"SELECT CAST(position AS INTEGER) AS position, name, CASE WHEN assumptions LIKE '%sar' THEN CAST(30 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS assumption_part, {lookup('maturity', registry.MATURITY)} AS maturity_part, {lookup('source_status', registry.SOURCE)} AS source_part, CASE WHEN backend = 'torch' THEN CAST(8 AS DOUBLE) ELSE CAST(20 AS DOUBLE) END AS scale_part, {lookup('training_cost', {k: v * 10 for k, v in registry.COST['small'].items()})} AS cost_part, CASE WHEN supports_gpu THEN CAST(5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS gpu_part, CASE WHEN family = 'deep_pu' THEN CAST(2 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS labeled_part FROM m WHERE family <> 'class_prior_estimation'",
        "recommend_topk": table + f", x AS (SELECT position, name, round_even((CASE WHEN assumptions = 'scar sar' THEN 28 ELSE 22 END + {lookup('maturity', registry.MATURITY)} + {lookup('source_status', registry.SOURCE)} + 16 + {lookup('training_cost', {k: v * 10 for k, v in registry.COST['middle'].items()})} + CASE WHEN supports_gpu THEN CAST(1 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END + 10) / CAST(110 AS DOUBLE) * 100, 1) AS score FROM m WHERE family <> 'class_prior_estimation' AND NOT requires_prior) SELECT CAST(row_number() OVER (ORDER BY score DESC, position) AS INTEGER) AS rank, name, score FROM x ORDER BY score DESC, position LIMIT 5",
        "resolve_aliases": aliases,
    }
