"""Validation, priors, learners, label mechanisms, audits and the registry on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parhelion.operators import audit, inference, linear, priors, registry, sampling, selection, validation


@pytest.fixture(scope="module")
def cloud(spark):
    """300 positives around (1.5, 1.5), 700 negatives around (-1.5, -1.5); half of the positives labeled."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(1.5, 1, (300, 2)), rng.normal(-1.5, 1, (700, 2))])
    rows = [(i, float(a), float(b), int(i < 300), int(i < 300 and i % 2 == 0)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, y_true int, y_pu int").cache()


def labels(spark, values):
    return spark.createDataFrame([(v,) for v in values], "y int")


def test_label_sets(spark):
    assert [r.y_pu for r in validation.normalize_pu(labels(spark, [1, -1, 1]), "y").collect()] == [1, 0, 1]
    assert [r.y_pu for r in validation.normalize_pu(labels(spark, [0, 0]), "y").collect()] == [0, 0]
    for bad in ([1, 0, -1], [2, 1], [1, None], []):
        with pytest.raises(ValueError):
            validation.normalize_pu(labels(spark, bad), "y")
    assert validation.normalize_pnu(labels(spark, [1, -1, 0]), "y").count() == 3
    with pytest.raises(ValueError):
        validation.normalize_pnu(labels(spark, [1, 0, 0]), "y")
    row = validation.label_sets(labels(spark, [0, 1, 5, None]), "y").first()
    assert (row.n, row.n_null, row.n_strange, row.fits) == (4, 1, 1, False)


def test_reports(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (0, math.nan), (0, 3.0)], "y int, x double")
    assert validation.pu_report(df, "y", ["x"]).first().error == "non_finite_features"
    assert validation.pu_report(df.filter("x < 9 and not isnan(x)"), "y", ["x"]).first().error == ""
    assert validation.pu_report(df.filter("y = 0 and x = 3"), "y", ["x"]).first().error == "too_few_positives"
    assert validation.pu_report(df.limit(0), "y", ["x"]).first().error == "empty"
    many = spark.range(2003).select((F.col("id") < 2).cast("int").alias("y"), F.lit(1.0).alias("x"))
    assert validation.pu_report(many, "y", ["x"]).first().warning == "large_imbalance"
    assert validation.pnu_report(many, "y", ["x"]).first().error == "missing_group"
    with pytest.raises(ValueError):
        validation.require_valid(validation.pu_report(df, "y", ["x"]))
    truth = spark.createDataFrame([(1, 1), (1, 0), (0, 1)], "y int, t int")
    assert validation.true_label_report(truth, "t", "y").first().n_contradicting == 1
    with pytest.raises(ValueError):
        validation.require_true_labels(truth, "t", "y")
    w = spark.createDataFrame([(0.0,), (2.0,), (2.0,)], "w double")
    assert validation.weight_report(w, "w").first().ess == 2.0 and validation.require_weights(w, "w").count() == 3
    for bad in ([-1.0, 1.0], [0.0, 0.0], [math.inf], [None]):
        with pytest.raises(ValueError):
            validation.require_weights(spark.createDataFrame([(x,) for x in bad], "w double"), "w")
    assert validation.check_range("p", 0.5, 0, 1) == 0.5
    with pytest.raises(ValueError, match=r"\(0, 1\)"):
        validation.check_range("p", 1, 0, 1, inclusive=False)


def test_priors(cloud):
    assert abs(priors.pen_l1(cloud, "y_pu", ["a", "b"], "id") - 150 / 850) < 0.2
    low, high = (priors.kernel_mean(cloud.filter(c), "y_pu", ["a", "b"], "id", 200) for c in ("y_true = 0 or y_pu = 1", "true"))
    assert 0 <= low < high < 1
    gram = np.eye(3)
    distance, w = priors.simplex_distance(gram, np.array([2.0, 0.0, 0.0]), 4.0)
    assert abs(distance - 1) < 1e-6 and abs(w[0] - 1) < 1e-6
    assert priors.prior_from_positive_fraction(30, 100, 0.25) == pytest.approx(0.4)
    for bad in ((90, 100, 0.5), (0, 100, 0.1), (1, 0, 0.1)):
        with pytest.raises(ValueError):
            priors.prior_from_positive_fraction(*bad)
    with pytest.raises(ValueError):
        priors.centroid_denominator(1.0, 0.5)


def test_quantile_and_ranks(spark):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate([5, 1, 3, 3, 2, 9, 9, 0])], "id int, s double")
    want = sorted([5, 1, 3, 3, 2, 9, 9, 0])[int(8 * 0.6)]
    got = {r.id: r.prediction for r in priors.prior_quantile_predict(df, "s", 0.4).collect()}
    assert got == {i: int(s > want) for i, s in enumerate([5, 1, 3, 3, 2, 9, 9, 0])}
    assert [r.id for r in priors.row_ranks(df, ["s", "id"]).orderBy("rank").collect()] == [6, 5, 0, 3, 2, 4, 1, 7]
    moved = priors.regrouped(df.withColumn("y", F.lit(0)), "y", "s", "id", 0.2)
    assert {r.id for r in moved.filter("y_regrouped = 1").collect()} == {5, 6}
    assert sorted(r["rank"] for r in inference.ranks(df, "s").collect()) == [1.0, 2.0, 3.0, 4.5, 6.0, 7.5]


def test_learners(cloud):
    truth = {r.id: r.y_true for r in cloud.collect()}
    pnu = cloud.withColumn("y_pnu", F.when(F.col("y_pu") == 1, 1).when(F.col("id") >= 900, -1).otherwise(0))
    for model, rows in ((linear.NonNegativePU(["a", "b"], class_prior=0.3, steps=60), cloud), (linear.LogisticUPU(["a", "b"], class_prior=0.3), cloud), (linear.PNU(["a", "b"], class_prior=0.3, eta=0.2), pnu), (linear.LabelingBias(["a", "b"], rounds=3, class_prior=0.3), cloud), (linear.BiasedPU(["a", "b"], threshold=0.25), cloud)):
        got = model.fit(rows).transform(rows.withColumn("probability", F.lit("kept"))).collect()
        assert np.mean([r.prediction == truth[r.id] for r in got]) > 0.9, model
        assert got[0].probability == "kept"
    with pytest.raises(RuntimeError):
        linear.PNU(["a"]).transform(cloud)
    with pytest.raises(ValueError):
        linear.PNU(["a"]).fit(cloud, "y_pu")
    folds = sampling.kfold(cloud, 2, "id").join(cloud, "id")
    measure = lambda scored: scored.agg(F.avg((F.col("prediction") == F.col("y_true")).cast("double")).alias("value")).withColumn("metric", F.lit("accuracy"))
    got = linear.cross_validated(folds, "fold", 2, lambda: linear.LogisticUPU(["a", "b"], class_prior=0.3), measure)
    assert [r.fold for r in got.orderBy("fold").collect()] == [0, 1] and got.agg(F.min("value")).first()[0] > 0.9


def test_mechanisms(spark, cloud):
    for kind in ("scar", "Linear", "NON-LINEAR"[:3].lower() + "linear"):
        p = selection.sar_propensity(cloud, "y_true", ["a", "b"], kind, 0.3, 2.0)
        assert p.filter("y_true = 1").agg(F.avg("propensity")).first()[0] == pytest.approx(0.3, abs=1e-6)
        assert p.filter("y_true = 0 and propensity > 0").count() == 0
    with pytest.raises(ValueError):
        selection.mechanism_name("magic")
    none = cloud.withColumn("propensity", F.when(F.col("id") == 7, 1e-12).otherwise(0.0))
    assert [r.id for r in selection.bernoulli_labels(none, "propensity", "id").filter("y_pu = 1").collect()] == [7]
    table = selection.sar_table(spark, 400, 0.4)
    assert table.count() == 800 and 100 < table.filter("y_pu = 1").count() < 220 and table.filter("y_pu = 1 and y_true = 0").count() == 0
    assert selection.scar_table(spark, 100, 0.25).filter("y_pu = 1").count() == 25
    for call in (lambda: sampling.case_control_labels(cloud, 301, "id"), lambda: sampling.pnu_labels(cloud, 701, "id"), lambda: sampling.kfold(cloud.filter("id < 3"), 3, "id")):
        with pytest.raises(ValueError):
            call()


def test_shift(spark, cloud):
    both = audit.with_domain(cloud.filter("y_true = 0"), cloud.filter("y_true = 1"))
    scored = audit.domain_scores(both, ["a", "b"], "id", 3)
    assert scored.agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("domain")).cast("double"))).first()[0] > 0.9
    flat = cloud.withColumn("p", F.lit(0.5))
    w = audit.density_weights(flat, "p", 1000, 1000)
    s = audit.weight_summary(w).first()
    assert (s.effective_fraction, s.clip_fraction, s.boundary_fraction, s.raw_mean) == (1.0, 0.0, 0.0, 1.0)
    row = spark.createDataFrame([("high", 0.1, 0.2, 0.05, 0.3, None)], "severity string, effective_fraction double, boundary_fraction double, raw_mean double, source_rate double, target_rate double")
    assert [r.code for r in audit.shift_issues(row).collect()] == ["domain_shift_high", "low_effective_sample_size", "relative_weight_boundary", "low_source_target_overlap", "target_pu_missing"]
    windows = spark.createDataFrame([("a", 0.5, "low", True, 0.2), ("b", 0.65, "moderate", True, 0.2), ("c", 0.66, "moderate", True, 0.21), ("d", 0.8, "high", False, 0.4)], "w string, domain_auc double, severity string, adaptation_ready boolean, label_rate double")
    got = audit.alerts(windows, "w").orderBy("w").collect()
    assert [(r.codes, r.level) for r in got] == [("", "none"), ("domain_auc_jump", "warning"), ("", "info"), ("high_domain_shift,adaptation_not_ready,domain_auc_jump,label_rate_jump", "critical")]
    a = spark.createDataFrame([("pu_zero_one_risk", 0.4), ("f1", 0.5)], "metric string, value double")
    b = spark.createDataFrame([("pu_zero_one_risk", 0.3), ("f1", 0.4)], "metric string, value double")
    assert {r.metric: r.improvement for r in audit.compare_metrics(a, b).collect()} == {"pu_zero_one_risk": 0.1, "f1": -0.1}
    assert [audit.recommendation(*x) for x in ((False, True, 1), (True, False, 1), (True, True, 0.1), (True, True, None))] == ["collect_target_data", "audit_only", "reweight_recommended", "no_clear_benefit"]


def test_intervals(spark):
    # known quantiles of the distribution
    for df, want in ((1, 12.7062), (4, 2.7764), (9, 2.2622), (30, 2.0423)):
        assert inference.t_quantile(0.95, df) == pytest.approx(want, abs=1e-4)
    rows = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", None), ("one", 2.0)], "k string, v double")
    got = {r.k: r for r in inference.t_intervals(rows, ["k"], "v").collect()}
    assert got["m"].half_width == pytest.approx(12.7062 * math.sqrt(2) / math.sqrt(2), abs=1e-3) and got["one"].half_width is None and got["one"].std == 0
    plan = inference.sampling_plan(spark, [10], [0.5], 2, 6, 9, 1)
    assert [(r.seed, r.need_positive, r.need_negative, r.feasible) for r in plan.orderBy("seed").collect()] == [(0, 6, 5, True), (1, 6, 5, True)]


def test_registry(spark):
    assert registry.resolve("NN-pu") == "nnpu" and registry.resolve("ldce") == "centroid_pu"
    with pytest.raises(KeyError):
        registry.resolve("nothing")
    keys = [k for m in registry.METHODS for k in {x.lower() for x in (m[0], *m[1].split())}]
    assert len(keys) == len(set(keys)) and len(registry.METHODS) == 17
    known = registry.recommend(spark, 500, 0.3, assumption="sar", top=10).collect()
    assert [r["rank"] for r in known] == list(range(1, len(known) + 1)) and {r.name for r in known} == {"llsvm", "pusb", "pusb_kernel", "lbe", "dgpu"}
    assert "pusb_kernel" not in {r.name for r in registry.recommend(spark, 500, None, top=20).collect()}
