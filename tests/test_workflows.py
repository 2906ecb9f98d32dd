"""Readers, report sinks, diagnostics, runs, shift-aware runs, monitoring and the command line."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parhelion import workflows
from parhelion.__main__ import main
from parhelion.operators import diagnostics, selection
from parhelion.sources import files, reports


def csv(path, rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_readers(spark, tmp_path):
    x = csv(tmp_path / "x.csv", ["a,b", *(f"{i},{i * 2}" for i in range(50))])
    y = csv(tmp_path / "y.csv", ["y", *(str(i % 2) for i in range(50))])
    rows = files.zipped(files.load_features(spark, x), y=files.load_binary_labels(spark, y))
    assert sorted(tuple(r) for r in rows.collect()) == [(i, i, 2.0 * i, i % 2) for i in range(50)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:  # many blocks give the same places
        assert sorted(tuple(r) for r in files.load_features(spark, x).collect()) == [(i, i, 2.0 * i) for i in range(50)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for bad in (["1,2", "3,4"], ["a,b", "1,x"], ["a,b", "1,nan"], ["a,b", "1,"]):
        with pytest.raises(ValueError):
            files.load_features(spark, csv(tmp_path / "bad.csv", bad))
    for bad in (["y", "2"], ["y,z", "1,0"]):
        with pytest.raises(ValueError):
            files.load_binary_labels(spark, csv(tmp_path / "bad.csv", bad))
    with pytest.raises(ValueError):
        files.load_weights(spark, csv(tmp_path / "w.csv", ["w", "0", "0"]))
    with pytest.raises(ValueError):
        files.zipped(files.load_features(spark, x), y=files.load_column(spark, csv(tmp_path / "s.csv", ["y", "1"]), "y"))
    np.save(tmp_path / "i.npy", np.arange(24, dtype=float).reshape(2, 3, 2, 2))
    assert [(r.row_id, r.shape, r.features[0]) for r in files.load_features(spark, str(tmp_path / "i.npy")).collect()] == [(0, [3, 2, 2], 0.0), (1, [3, 2, 2], 12.0)]
    lib = csv(tmp_path / "t.libsvm", ["1 1:0.5 3:2", "-1 2:1"])
    assert files.load_libsvm(spark, lib).count() == 2
    with pytest.raises(ValueError):
        files.load_libsvm(spark, lib, "00")


def test_reports(spark, tmp_path):
    doc = {"b": math.nan, "a": [1, np.float64(2.0)], 3: {"x": math.inf}}
    assert reports.json_safe(doc) == {"b": None, "a": [1, 2.0], "3": {"x": None}}
    assert reports.canonical_hash({"b": 1, "a": 2}) == reports.canonical_hash({"a": 2, "b": 1})
    assert [reports.format_value(v) for v in (None, math.nan, 1, "a|b\nc")] == ["unavailable", "unavailable", "1.000000", "a\\|b c"]
    assert reports.format_of("x.MD") == "markdown" and reports.format_of("x", "csv") == "csv"
    with pytest.raises(ValueError):
        reports.format_of("x.txt")
    reports.save_report(doc, str(tmp_path / "deep" / "r.json"))
    assert json.loads((tmp_path / "deep" / "r.json").read_text())["b"] is None
    reports.save_report({"one": {"k": 1}, "rows": [{"a": 1, "b": None}]}, str(tmp_path / "r.md"))
    assert "| 1.000000 | unavailable |" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError):
        reports.save_report({}, str(tmp_path / "r.csv"))
    good = {"analysis_type": reports.HISTORY, "configuration": {"a": 1}, "windows": [{"window_id": "x"}]}
    assert reports.restored_history(good, {"a": 1}) == [{"window_id": "x"}]
    for bad in ({**good, "analysis_type": ""}, {**good, "configuration": {}}, {**good, "windows": [{"window_id": "x"}] * 2}):
        with pytest.raises(ValueError):
            reports.restored_history(bad, {"a": 1})


@pytest.fixture(scope="module")
def table(spark):
    out = selection.scar_table(spark, 300, 0.5, 2, 3.0, 1).cache()
    assert out.count() == 600
    return out


def test_diagnostics(spark, table):
    assert diagnostics.scar_diagnostic(table, "y_pu", ["x0", "x1"], "id", "y_true")["status"] == "plausible"
    assert diagnostics.scar_diagnostic(table, "y_pu", ["x0", "x1"], "id")["status"] == "at_risk"
    assert diagnostics.scar_diagnostic(table.filter("y_pu = 0"), "y_pu", ["x0"], "id")["status"] == "inconclusive"
    assert diagnostics.parameter_grid({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    queue = diagnostics.diverse_queue(table.withColumn("p", F.lit(0.5) + F.col("x0") / 100), ["x0", "x1"], "id", 4).collect()
    assert len({r.cluster for r in queue}) == len(queue) == 4
    empty = {r.metric: r.reason for r in diagnostics.diagnostic_metrics(table.limit(0).withColumns({"pred": F.lit(1), "score": F.lit(1.0)}), 0.3, truth="y_true").collect()}
    assert empty["labeled_positive_recall"] == "no_labeled_positives" and empty["pu_zero_one_risk"] == "both_groups_required" and empty["f1"] == "no_true_positives" and empty["roc_auc"] == "one_true_class"
    odd = table.limit(9).withColumns({"pred": F.lit(1), "score": F.lit(math.nan)})
    assert [r.code for r in diagnostics.prediction_issues(odd).collect()] == ["constant_predictions", "nonfinite_scores"]
    for bad in ({}, {"priors": [1.0]}, {"propensities": [0.0]}):
        with pytest.raises(ValueError):
            diagnostics.sensitivity(odd, **bad)


def test_configuration():
    c = workflows.RunConfiguration.from_mapping({"schema_version": 1, "classifier": "pusb", "cv": 3, "metrics": ["risk"]})
    assert c.cv == 3 and c.metrics == ("risk",)
    for bad in ({"cv": 1}, {"cv": True}, {"colour": 1}, {"class_prior": 1.0}, {"metrics": []}, {"tuning_grid": {"c": []}}, {"comparison_classifiers": ["upu"]}, {"comparison_classifiers": ["upu", "pusb"], "tuning_grid": {"c": [1]}}, {"schema_version": 2}, {"classifier": ""}):
        with pytest.raises(ValueError):
            workflows.RunConfiguration.from_mapping(bad)
    assert workflows.metric_names(["auc", "roc_auc", "risk"]) == ["pu_auc_roc", "pu_zero_one_risk"]
    with pytest.raises(ValueError):
        workflows.metric_names(["nothing"])
    m = workflows.MetricResult([1.0, 3.0, None], "x")
    assert (m.mean, m.std) == (2.0, 1.0) and workflows.MetricResult([1.0], "x").std is None
    history = workflows.RunHistory(2)
    for i in range(3):
        history.add(i)
    assert history.list() == [2, 1]


def test_run(table):
    seen = []
    run = workflows.Run(["x0", "x1"], "id", "pusb", cv=2)
    report = run.fit_evaluate(table, truth="y_true", class_prior=0.4, progress=lambda stage, part: seen.append(part))
    assert report.metrics["pu_auc_roc"].mean > 0.95 and report.prior["source"] == "user" and seen[-1] == 1.0 and seen == sorted(seen)
    assert {r["metric"]: r["basis"] for r in report.diagnostics}["roc_auc"] == "supervised_oracle"
    plain = run.fit_evaluate(table, refit=False)
    assert plain.metrics["pu_zero_one_risk"].reason == "no_class_prior" and plain.metrics["pu_auc_roc"].reason == "no_true_labels" and plain.model is None
    token = workflows.CancelToken()
    token.cancel()
    with pytest.raises(workflows.RunCancelled):
        run.fit_evaluate(table, token=token)
    with pytest.raises(workflows.RunError):
        workflows.Run(["x0"], "id", "upu", prior_estimator=None).fit_evaluate(table)
    with pytest.raises(workflows.RunError):
        workflows.Run(["x0"], "id", "kldce")
    with pytest.raises(ValueError):
        workflows.Run(["x0"], "id", "pusb", cv=400).fit_evaluate(table)


def test_search(monkeypatch):
    """The search over runs whose evaluation is given."""

    def evaluated(self, refit=True, token=None, **data):
        if "strange" in self.params.values():
            raise ValueError("strange")
        value = self.params.get("c", 0.5 if self.classifier == "pusb" else 0.7)
        result = workflows.MetricResult([value], "x")
        return workflows.RunReport(self.classifier, {}, {"pu_auc_roc": result, "pu_zero_one_risk": result}, {}, [], [], self.params, refit)

    monkeypatch.setattr(workflows.Run, "fit_evaluate", evaluated)
    run = workflows.Run(["x"], "id", "pusb", cv=2)
    trials, best = workflows.tune(run, {"c": [0.2, "strange", 0.9, 0.9, math.nan]}, "auc")
    assert [t.status for t in trials] == ["ok", "failed", "ok", "ok", "unavailable"] and best.provenance == {"c": 0.9} and best.model is True
    assert workflows.tune(run, {"c": [0.2, 0.1]}, "risk")[1].provenance == {"c": 0.1}
    with pytest.raises(workflows.RunError):
        workflows.tune(run, {"c": ["strange"]}, "auc")
    trials, best = workflows.compare(run, ["pusb", "lbe", "kldce"], "auc")
    assert [t.status for t in trials] == ["ok", "ok", "failed"] and best.method == "lbe"
    for bad in (["pusb"], ["pusb", "biased_pu"]):
        with pytest.raises((ValueError, workflows.RunError)):
            workflows.compare(run, bad)


def test_primary_metric():
    m = lambda v: workflows.MetricResult([v], "x")
    found = {"pu_recall": m(1.0), "pu_auc_roc": m(None), "pu_f1": m(0.5), "pu_zero_one_risk": m(0.2)}
    assert workflows.primary_metric(found, None, True, True) == "pu_f1" and workflows.primary_metric(found, None, False, True) == "pu_zero_one_risk" and workflows.primary_metric(found, None, False, False) is None
    for bad in ("recall", "auc", "accuracy"):
        with pytest.raises(ValueError):
            workflows.primary_metric(found, bad, True, True)


def test_monitor(table, tmp_path, monkeypatch):
    """The monitor's rules over audits that are given."""
    audits = iter([{"domain_auc": 0.55, "severity": "low", "ready": True, "target_rate": 0.2}, {"domain_auc": 0.66, "severity": "moderate", "ready": True, "target_rate": 0.3}, {"domain_auc": 0.8, "severity": "high", "ready": False, "target_rate": None}])
    monkeypatch.setattr(workflows, "shift_audit", lambda *a: (next(audits), None))
    monitor = workflows.ShiftMonitor(None, ["x"], "id")
    rows = [monitor.update(None, w, "2026-01-01T00:00:00") for w in "abc"]
    assert [r["level"] for r in rows] == ["none", "warning", "critical"] and rows[1]["codes"] == ["domain_auc_jump", "label_rate_jump"] and rows[2]["label_rate_change"] is None
    with pytest.raises(ValueError):
        monitor.update(None, "b")
    monitor.save(str(tmp_path / "h.json"))
    assert workflows.ShiftMonitor(None, ["x"], "id").load(str(tmp_path / "h.json")).windows == rows
    with pytest.raises(ValueError):
        workflows.ShiftMonitor(None, ["x"], "id", alpha=0.2).load(str(tmp_path / "h.json"))


def test_shift_audit(table):
    found, weights = workflows.shift_audit(table, table.withColumn("x0", F.col("x0") + 9), ["x0", "x1"], "id")
    assert found["severity"] == "high" and {"domain_shift_high", "target_pu_missing"} <= {i["code"] for i in found["issues"]} and not found["ready"] and weights.columns == ["id", "weight", "raw", "clipped"]


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path)
    assert main(["make-demo-data", "--rows", "120", "--output", out], spark) == 0
    data = ["--data", f"{out}/X.csv", "--labels", f"{out}/y_pu.csv", "--output", out]
    assert main(["profile", *data, "--true-labels", f"{out}/y_true.csv"], spark) == 0
    assert json.loads((tmp_path / "profile.json").read_text())["n_samples"] == 240
    assert main(["recommend", "--profile", f"{out}/profile.json", "--output", out], spark) == 0
    assert main(["list-priors"], spark) == 0 and "km2" in capsys.readouterr().out
    assert main(["run", *data[:2], "--labels", f"{out}/none.csv", "--classifier", "nothing"], spark) == 1
    trials = csv(tmp_path / "t.csv", ["m,s,v", "a,1,0.5", "a,1,0.6"])
    assert main(["audit-benchmark", "--data", trials, "--keys", "m,s", "--metrics", "v", "--cell", "m", "--repetitions", "2", "--output", out], spark) == 1
