"""Command line: python -m parhelion COMMAND --help."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from parhelion import workflows
from parhelion.operators import diagnostics, inference, linear, profile, registry, selection, shift, validation
from parhelion.session import local_session, ship
from parhelion.sources import files, reports


def parameter(text: str) -> tuple[str, object]:
    """A NAME=VALUE argument; the value is JSON, or else text."""
    name, sep, value = text.partition("=")
    if not sep or not name:
        raise argparse.ArgumentTypeError(f"{text!r} is not NAME=VALUE")
    try:
        return name, json.loads(value)
    except ValueError:
        return name, value


def _data(spark, data: str, labels: str | None = None, truth: str | None = None, canonical: bool = True):
    """The rows of the files, and the names of their features; canonical labels are 1 and 0."""
    x = files.load_features(spark, data)
    named = {}
    if labels:
        named["y_pu"] = files.load_column(spark, labels, "labels")
    if truth:
        named["y_true"] = files.load_binary_labels(spark, truth, "true labels")
    features = [c for c in x.columns if c != "row_id"]
    out = files.zipped(x, **named)
    return (validation.normalize_pu(out, "y_pu") if labels and canonical else out), features


def run(spark, a) -> int:
    given = json.loads(Path(a.config).read_text()) if a.config else {}
    for name in ("classifier", "prior_estimator", "class_prior", "cv", "scoring"):
        if getattr(a, name) is not None:
            given[name] = getattr(a, name)
    if a.param:
        given["classifier_params"] = {**given.get("classifier_params", {}), **dict(a.param)}
    c = workflows.RunConfiguration.from_mapping(given)
    rows, features = _data(spark, a.data, a.labels, a.true_labels, canonical=False)
    data = {"df": rows, "truth": "y_true" if a.true_labels else None, "class_prior": c.class_prior}
    plain = workflows.Run(features, "row_id", c.classifier, c.classifier_params, c.prior_estimator, c.cv, c.metrics, c.random_state)
    if c.comparison_classifiers:
        trials, report = workflows.compare(plain, list(c.comparison_classifiers), c.scoring, **data)
    elif c.tuning_grid:
        trials, report = workflows.tune(plain, c.tuning_grid, c.scoring, **data)
    else:
        trials, report = [], plain.fit_evaluate(**data)
    report.save(f"{a.output}/report.json")
    report.save(f"{a.output}/report.md")
    if trials:
        reports.save_report({"trials": [vars(t) for t in trials]}, f"{a.output}/{'comparison' if c.comparison_classifiers else 'tuning'}.json")
    return 0


def profile_data(spark, a) -> int:
    rows, features = _data(spark, a.data, a.labels, a.true_labels)
    out = profile.pu_summary(rows, "y_pu").first().asDict()
    out["issues"] = [r.asDict() for r in profile.profile_issues(rows, "y_pu").collect()]
    out["features"] = [r.asDict() for r in profile.feature_statistics(rows, features).collect()]
    out["selection"] = diagnostics.scar_diagnostic(rows, "y_pu", features, "row_id", "y_true" if a.true_labels else None)
    reports.save_report(out, f"{a.output}/profile.json")
    return 0


def recommend(spark, a) -> int:
    known = json.loads(Path(a.profile).read_text())
    status = known.get("selection", {})
    few = any(i["code"] == "few_labeled_positives" for i in known.get("issues", []))
    best = registry.recommend(spark, known["n_samples"], a.class_prior, a.scenario, a.assumption, a.top, status=status.get("status", "inconclusive"), identifying=status.get("is_identifying", False), few_positives=few)
    out = {"methods": [r.asDict() for r in best.orderBy("rank").collect()], "warnings": diagnostics.data_warnings(status.get("status", "inconclusive"), status.get("is_identifying", False), "user" if a.class_prior else None, few)}
    reports.save_report(out, f"{a.output}/recommendation.json")
    return 0


def sensitivity(spark, a) -> int:
    rows, features = _data(spark, a.data, a.labels)
    model = linear.BiasedPU(features).fit(rows, "y_pu")
    scored = model.transform(rows).withColumn("pred", F.col("prediction"))
    points = diagnostics.sensitivity(scored, a.prior or [round(0.1 * i, 1) for i in range(1, 10)], a.propensity or [])
    out = {"points": [r.asDict() for r in points.collect()], "ranges": [r.asDict() for r in diagnostics.sensitivity_spans(points).collect()]}
    reports.save_report(out, f"{a.output}/sensitivity.json")
    reports.save_report(out, f"{a.output}/sensitivity.md")
    reports.save_rows(points, f"{a.output}/sensitivity.csv")
    return 0


def shift_audit(spark, a) -> int:
    source, features = _data(spark, a.data, a.labels)
    target, _ = _data(spark, a.target, a.target_labels)
    out, weights = workflows.shift_audit(source, target, features, "row_id", "y_pu", "y_pu" if a.target_labels else None, a.alpha)
    reports.save_report(out, f"{a.output}/shift.json")
    reports.save_rows(weights.orderBy("row_id"), f"{a.output}/weights.csv")
    return 0


def shift_run(spark, a) -> int:
    source, features = _data(spark, a.data, a.labels)
    target, _ = _data(spark, a.target, a.target_labels, a.target_true_labels)
    plain = workflows.Run(features, "row_id", a.classifier or "pusb", cv=a.cv or 5)
    out = workflows.shift_compare(plain, source, target, truth="y_true" if a.target_true_labels else None, target_prior=a.target_prior)
    reports.save_report(out, f"{a.output}/comparison.json")
    model = plain.learner(out["method"], a.class_prior).fit(source, "y_pu")
    reports.save_rows(model.transform(target).select("row_id", "score", "prediction"), f"{a.output}/target_predictions.csv")
    return 0


def shift_monitor(spark, a) -> int:
    reference, features = _data(spark, a.data, a.labels)
    window, _ = _data(spark, a.target, a.target_labels)
    monitor = workflows.ShiftMonitor(reference, features, "row_id")
    if a.history and Path(a.history).exists():
        monitor.load(a.history)
    row = monitor.update(window, a.window_id, a.timestamp, bool(a.target_labels))
    monitor.save(a.history or f"{a.output}/history.json")
    reports.save_report(row, f"{a.output}/window_summary.json")
    return 0


def review(spark, a) -> int:
    rows, features = _data(spark, a.data, a.labels, a.true_labels)
    scored = linear.BiasedPU(features).fit(rows, "y_pu").transform(rows).withColumnRenamed("score", "probability")
    queue = shift.review_queue(scored, a.budget, "row_id")
    out = {"budget": a.budget, "queue": [r.asDict() for r in queue.collect()]}  # of the budget's size
    if a.true_labels:
        out["summary"] = shift.selective_summary(scored).first().asDict()
    reports.save_report(out, f"{a.output}/uncertainty.json")
    reports.save_rows(queue, f"{a.output}/uncertainty_rows.csv")
    return 0


def list_methods(spark, a) -> int:
    registry.methods(spark, a.family, a.assumption, a.trainable).select("name", "family", "requires_prior", "maturity").show(100, False)
    return 0


def list_priors(spark, a) -> int:
    print("\n".join(workflows.PRIORS))
    return 0


def make_demo_data(spark, a) -> int:
    if a.rows * a.label_frequency < 5:
        raise ValueError("too few labeled rows")
    table = selection.scar_table(spark, a.rows, a.label_frequency, a.features).orderBy("id").coalesce(1)
    names = [c for c in table.columns if c not in ("row_id", "id", "y_true", "y_pu")]
    for path, columns in (("X.csv", names), ("y_pu.csv", ["y_pu"]), ("y_true.csv", ["y_true"])):
        reports.save_rows(table.select(*columns), f"{a.output}/{path}")
    return 0


def audit_benchmark(spark, a) -> int:
    trials = spark.read.csv(a.data, header=True, inferSchema=True)
    rows = inference.strict_audit(trials, a.keys.split(","), a.metrics.split(","), a.cell.split(","), a.repetitions).collect()
    broken = [r.asDict() for r in rows if r.violations]
    reports.save_report({"passed": not broken, "rules": [r.asDict() for r in rows]}, f"{a.output}/audit.json")
    return 1 if broken else 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="parhelion", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)

    def command(name, function, *options):
        p = sub.add_parser(name)
        p.set_defaults(function=function)
        p.add_argument("--output", default=".")
        for flags, given in options:
            p.add_argument(flags, **given)

    need, opt = {"required": True}, {}
    data, labels, truth = ("--data", need), ("--labels", need), ("--true-labels", opt)
    target = [("--target", need), ("--target-labels", opt)]
    number, whole = {"type": float}, {"type": int}
    command("run", run, data, labels, truth, ("--config", opt), ("--classifier", opt), ("--prior-estimator", opt), ("--class-prior", number), ("--cv", whole), ("--scoring", opt), ("--param", {"action": "append", "type": parameter}))
    command("profile", profile_data, data, labels, truth)
    command("recommend", recommend, ("--profile", need), ("--class-prior", number), ("--scenario", opt), ("--assumption", opt), ("--top", {"type": int, "default": 5}))
    command("sensitivity", sensitivity, data, labels, ("--prior", {"type": float, "action": "append"}), ("--propensity", {"type": float, "action": "append"}))
    command("shift-audit", shift_audit, data, labels, *target, ("--alpha", {"type": float, "default": 0.1}))
    command("shift-run", shift_run, data, labels, *target, ("--target-true-labels", opt), ("--target-prior", number), ("--class-prior", number), ("--classifier", opt), ("--cv", whole))
    command("shift-monitor", shift_monitor, data, labels, *target, ("--window-id", need), ("--timestamp", opt), ("--history", opt))
    command("review", review, data, labels, truth, ("--budget", {"type": int, "default": 10}))
    command("list-methods", list_methods, ("--family", opt), ("--assumption", opt), ("--trainable", {"action": "store_true"}))
    command("list-priors", list_priors)
    command("make-demo-data", make_demo_data, ("--rows", {"type": int, "default": 500}), ("--label-frequency", {"type": float, "default": 0.5}), ("--features", {"type": int, "default": 2}))
    command("audit-benchmark", audit_benchmark, data, ("--keys", need), ("--metrics", need), ("--cell", need), ("--repetitions", {"type": int, "required": True}))
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    """Run a command; faults of the input are one line on stderr and code 1."""
    a = parser().parse_args(argv)
    spark = spark or local_session()
    ship(spark)
    try:
        return a.function(spark, a)
    except (ValueError, KeyError, OSError, AnalysisException, workflows.RunError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
