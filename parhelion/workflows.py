"""Runs: prior, method, cross-validation, refit and report; tuning, comparison, shift-aware runs, monitoring.

The driver holds configurations, totals and fitted coefficients; rows stay in DataFrames.
"""

from __future__ import annotations

import json
import math
import threading
from collections import deque
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parhelion.operators import audit, diagnostics, learners, linear, metrics, priors, profile, registry, sampling, validation
from parhelion.sources import reports


class RunError(Exception):
    """A run that cannot go on, with the reason."""


class RunCancelled(RunError):
    """The caller has cancelled the run."""


class CancelToken:
    """Set by the caller, read between the steps of a run."""

    def __init__(self):
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    def check(self) -> None:
        if self._event.is_set():
            raise RunCancelled("the run was cancelled")


def report_progress(callback, stage: str, done: int, total: int) -> None:
    """Tell the callback the stage and the fraction done, within 0 and 1."""
    if callback is not None:
        callback(stage, min(1.0, max(0.0, done / total if total else 1.0)))


# Metric names, other names for them, and what each needs and rests on.
DEFAULT_METRICS = ("pu_zero_one_risk", "pu_recall", "pu_estimated_precision", "pu_auc_roc")
ALIASES = {"pu_risk": "pu_zero_one_risk", "risk": "pu_zero_one_risk", "auc": "pu_auc_roc", "roc_auc": "pu_auc_roc", "recall": "pu_recall", "precision": "pu_estimated_precision", "accuracy": "pu_accuracy", "f1": "pu_f1", "negative_rate": "pu_negative_rate"}
BASIS = {"pu_zero_one_risk": diagnostics.PRIOR, "pu_estimated_precision": diagnostics.PRIOR, "pu_recall": diagnostics.OBSERVED, "pu_negative_rate": diagnostics.OBSERVED, "pu_auc_roc": diagnostics.ORACLE, "pu_accuracy": diagnostics.ORACLE, "pu_f1": diagnostics.ORACLE}
LOWER_IS_BETTER = {"pu_zero_one_risk"}


def metric_names(names=None) -> list[str]:
    """The registered names, each once, in order; a name that is none is an error."""
    out = []
    for name in DEFAULT_METRICS if names is None else names:
        known = ALIASES.get(name, name)
        if known not in BASIS:
            raise ValueError(f"unknown metric {name!r}")
        if known not in out:
            out.append(known)
    return out


def unavailable(name: str, prior: float | None, truth: str | None) -> str | None:
    """Why a metric can't be computed, or None."""
    if BASIS[name] == diagnostics.PRIOR and prior is None:
        return "no_class_prior"
    return "no_true_labels" if BASIS[name] == diagnostics.ORACLE and truth is None else None


def measured(scored: DataFrame, names: list[str], prior: float | None, y: str, truth: str | None) -> dict[str, float | None]:
    """The metrics of scored rows (y, truth, prediction, margin); those of true labels take these as labels."""
    out = {}
    for label, basis in ((y, (diagnostics.PRIOR, diagnostics.OBSERVED)), (truth, (diagnostics.ORACLE,))):
        mine = [n for n in names if BASIS[n] in basis and unavailable(n, prior, truth) is None]
        if mine:
            rows = scored.select(F.col(label).alias("y_pu"), F.col("prediction").alias("pred"), F.col("margin").alias("score"))
            found = {r.metric: r.value for r in metrics.panel(rows, 0.5 if prior is None else prior).collect()}
            out |= {n: found[n] for n in mine}
    return {n: out.get(n) for n in names}


@dataclass
class MetricResult:
    """Values of the folds, their mean, and the population deviation of two or more."""

    values: list
    basis: str
    reason: str | None = None

    @property
    def known(self) -> list[float]:
        return [v for v in self.values if v is not None and not math.isnan(v)]

    @property
    def mean(self) -> float | None:
        return sum(self.known) / len(self.known) if self.known else None

    @property
    def std(self) -> float | None:
        if len(self.known) < 2:
            return None
        return math.sqrt(sum((v - self.mean) ** 2 for v in self.known) / len(self.known))

    def document(self) -> dict:
        return {"mean": self.mean, "std": self.std, "basis": self.basis, "available": bool(self.known), "reason": self.reason}


class _ElkanNoto:
    """``learners.ElkanNoto`` on feature columns."""

    def __init__(self, features: list[str], id_col: str, **params):
        self.features, self.threshold, self.inner = features, 0.5, learners.ElkanNoto(id_col, **params)

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", F.array(*[F.col(f).cast("double") for f in self.features]))

    def fit(self, df: DataFrame, y: str = "y_pu"):
        self.model = self.inner.fit(self._rows(df).withColumn("y_pu", F.col(y)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._rows(df)).drop("features").withColumnRenamed("probability", "score")


#: Methods that can be trained: features, id column, class prior, parameters -> learner.
LEARNERS: dict[str, Callable] = {
    "elkan_noto": lambda f, i, p, **k: _ElkanNoto(f, i, **k),
    "upu": lambda f, i, p, **k: linear.LogisticUPU(f, class_prior=p, **k),
    "nnpu": lambda f, i, p, **k: linear.NonNegativePU(f, class_prior=p, **k),
    "pnu": lambda f, i, p, **k: linear.PNU(f, class_prior=p, **k),
    "pusb": lambda f, i, p, **k: linear.BiasedPU(f, **k),
    "lbe": lambda f, i, p, **k: linear.LabelingBias(f, class_prior=p, **k),
}
WEIGHTED = {"pusb"}
PRIORS: dict[str, Callable] = {
    "pen_l1": lambda df, y, f, i: priors.pen_l1(df, y, f, i),
    "km1": lambda df, y, f, i: priors.kernel_mean(df, y, f, i, gradient=False),
    "km2": lambda df, y, f, i: priors.kernel_mean(df, y, f, i),
    "recpe": lambda df, y, f, i: _recpe(df, y, f, i),
}


def _recpe(df: DataFrame, y: str, features: list[str], id_col: str) -> float:
    scored = linear.BiasedPU(features).fit(df, y).transform(df)
    return priors.kernel_mean(priors.regrouped(scored, y, "score", id_col), "y_regrouped", features, id_col)


def needs_prior(method: str) -> bool:
    return next(m[5] for m in registry.METHODS if m[0] == method)


@dataclass(frozen=True)
class RunConfiguration:
    """The settings of a run; ``from_mapping`` checks those of a JSON document."""

    classifier: str = "auto"
    classifier_params: dict = field(default_factory=dict)
    prior_estimator: str | None = "pen_l1"
    class_prior: float | None = None
    cv: int = 5
    metrics: tuple = DEFAULT_METRICS
    random_state: int = 42
    tuning_grid: dict = field(default_factory=dict)
    scoring: str = "pu_zero_one_risk"
    comparison_classifiers: tuple = ()

    @classmethod
    def from_mapping(cls, given: dict) -> "RunConfiguration":
        if not isinstance(given, dict) or given.get("schema_version", 1) != 1:
            raise ValueError("a run configuration is a mapping of schema version 1")
        values = {k: v for k, v in given.items() if k != "schema_version"}
        if strange := sorted(set(values) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(strange)}")
        c = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        text = lambda v: isinstance(v, str) and bool(v)
        compared = c.comparison_classifiers
        checks = [
            ("classifier", text(c.classifier)),
            ("classifier_params", isinstance(c.classifier_params, dict) and not (compared and c.classifier_params)),
            ("prior_estimator", c.prior_estimator is None or text(c.prior_estimator)),
            ("class_prior", c.class_prior is None or (isinstance(c.class_prior, (int, float)) and not isinstance(c.class_prior, bool) and 0 < c.class_prior < 1)),
            ("cv", whole(c.cv) and c.cv >= 2),
            ("metrics", isinstance(c.metrics, tuple) and bool(c.metrics) and all(map(text, c.metrics))),
            ("random_state", whole(c.random_state)),
            ("tuning_grid", isinstance(c.tuning_grid, dict) and all(isinstance(v, list) and v for v in c.tuning_grid.values()) and not (compared and c.tuning_grid)),
            ("scoring", text(c.scoring)),
            ("comparison_classifiers", isinstance(compared, tuple) and len(compared) != 1 and all(text(n) and n != "auto" for n in compared) and len(set(compared)) == len(compared)),
        ]
        for name, right in checks:
            if not right:
                raise ValueError(f"the setting {name} is not valid here: {getattr(c, name)!r}")
        json.dumps(asdict(c))
        return c


@dataclass
class RunReport:
    """What a run found, and its fitted model (None without refit)."""

    method: str
    prior: dict
    metrics: dict[str, MetricResult]
    profile: dict
    issues: list[dict]
    diagnostics: list[dict]
    provenance: dict
    model: object = field(default=None, repr=False)

    def document(self) -> dict:
        return {"method": self.method, "prior": self.prior, "metrics": [{"metric": n, **m.document()} for n, m in self.metrics.items()], "profile": self.profile, "issues": self.issues, "diagnostics": self.diagnostics, "provenance": self.provenance}

    def save(self, path: str, format: str | None = None) -> None:
        reports.save_report(self.document(), path, format, title=f"Run of {self.method}")


def with_margin(scored: DataFrame, model) -> DataFrame:
    """scored with ``margin``, positive where the model's threshold is passed."""
    return scored.withColumn("margin", F.col("score") - float(model.threshold))


@dataclass
class Run:
    """Validate, find the prior, choose a method, cross-validate, refit and report.

    classifier: a registered name or alias, or ``auto`` for the best ranked method that can be
    trained.  The prior is the given one, else estimated once on all rows, never from true
    labels; in ``auto`` a failing estimate leaves the methods that need none.
    """

    features: list[str]
    id_col: str
    classifier: str = "auto"
    params: dict = field(default_factory=dict)
    prior_estimator: str | None = "pen_l1"
    cv: int = 5
    names: tuple | None = None
    seed: int = 42

    def __post_init__(self):
        if self.cv < 2:
            raise ValueError("cv must be 2 or more")
        if self.classifier == "auto" and self.params:
            raise ValueError("parameters need an explicit classifier")
        if self.classifier != "auto":
            self.classifier = registry.resolve(self.classifier)
            if self.classifier not in LEARNERS:
                raise RunError(f"{self.classifier} is registered but has no learner here")
        if self.prior_estimator is not None and self.prior_estimator not in PRIORS:
            raise ValueError(f"unknown prior estimator {self.prior_estimator!r}")

    def resolve_prior(self, df: DataFrame, y: str, given: float | None) -> dict:
        """value, source (user, estimated or none), estimator, degraded (why there is none)."""
        auto = self.classifier == "auto"
        if given is not None:
            return {"value": validation.check_range("class_prior", given, 0, 1, inclusive=False), "source": "user", "estimator": None, "degraded": None}
        if not auto and not needs_prior(self.classifier):
            return {"value": None, "source": "none", "estimator": None, "degraded": None}
        if self.prior_estimator is None:
            why = "prior estimation is off"
        else:
            try:
                value = validation.check_range("class_prior", float(PRIORS[self.prior_estimator](df, y, self.features, self.id_col)), 0, 1, inclusive=False)
                return {"value": value, "source": "estimated", "estimator": self.prior_estimator, "degraded": None}
            except (ValueError, ZeroDivisionError) as e:
                why = f"{self.prior_estimator}: {e}"
        if auto:
            return {"value": None, "source": "none", "estimator": self.prior_estimator, "degraded": why}
        raise RunError(f"{self.classifier} needs a class prior ({why})")

    def choose(self, df: DataFrame, n: int, prior: float | None, **known) -> str:
        if self.classifier != "auto":
            return self.classifier
        ranked = registry.recommend(df.sparkSession, n, prior, top=len(registry.METHODS), **known).orderBy("rank").collect()
        names = [r.name for r in ranked if r.name in LEARNERS and r.name != "pnu"]
        if not names:
            raise RunError("no method suits these data")
        return names[0]

    def learner(self, method: str, prior: float | None, weight: str | None = None):
        extra = {"weight": weight} if weight else {}
        return LEARNERS[method](self.features, self.id_col, prior, **self.params, **extra)

    def fit_evaluate(self, df: DataFrame, y: str = "y_pu", truth: str | None = None, class_prior: float | None = None, weight: str | None = None, refit: bool = True, progress=None, token: CancelToken | None = None) -> RunReport:
        token = token or CancelToken()
        names = metric_names(self.names)
        steps = self.cv + 3
        is_pnu = self.classifier == "pnu"
        canonical = "y_pnu" if is_pnu else "y_pu"
        rows = (validation.normalize_pnu if is_pnu else validation.normalize_pu)(df, y, canonical)
        check = validation.pnu_report(rows, canonical, self.features) if is_pnu else validation.pu_report(rows, canonical, self.features)
        validation.require_valid(check)
        if truth is not None:
            validation.require_true_labels(rows, truth, None if is_pnu else canonical)
        if weight is not None:
            validation.require_weights(rows, weight)
        summary = (profile.pnu_summary if is_pnu else profile.pu_summary)(rows, canonical).first().asDict()
        if summary["n_positives"] < self.cv:
            raise ValueError(f"{summary['n_positives']} positives are too few for {self.cv} folds")
        token.check()
        report_progress(progress, "prior", 1, steps)
        prior = self.resolve_prior(rows, canonical, class_prior)
        issues = [] if is_pnu else [r.asDict() for r in profile.profile_issues(rows, canonical).collect()]
        selection = {} if is_pnu else diagnostics.scar_diagnostic(rows, canonical, self.features, self.id_col, truth)
        few = any(i["code"] == "few_labeled_positives" for i in issues)
        method = self.choose(rows, summary["n_samples"], prior["value"], status=selection.get("status", "inconclusive"), identifying=selection.get("is_identifying", False), few_positives=few)
        if weight is not None and method not in WEIGHTED:
            raise RunError(f"{method} takes no row weights")
        folds = sampling.kfold(rows, self.cv, self.id_col, canonical, self.seed)
        # read once by every fit; a lost executor's part is computed again
        dealt = rows.drop("fold").join(folds, self.id_col).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._evaluated(dealt, canonical, truth, weight, refit, prior, method, names, issues, selection, summary, few, steps, progress, token)
        finally:
            dealt.unpersist()

    def _evaluated(self, dealt, canonical, truth, weight, refit, prior, method, names, issues, selection, summary, few, steps, progress, token) -> RunReport:
        """Cross-validation, refit and report over the rows with their folds."""
        found: dict[str, list] = {n: [] for n in names}
        for k in range(self.cv):
            token.check()
            model = self.learner(method, prior["value"], weight).fit(dealt.filter(F.col("fold") != k), canonical)
            scored = with_margin(model.transform(dealt.filter(F.col("fold") == k)), model)
            for n, v in measured(scored, names, prior["value"], canonical, truth).items():
                found[n].append(v)
            report_progress(progress, "cross_validation", k + 2, steps)
        results = {n: MetricResult(v, BASIS[n], unavailable(n, prior["value"], truth)) for n, v in found.items()}
        model, shown = None, []
        if refit:
            token.check()
            model = self.learner(method, prior["value"], weight).fit(dealt, canonical)
            scored = with_margin(model.transform(dealt), model).withColumns({"pred": F.col("prediction"), "y_pu": (F.col(canonical) == 1).cast("int")})
            shown = [r.asDict() for r in diagnostics.diagnostic_metrics(scored, prior["value"], "pred", "margin", truth).collect()]
            issues += [r.asDict() for r in diagnostics.prediction_issues(scored, "pred", "margin").collect()]
        report_progress(progress, "report", steps, steps)
        warnings = diagnostics.data_warnings( selection.get("status", "inconclusive"), selection.get("is_identifying", False), prior["source"] if prior["value"] is not None else None, few)
        issues += [{"code": c, "severity": "warning"} for c in warnings]
        source = {"classifier": self.classifier, "params": json.dumps(self.params, sort_keys=True), "cv": self.cv, "seed": self.seed, "weight": weight, "features": ",".join(self.features)}
        return RunReport(method, prior, results, {**summary, **{f"selection_{k}": v for k, v in selection.items()}}, issues, shown, source, model)


@dataclass
class Trial:
    index: int
    setting: dict
    score: float | None
    status: str
    error: str | None = None


def _search(runs: list[tuple[dict, Run]], data: dict, scoring: str, token: CancelToken | None, progress) -> tuple[list[Trial], RunReport]:
    """Cross-validate every run, keep failures as trials, and refit the best one alone."""
    scoring = metric_names([scoring])[0]
    trials = []
    for i, (setting, run) in enumerate(runs):
        try:
            result = run.fit_evaluate(**data, refit=False, token=token).metrics[scoring]
            ok = result.mean is not None and math.isfinite(result.mean)
            trials.append(Trial(i, setting, result.mean if ok else None, "ok" if ok else "unavailable", None if ok else result.reason or "no finite value"))
        except RunCancelled:
            raise
        except Exception as e:  # noqa: BLE001 - one trial's failure is a result of the search
            trials.append(Trial(i, setting, None, "failed", str(e)))
        report_progress(progress, "search", i + 1, len(runs) + 1)
    good = [t for t in trials if t.status == "ok"]
    if not good:
        raise RunError("no trial has a score: " + "; ".join(f"{t.index}: {t.error}" for t in trials))
    best = (min if scoring in LOWER_IS_BETTER else max)(good, key=lambda t: t.score)
    return trials, runs[best.index][1].fit_evaluate(**data, token=token)


def tune(run: Run, grid: dict[str, list], scoring: str = "pu_zero_one_risk", token: CancelToken | None = None, progress=None, **data) -> tuple[list[Trial], RunReport]:
    """Trials of every combination of parameters, and the report of the best one (of equal ones the first)."""
    if run.classifier == "auto":
        raise ValueError("tuning needs an explicit classifier")
    names = tuple(dict.fromkeys([*metric_names(run.names), *metric_names([scoring])]))
    runs = [(p, Run(run.features, run.id_col, run.classifier, {**run.params, **p}, run.prior_estimator, run.cv, names, run.seed)) for p in diagnostics.parameter_grid(grid)]
    return _search(runs, data, scoring, token, progress)


def compare(run: Run, classifiers: list[str], scoring: str = "pu_zero_one_risk", token: CancelToken | None = None, progress=None, **data) -> tuple[list[Trial], RunReport]:
    """Trials of the named methods, and the report of the best one."""
    if len(classifiers) < 2 or len({registry.resolve(c) for c in classifiers}) != len(classifiers):
        raise ValueError("a comparison needs two or more different methods")
    names = tuple(dict.fromkeys([*metric_names(run.names), *metric_names([scoring])]))
    settings = [({"classifier": c}, c) for c in classifiers]
    unknown = [c for c in classifiers if registry.resolve(c) not in LEARNERS]
    runs = [(s, Run(run.features, run.id_col, c, {}, run.prior_estimator, run.cv, names, run.seed)) for s, c in settings if c not in unknown]
    trials, best = _search(runs, data, scoring, token, progress)
    return trials + [Trial(len(runs) + i, {"classifier": c}, None, "failed", "no learner") for i, c in enumerate(unknown)], best


def shift_audit(source: DataFrame, target: DataFrame, features: list[str], id_col: str, y: str = "y_pu", target_y: str | None = None, alpha: float = 0.1) -> tuple[dict, DataFrame]:
    """The audit of a shift as a document, and the source rows with their weights."""
    both = audit.with_domain(source.select(id_col, *features, F.col(y).alias("_label")), target.select(id_col, *features, (F.col(target_y) if target_y else F.lit(None)).cast("int").alias("_label")))
    scored = audit.domain_scores(both, features, id_col)
    area = metrics.auc(scored.select(F.col("domain").alias("y_pu"), F.col("p").alias("score"))).first()[0]
    area = max(area, 1 - area)
    sizes = {r.domain: (r.n, r.rate) for r in both.groupBy("domain").agg(F.count("*").alias("n"), F.avg((F.col("_label") == 1).cast("double")).alias("rate")).collect()}
    weighted = audit.density_weights(scored.filter("domain = 0"), "p", sizes[0][0], sizes[1][0], alpha)
    one = audit.weight_summary(weighted, alpha).withColumns({"domain_auc": F.lit(area), "severity": audit.severity(F.lit(area)), "source_rate": F.lit(sizes[0][1]).cast("double"), "target_rate": F.lit(sizes[1][1]).cast("double")})
    row = one.withColumn("ready", audit.ready(F.col("target_rate"), F.col("effective_fraction"), F.col("boundary_fraction"), F.col("raw_mean"))).first().asDict()
    issues = [r.asDict() for r in audit.shift_issues(one).collect()]
    return {**row, "n_source": sizes[0][0], "n_target": sizes[1][0], "alpha": alpha, "issues": issues}, weighted.select(id_col, "weight", "raw", "clipped")


def primary_metric(found: dict[str, MetricResult], requested: str | None, truth: bool, prior: bool) -> str | None:
    """The metric that decides: the requested one, else one of true labels, else one of the class prior."""
    if requested is not None:
        name = metric_names([requested])[0]
        if name not in found or BASIS[name] == diagnostics.OBSERVED or not found[name].known:
            raise ValueError(f"{requested} can't decide here")
        return name
    order = (["pu_auc_roc", "pu_f1", "pu_accuracy"] if truth else []) + (["pu_zero_one_risk", "pu_estimated_precision"] if prior else [])
    return next((n for n in order if n in found and found[n].known), None)


def shift_compare(run: Run, source: DataFrame, target: DataFrame, y: str = "y_pu", truth: str | None = None, target_prior: float | None = None, class_prior: float | None = None, primary: str | None = None, margin: float = 0.0, allow_unstable: bool = False) -> dict:
    """Train with and without weights for the target, evaluate both there, and recommend.

    Labels of the target gate the weights but take no part in the density ratio.  The weighted
    run is left out if the audit does not allow it.
    """
    found, weights = shift_audit(source, target, run.features, run.id_col, y, y)
    names = metric_names(run.names)

    def evaluate(data: DataFrame, weight: str | None) -> tuple[dict[str, MetricResult], RunReport]:
        report = run.fit_evaluate(data, y, truth if truth in data.columns else None, class_prior, weight)
        scored = with_margin(report.model.transform(validation.normalize_pu(target, y)), report.model)
        has_truth = truth if truth in target.columns else None
        values = measured(scored, names, target_prior, "y_pu", has_truth)
        return {n: MetricResult([v], BASIS[n], unavailable(n, target_prior, has_truth)) for n, v in values.items()}, report

    base, first = evaluate(source, None)
    weighted = None
    if found["ready"] or allow_unstable:
        weighted, _ = evaluate(source.join(weights.select(run.id_col, F.col("weight").alias("_weight")), run.id_col), "_weight")
    chosen = primary_metric(base, primary, truth is not None and truth in target.columns, target_prior is not None)
    rows = []
    for n, m in base.items():
        other = weighted[n].mean if weighted else None
        delta = other - m.mean if other is not None and m.mean is not None else None
        rows.append({"metric": n, "baseline": m.mean, "weighted": other, "delta": delta, "improvement": -delta if delta is not None and n in LOWER_IS_BETTER else delta, "basis": m.basis})
    gain = next((r["improvement"] for r in rows if r["metric"] == chosen), None)
    if weighted is None:
        says = "collect_target_data"
    elif chosen is None:
        says = "audit_only"
    else:
        says = "reweight_recommended" if gain is not None and gain > margin else "no_clear_benefit"
    return {"shift": found, "method": first.method, "metrics": rows, "primary_metric": chosen, "recommendation": says}


class ShiftMonitor:
    """Audits windows against a reference and keeps the history of what they showed."""

    def __init__(self, reference: DataFrame, features: list[str], id_col: str, y: str = "y_pu", alpha: float = 0.1, auc_jump: float = 0.1, rate_jump: float = 0.05):
        self.reference, self.features, self.id_col, self.y = reference, features, id_col, y
        self.configuration = {"alpha": alpha, "auc_jump": auc_jump, "rate_jump": rate_jump}
        self.windows: list[dict] = []

    def update(self, window: DataFrame, window_id: str, timestamp: str | None = None, labeled: bool = True) -> dict:
        """Audit a window, compare it with the one before, add it to the history."""
        if any(w["window_id"] == window_id for w in self.windows):
            raise ValueError(f"window {window_id!r} is known already")
        if timestamp is not None:
            from datetime import datetime

            datetime.fromisoformat(timestamp)
        found, _ = shift_audit(self.reference, window, self.features, self.id_col, self.y, self.y if labeled else None, self.configuration["alpha"])
        last = self.windows[-1] if self.windows else {}
        change = lambda now, before: None if now is None or before is None else round(now - before, 9)
        moved = {"auc_change": change(found["domain_auc"], last.get("domain_auc")), "label_rate_change": change(found["target_rate"], last.get("label_rate"))}
        high, ready = found["severity"] == "high", bool(found["ready"])
        rules = [("high_domain_shift", high), ("adaptation_not_ready", not ready), ("domain_auc_jump", abs(moved["auc_change"] or 0) >= self.configuration["auc_jump"]), ("label_rate_jump", abs(moved["label_rate_change"] or 0) >= self.configuration["rate_jump"])]
        codes = [c for c, on in rules if on]
        level = "critical" if high or not ready else "warning" if codes else "info" if found["severity"] == "moderate" else "none"
        row = {"window_id": window_id, "timestamp": timestamp, "domain_auc": found["domain_auc"], "severity": found["severity"], "adaptation_ready": ready, "label_rate": found["target_rate"], **moved, "codes": codes, "level": level}
        self.windows.append(row)
        return row

    def save(self, path: str) -> None:
        reports.save_history(path, self.configuration, self.windows)

    def load(self, path: str) -> "ShiftMonitor":
        with open(path, encoding="utf-8") as f:
            self.windows = reports.restored_history(json.load(f), self.configuration)
        return self


class RunHistory:
    """The latest runs, newest first."""

    def __init__(self, most: int = 20):
        self._runs: deque = deque(maxlen=most)

    def add(self, run) -> None:
        self._runs.appendleft(run)

    def list(self) -> list:
        return list(self._runs)
