"""Diagnostics of predictions: metrics with what they rest on, issues, sensitivity in two axes, queues, overlaps."""

from __future__ import annotations

import math
from itertools import combinations, product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parhelion.functions.scalar import safe_ratio, sigmoid
from parhelion.operators import metrics
from parhelion.operators.priors import standardized

OBSERVED, PRIOR, ORACLE = "pu_observed", "class_prior_dependent", "supervised_oracle"


def diagnostic_metrics(df: DataFrame, prior: float | None = None, pred: str | None = "pred", score: str | None = "score", truth: str | None = None) -> DataFrame:
    """metric, value, basis, reason: eight metrics, each with what it rests on or why it is unavailable.

    Labels are in y_pu.  Columns named None are not supplied.  The risk takes the predictions as
    scores of 1 and -1.  One aggregate, and one more for the area under the curve.
    """
    c, none = F.col, F.lit(None)
    hit = (c(pred) == 1) if pred else none.cast("boolean")
    true = (c(truth) == 1) if truth else none.cast("boolean")
    p, u = c("y_pu") == 1, c("y_pu") == 0
    s = c(score).cast("double") if score else none.cast("double")
    one = df.agg(
        F.count("*").alias("n"), F.count_if(p).alias("p"), F.count_if(u).alias("u"), F.count_if(hit).alias("hit"), F.count_if(p & hit).alias("p_hit"), F.count_if(u & hit).alias("u_hit"),
        F.count_if(true).alias("t"), F.count_if(true & hit).alias("t_hit"), F.count_if(true == hit).alias("right"), F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == math.inf)).alias("odd"),
    )
    if truth and score:
        area = metrics.auc(df.filter(~F.isnan(s) & (F.abs(s) < math.inf)), truth, score).select(F.col("pu_auc_roc").alias("area"))
        one = one.crossJoin(F.broadcast(area))  # one row
    else:
        one = one.withColumn("area", none.cast("double"))
    recall = safe_ratio(c("p_hit"), c("p"), 0)
    pi = prior if prior is not None else 0.0
    no_p, no_u = F.when(c("p") == 0, "no_labeled_positives"), F.when(c("u") == 0, "no_unlabeled")
    groups = F.when((c("p") == 0) | (c("u") == 0), "both_groups_required")
    fixed = lambda *missing: next((F.lit(why) for absent, why in missing if absent), None)
    no_pred, no_prior, no_truth, no_score = (pred is None, "no_predictions"), (prior is None, "no_class_prior"), (truth is None, "no_true_labels"), (score is None, "no_scores")
    precision = F.when(c("hit") == 0, 0.0).otherwise(F.least(F.lit(1.0), pi * recall * c("n") / F.nullif(c("hit"), F.lit(0))))
    table = [
        ("labeled_positive_recall", recall, OBSERVED, fixed(no_pred), no_p),
        ("unlabeled_negative_rate", safe_ratio(c("u") - c("u_hit"), c("u"), 0), OBSERVED, fixed(no_pred), no_u),
        ("predicted_positive_rate", safe_ratio(c("hit"), c("n")), OBSERVED, fixed(no_pred), none),
        ("pu_estimated_precision", precision, PRIOR, fixed(no_pred, no_prior), groups),
        ("pu_zero_one_risk", 2 * pi * (1 - recall) + safe_ratio(c("u_hit"), c("u"), 0) - pi, PRIOR, fixed(no_pred, no_prior), groups),
        ("accuracy", safe_ratio(c("right"), c("n")), ORACLE, fixed(no_truth, no_pred), none),
        ("f1", safe_ratio(2 * c("t_hit"), c("hit") + c("t"), 0), ORACLE, fixed(no_truth, no_pred), F.when(c("t") == 0, "no_true_positives")),
        ("roc_auc", c("area"), ORACLE, fixed(no_truth, no_score), F.when(c("odd") > 0, "scores_not_finite").when((c("t") == 0) | (c("t") == c("n")), "one_true_class")),
    ]
    rows = []
    for name, value, basis, missing, why in table:
        reason = (missing if missing is not None else why).cast("string")
        rows.append(F.struct(F.lit(name).alias("metric"), F.when(reason.isNull(), F.round(value, 9)).alias("value"), F.when(reason.isNull(), basis).otherwise("unavailable").alias("basis"), reason.alias("reason")))
    return one.select(F.inline(F.array(*rows)))


def prediction_issues(df: DataFrame, pred: str = "pred", score: str = "score") -> DataFrame:
    """code, severity: one predicted class only, scores that are not finite, scores all equal."""
    s = F.col(score).cast("double")
    good = F.when(~F.isnan(s) & (F.abs(s) < math.inf), s)
    one = df.agg(F.count("*").alias("n"), F.count(good).alias("good"), F.min(good).alias("lo"), F.max(good).alias("hi"), (F.min(pred) == F.max(pred)).alias("same"))
    rule = lambda code, severity, on: F.when(on, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    rules = [rule("constant_predictions", "warning", F.col("same")), rule("nonfinite_scores", "error", F.col("good") < F.col("n")), rule("constant_scores", "warning", (F.col("good") == F.col("n")) & (F.col("lo") == F.col("hi")))]
    return one.select(F.inline(F.array_compact(F.array(*rules))))


def sensitivity(df: DataFrame, priors: list[float] = (), propensities: list[float] = ()) -> DataFrame:
    """axis, grid_value, class_prior, label_propensity, is_consistent, precision, risk of every assumed value.

    A prior implies the mean propensity and the other way round; an implied value over 1 is
    inconsistent, and metrics exist for priors in (0, 1) only.
    """
    for v, name, top in [*((p, "class_prior", False) for p in priors), *((c, "label_propensity", True) for c in propensities)]:
        if not (0 < v < 1 or (top and v == 1)):
            raise ValueError(f"{name} {v!r} is out of range")
    if not priors and not propensities:
        raise ValueError("give class priors, label propensities, or both")
    p, u, hit = F.col("y_pu") == 1, F.col("y_pu") == 0, F.col("pred") == 1
    one = df.agg(F.count("*").alias("n"), F.count_if(p).alias("p"), F.count_if(u).alias("u"), F.count_if(hit).alias("hit"), F.count_if(p & hit).alias("p_hit"), F.count_if(u & hit).alias("u_hit"))
    points = [F.struct(F.lit(a).alias("axis"), F.lit(float(v)).alias("grid_value")) for a, vs in (("class_prior", priors), ("label_propensity", propensities)) for v in vs]
    grid = one.select("*", F.inline(F.array(*points)))
    rate = safe_ratio(F.col("p"), F.col("n"))
    implied, own = rate / F.col("grid_value"), F.col("axis") == "class_prior"
    prior = F.when(own, F.col("grid_value")).otherwise(implied)
    inside = (prior > 0) & (prior < 1)
    recall = safe_ratio(F.col("p_hit"), F.col("p"), 0)
    precision = F.when(F.col("hit") == 0, 0.0).otherwise(F.least(F.lit(1.0), prior * recall * F.col("n") / F.nullif(F.col("hit"), F.lit(0))))
    risk = 2 * prior * (1 - recall) + safe_ratio(F.col("u_hit"), F.col("u"), 0) - prior
    return grid.select("axis", "grid_value", F.round(prior, 9).alias("class_prior"), F.round(F.when(own, implied).otherwise(F.col("grid_value")), 9).alias("label_propensity"), (implied <= 1 + 1e-12).alias("is_consistent"), F.when(inside, F.round(precision, 9)).alias("precision"), F.when(inside, F.round(risk, 9)).alias("risk"))


def sensitivity_spans(points: DataFrame) -> DataFrame:
    """axis, metric, low, high, span, n over the consistent points."""
    rows = points.filter("is_consistent").select("axis", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "risk")])))
    return rows.groupBy("axis", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.max("value") - F.min("value"), 9).alias("span"), F.count("value").alias("n"))


def fold_of(id_col: str, folds: int):
    """Column: the fold of a row, by md5 of its id."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 7), 16, 10).cast("long") % folds


def scar_diagnostic(df: DataFrame, y: str, features: list[str], id_col: str, truth: str | None = None, cv: int = 3, threshold: float = 0.65) -> dict:
    """Whether labels depend on features: mean held-out AUC of a logistic fit of the label, status and evidence.

    With true labels only true positives count, and the finding identifies; else all rows
    are taken and high values may be the classes' own separation.
    """
    if not 0.5 < threshold < 1 or cv < 2:
        raise ValueError("threshold must be in (0.5, 1) and cv at least 2")
    rows = df if truth is None else df.filter(F.col(truth) == 1)
    out = {"separability_auc": None, "status": "inconclusive", "evidence": "observed_mixture" if truth is None else "audited_positives", "is_identifying": truth is not None}
    p, u = rows.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    folds = min(cv, p, u)
    if folds < 2:
        return out
    data = standardized(rows, features).select(F.col(y).cast("double").alias("_y"), fold_of(id_col, folds).alias("_fold"), array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("_x"))
    found = []
    for k in range(folds):
        fit = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", maxIter=100).fit(data.filter(F.col("_fold") != k))
        part = fit.transform(data.filter(F.col("_fold") == k)).select(F.col("_y").cast("int").alias("y_pu"), vector_to_array("_p")[1].alias("score"))
        found.append(metrics.auc(part).first()[0])
    known = [a for a in found if a is not None]
    if known:
        out["separability_auc"] = sum(known) / len(known)
        out["status"] = "plausible" if out["separability_auc"] <= threshold else "at_risk"
    return out


def trust_target(epoch, start: int, end: int, final: int):
    """Column: how many rows are trusted in an epoch: none before start, then growing evenly, final from end on."""
    grown = F.floor(F.lit(final) * (epoch - start) / max(1, end - start))
    return F.when(epoch < start, 0).when(epoch >= end, final).otherwise(grown).cast("long")


def positive_probability(df: DataFrame, score: str, out: str = "p") -> DataFrame:
    """df with out: the scores themselves if all of them are within 0 and 1, else their sigmoid."""
    one = df.agg(((F.min(score) >= 0) & (F.max(score) <= 1)).alias("_unit"))  # one row
    return df.crossJoin(F.broadcast(one)).withColumn(out, F.when(F.col("_unit"), F.col(score).cast("double")).otherwise(sigmoid(F.col(score)))).drop("_unit")


def diverse_queue(df: DataFrame, features: list[str], id_col: str, budget: int, p: str = "p", y: str = "y_pu", seed: int = 0) -> DataFrame:
    """id, uncertainty, cluster: the most uncertain row of each of ``budget`` clusters among the 5 x budget most uncertain unlabeled rows."""
    pool = df.filter(F.col(y) == 0).withColumn("uncertainty", 1 - 2 * F.abs(F.col(p) - 0.5)).orderBy(F.desc("uncertainty"), id_col).limit(5 * budget)
    pool = pool.select(id_col, "uncertainty", array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("_x"))
    grouped = KMeans(k=budget, seed=seed, featuresCol="_x", predictionCol="cluster").fit(pool).transform(pool)
    best = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("uncertainty"), id_col))
    return grouped.withColumn("_r", best).filter("_r = 1").select(id_col, "uncertainty", "cluster")


def overlap_audit(splits: dict[str, DataFrame], id_col: str) -> DataFrame:
    """a, b, n: how many ids two splits share, for every two of them, by one aggregation over all ids."""
    tagged = None
    for name, part in splits.items():
        rows = part.select(F.col(id_col).alias("_id"), F.lit(name).alias("_s"))
        tagged = rows if tagged is None else tagged.union(rows)
    sets = tagged.groupBy("_id").agg(*[F.max((F.col("_s") == s).cast("int")).alias(f"in_{i}") for i, s in enumerate(splits)])
    names = list(splits)
    pairs = list(combinations(range(len(names)), 2))
    one = sets.agg(*[F.count_if((F.col(f"in_{i}") == 1) & (F.col(f"in_{j}") == 1)).alias(f"n_{i}_{j}") for i, j in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"n_{i}_{j}").alias("n")) for i, j in pairs])))


def parameter_grid(grid: dict[str, list]) -> list[dict]:
    """Every combination of the lists, the last name varying fastest."""
    if any(not isinstance(v, (list, tuple)) or not v for v in grid.values()):
        raise ValueError("each parameter needs a list of values")
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def best_trials(trials: DataFrame, keys: list[str], order: str, value: str, largest: bool) -> DataFrame:
    """keys, order, value of the best trial of each group; of equal ones the first by order.  Null and NaN never win."""
    v = F.col(value).cast("double")
    known = trials.filter(v.isNotNull() & ~F.isnan(v))
    mark = F.struct((-v if largest else v).alias("v"), F.col(order).alias("o"))
    return known.groupBy(*keys).agg(F.min(mark).alias("_m")).select(*keys, F.col("_m.o").alias(order), (-F.col("_m.v") if largest else F.col("_m.v")).alias(value))


def plan_summary(plan: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, n_feasible, n_infeasible of a sampling plan."""
    return plan.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("feasible").alias("n_feasible"), F.count_if(~F.col("feasible")).alias("n_infeasible"))


def method_warnings(candidates: DataFrame, status: str = "inconclusive", assumption: str | None = None) -> DataFrame:
    """name, code of every warning about a registered method under a selection diagnostic."""
    only_scar = F.array_contains("assumptions", "scar") & ~F.array_contains("assumptions", "sar")
    rules = [("scar_may_not_hold", only_scar & F.lit(assumption is None and status == "at_risk")), ("experimental", F.col("maturity") == "experimental"), ("class_prior_sensitive", F.col("requires_prior"))]
    return candidates.select("name", F.explode(F.array_compact(F.array(*[F.when(on, code) for code, on in rules]))).alias("code"))


def data_warnings(status: str, identifying: bool, prior_source: str | None, few_positives: bool) -> list[str]:
    """Codes of the warnings about the data; prior_source is None (no prior), user, constructor or estimated."""
    risk = status == "at_risk"
    rules = [("scar_may_not_hold", risk and identifying), ("labeling_depends_on_features", risk and not identifying), ("class_prior_supplied", prior_source in ("user", "constructor")), ("few_labeled_positives", few_positives), ("selection_inconclusive", status == "inconclusive")]
    return [code for code, on in rules if on]
