"""The known methods as a table, and scores of how well each suits a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Name; aliases; family; scenarios; assumptions; needs a class prior; GPU;
# backend; maturity; source status; training cost.  In order of registration.
METHODS = (
    ("class_prior_estimation", "cpe pen_l1 pe", "class_prior_estimation", "single_training_set case_control", "scar", False, False, "numpy", "stable", "official_related", "low"),
    ("recpe", "re_cpe rethinking_cpe", "class_prior_estimation", "single_training_set case_control", "scar", False, False, "numpy", "stable", "official_exact", "low"),
    ("elkan_noto", "en elkan-noto elkan_noto_calibration", "classic_calibration", "single_training_set", "scar", False, False, "sklearn", "stable", "third_party_only", "low"),
    ("upu", "convex_pu unbiased_pu u-pu", "risk_estimation", "case_control", "scar", True, False, "numpy", "stable", "official_bundle", "low"),
    ("nnpu", "non_negative_pu nn-pu nnPU", "risk_estimation", "case_control", "scar", True, True, "torch", "stable", "official_exact", "medium"),
    ("pnu", "pnu_classifier pn-pu-nu", "risk_estimation", "case_control", "scar", True, False, "numpy", "research", "official_exact", "low"),
    ("centroid_pu", "ldce centroid_estimation", "risk_estimation", "single_training_set", "scar", False, False, "numpy", "research", "official_related", "medium"),
    ("kldce", "kernelized_ldce", "risk_estimation", "single_training_set", "scar", False, False, "numpy", "research", "official_related", "medium"),
    ("llsvm", "large_margin_svm label_calibrated_svm", "risk_estimation", "case_control", "scar sar", True, False, "numpy", "research", "official_exact", "high"),
    ("dist_pu", "distribution_pu distpu", "risk_estimation", "case_control", "scar", True, True, "torch", "research", "official_exact", "medium"),
    ("pusb", "biased_pu selection_bias_pu nnPUSB", "bias_aware", "selection_biased", "sar", False, False, "sklearn", "research", "official_exact", "medium"),
    ("pusb_kernel", "kernelized_pusb", "bias_aware", "selection_biased", "sar", True, False, "numpy", "research", "official_related", "high"),
    ("lbe", "labeling_bias labeling_bias_estimation", "bias_aware", "single_training_set selection_biased", "sar", False, False, "sklearn", "research", "official_exact", "medium"),
    ("self_pu", "self_pu_classifier", "deep_pu", "case_control", "scar", True, True, "torch", "research", "official_exact", "medium"),
    ("infomax_pu", "information_theoretic_pu pu_representation", "deep_pu", "case_control", "scar", False, True, "torch", "research", "not_found", "high"),
    ("weighted_contrastive_pu", "wcon_pu wconpu contrastive_pu", "deep_pu", "case_control", "scar", True, True, "torch", "research", "not_found", "high"),
    ("dgpu", "discriminative_generative_pu", "deep_pu", "case_control selection_biased", "scar sar", True, True, "torch", "experimental", "not_found", "medium"),
)
SCHEMA = "position int, name string, aliases array<string>, family string, scenarios array<string>, assumptions array<string>, requires_prior boolean, supports_gpu boolean, backend string, maturity string, source_status string, training_cost string"

# The largest score of each part, and the levels' parts of it.
CAPS = {"assumption": 30.0, "maturity": 20.0, "source": 15.0, "scale": 20.0, "gpu": 5.0, "labeled_positives": 10.0, "cost": 10.0}
MATURITY = {"stable": 20.0, "research": 12.0, "experimental": 5.0}
SOURCE = {"official_exact": 15.0, "official_bundle": 12.0, "official_related": 9.0, "third_party_only": 6.0, "not_found": 3.0, "unknown": 1.0}
COST = {"small": {"low": 1.0, "medium": 0.7, "high": 0.2}, "middle": {"low": 1.0, "medium": 0.8, "high": 0.5}, "large": {"low": 1.0, "medium": 0.85, "high": 0.7}}
UNKNOWN_COST = 0.6
SMALL, LARGE = 1000, 10_000


def methods(spark: SparkSession, family: str | None = None, assumption: str | None = None, trainable_only: bool = False) -> DataFrame:
    """The registered methods that meet all given conditions, with their position; prior estimators are not trainable."""
    rows = [(i, m[0], m[1].split(), m[2], m[3].split(), m[4].split(), *m[5:]) for i, m in enumerate(METHODS)]
    out = spark.createDataFrame(rows, SCHEMA)
    if family is not None:
        out = out.filter(F.col("family") == family)
    if assumption is not None:
        out = out.filter(F.array_contains("assumptions", assumption))
    return out.filter(F.col("family") != "class_prior_estimation") if trainable_only else out


def resolve(name: str) -> str:
    """The registered name of a name or alias, in any case."""
    key = name.strip().lower()
    for m in METHODS:
        if key in {m[0].lower(), *m[1].lower().split()}:
            return m[0]
    raise KeyError(f"unknown method {name!r}")


def resolved(names: DataFrame, column: str) -> DataFrame:
    """names with ``method``: the registered name, null if there is none; the bounded registry is the broadcast side."""
    known = methods(names.sparkSession).select(F.col("name").alias("method"), F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.col("aliases")), F.lower))).alias("_key"))
    return names.withColumn("_key", F.lower(F.trim(column))).join(F.broadcast(known), "_key", "left").drop("_key")


def _lookup(column: str, values: dict, otherwise: float = 0.0):
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(F.col(column) == k, float(v)).otherwise(out)
    return out


def score_parts(candidates: DataFrame, n: int, status: str = "inconclusive", identifying: bool = False, assumption: str | None = None, gpu: bool = False, few_positives: bool = False) -> DataFrame:
    """name, position and the seven parts of each candidate's score.

    status: the selection diagnostic (plausible, at_risk or inconclusive); assumption: one
    that the user states, which then decides alone.
    """
    cap = CAPS["assumption"]
    scar, sar = F.array_contains("assumptions", "scar"), F.array_contains("assumptions", "sar")
    none = cap / 6
    if assumption is not None:
        fit = F.when(F.array_contains("assumptions", assumption), cap).otherwise(0.0)
    elif status == "plausible":
        fit = F.when(scar, cap).when(sar, cap / 2).otherwise(none)
    elif status == "at_risk":
        fit = F.when(sar & F.lit(identifying), cap).when(scar | sar, cap / 3).otherwise(none)
    else:
        fit = F.when(scar & sar, cap * 28 / 30).when(scar | sar, cap * 22 / 30).otherwise(none)
    torch = F.col("backend") == "torch"
    size = "small" if n < SMALL else "large" if n > LARGE else "middle"
    scale = {"small": F.when(torch, 0.4).otherwise(1.0), "middle": F.lit(0.8), "large": F.when(torch, 1.0).otherwise(0.6)}[size] * CAPS["scale"]
    graphics = F.when(F.col("supports_gpu") & F.lit(gpu), 1.0).when(~F.col("supports_gpu") & F.lit(not gpu), 0.6).otherwise(0.2) * CAPS["gpu"]
    labeled = F.when((F.col("family") == "deep_pu") & F.lit(few_positives), 0.2).otherwise(1.0) * CAPS["labeled_positives"]
    cost = _lookup("training_cost", COST[size], UNKNOWN_COST) * CAPS["cost"]
    return candidates.select("position", "name", fit.alias("assumption_part"), _lookup("maturity", MATURITY).alias("maturity_part"), _lookup("source_status", SOURCE).alias("source_part"), scale.alias("scale_part"), cost.alias("cost_part"), graphics.alias("gpu_part"), labeled.alias("labeled_part"))


def recommend(spark: SparkSession, n: int, class_prior: float | None = None, scenario: str | None = None, assumption: str | None = None, top: int = 5, **profile) -> DataFrame:
    """rank, name, score (0 to 100) of the best methods; ties keep the order of registration.

    Without a class prior, methods that need one are left out.
    """
    if top < 1:
        raise ValueError("top must be positive")
    m = methods(spark, assumption=assumption, trainable_only=True)
    if scenario is not None:
        m = m.filter(F.array_contains("scenarios", scenario))
    if class_prior is None:
        m = m.filter(~F.col("requires_prior"))
    parts = score_parts(m, n, assumption=assumption, **profile)
    total = sum((F.col(c) for c in parts.columns[2:]), F.lit(0.0)) / sum(CAPS.values()) * 100
    best = parts.select("position", "name", F.bround(total, 1).alias("score")).orderBy(F.desc("score"), "position").limit(top)
    # of the bounded registry
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "position")).alias("rank"), "name", "score")
