"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences.  A sentence has the score sigmoid(b + sum of the
weights of its distinct features); the document's score is the noisy-or of its
sentences, 1 - prod(1 - p).  Weights are learned from document labels alone, and the
sentence scores then say where the offence stands.  Features are the lower-cased
words and their beginnings, so that inflected forms share weight.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)


#: Features are hashed to this many numbers, so that counts need no dictionary of words.
BUCKETS = 1 << 22


def features(word: str) -> list[int]:
    return [crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in (word, *(f"{word[:n]}*" for n in STEMS if len(word) > n))]


def sentence_features(text: str | None) -> list[list[int]]:
    return [[f for w in set(WORD.findall(s.lower())) for f in features(w)] for s in SENTENCE.findall(text or "")]


@dataclass
class ToxicityModel:
    """bias and weights: feature -> weight (at most max_features of them)."""

    bias: float
    weights: dict[int, float]
    _words: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> float:
        got = self._words.get(w)
        if got is None:
            if len(self._words) > 500_000:
                self._words.clear()
            get = self.weights.get
            got = self._words[w] = sum(get(f, 0.0) for f in features(w))
        return got

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of every sentence with a word, in code points."""
        out, word, cache = [], self.word, self._words
        for m in SENTENCE.finditer(text or ""):
            words = set(WORD.findall(m.group().lower()))
            if words:
                z = self.bias + sum([cache[w] if w in cache else word(w) for w in words])
                out.append((*m.span(), float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))))
        return out

    def score(self, text: str | None) -> float:
        return noisy_or([p for _, _, p in self.sentences(text)])


def noisy_or(probabilities: list[float]) -> float:
    """1 - prod(1 - p); 0 without sentences."""
    return float(-np.expm1(np.log1p(-np.minimum(probabilities, 1 - 1e-12)).sum())) if probabilities else 0.0


def association(count: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """G statistic of each feature's presence and the label, from document counts."""
    g = np.zeros(len(count))
    for seen, rows, cols in ((toxic, count, n_toxic), (count - toxic, count, n - n_toxic), (n_toxic - toxic, n - count, n_toxic), (n - n_toxic - count + toxic, n - count, n - n_toxic)):
        expected = rows * (cols / n)
        g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0.0)
    return g


def train(texts: list[str], labels: list[int], max_features: int = 20_000, least: float = 8.0, steps: int = 400, l2: float = 0.03) -> ToxicityModel:
    """Fit by Adam on the whole sample, with the features that go with the label (G of ``least`` or more).

    One class only gives a constant model.
    """
    seen, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for text, label in zip(texts, labels):
        own = np.unique(np.array([f for s in sentence_features(text) for f in s], np.int64))
        seen[own] += 1
        toxic[own] += label
    used = np.flatnonzero(seen)
    g = association(seen[used].astype(float), toxic[used].astype(float), len(labels), sum(labels)) if 0 < sum(labels) < len(labels) else np.zeros(len(used))
    kept = used[np.argsort(-g, kind="stable")[:max_features]]
    kept = kept[: int((g >= least).sum())]
    index = np.full(BUCKETS, -1, np.int32)
    index[kept] = np.arange(len(kept))
    ids, sizes, doc_of, y = [], [], [], np.array(labels, float)
    for d, text in enumerate(texts):
        for s in sentence_features(text):
            own = index[np.unique(np.array(s, np.int64))]
            own = own[own >= 0]
            ids.append(own)
            sizes.append(len(own))
            doc_of.append(d)
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    rate = float(y.mean()) if len(y) else 0.0
    if not sizes or rate in (0.0, 1.0) or not len(ids):
        return ToxicityModel(-12.0 if rate < 1 else 12.0, {})
    sizes, doc_of = np.array(sizes), np.array(doc_of)
    sent_of = np.repeat(np.arange(len(sizes)), sizes)
    theta, bias = np.zeros(len(kept)), -6.0
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    has = np.bincount(doc_of, minlength=len(y)) > 0
    for t in range(1, steps + 1):
        z = bias + np.bincount(sent_of, theta[ids], len(sizes))
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc_of, -np.logaddexp(0, z), len(y))  # log of the product of (1 - p)
        whole = np.maximum(-np.expm1(clean), 1e-9)
        g = p * (1 - y[doc_of] / whole[doc_of]) / has.sum()
        gt = np.bincount(ids, g[sent_of], len(kept)) + l2 * theta / len(y)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gt, 0.999 * v + 0.001 * gt**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate_t = 0.2 * (1 - 0.9 * t / steps)
        theta -= rate_t * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate_t * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return ToxicityModel(float(bias), {int(f): float(w) for f, w in zip(kept, theta) if abs(w) > 1e-3})


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8000, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Train on at most ``sample`` labelled documents of up to ``longest`` characters, half of them of either label.

    Both bounds and train's max_features are parameters, so the training, which is one
    task, holds bounded data, and the driver gets the weights only.  Only ids whose crc32
    (of the id as text) mod 5 is not 0 are used, those with the smallest xxhash64 of the
    id.  Several labels of an id count as toxic if one is, of several texts the smallest
    is taken; null ids, texts and labels are left out.  The ids are a bounded broadcast.
    """
    key = F.col(id_col).cast("string")
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(key) % 5 != 0)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    short = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.length("_t") <= longest)
    known = known.join(short.select("_id").distinct(), "_id", "left_semi")
    chosen = None
    for label in (0, 1):
        some = known.filter(F.col("_y") == label).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2)
        chosen = some if chosen is None else chosen.union(some)
    rows = short.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))

    def fit(batches):
        got = pd.concat([b.to_pandas() for b in batches] or [pd.DataFrame({"_h": [], "_t": [], "_y": []})]).sort_values(["_h", "_t"])
        model = train(list(got["_t"]), [int(y) for y in got["_y"]])
        names = [-1, *model.weights]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([model.bias, *model.weights.values()], pa.float64())], names=["feature", "weight"])

    fitted = rows.select(F.xxhash64("_id").alias("_h"), "_t", "_y").coalesce(1).mapInArrow(fit, "feature long, weight double").toArrow()
    weights = dict(zip(fitted["feature"].to_pylist(), fitted["weight"].to_pylist()))
    return ToxicityModel(weights.pop(-1, -12.0), weights)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, sentences (start, end, score of those with 0.5 or more), n_sentences, worst_start, worst_end.

    Null and empty texts have no sentence and the score 0.  The model (bounded by its
    max_features) travels with the function.
    """
    plain = ToxicityModel(model.bias, model.weights)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            scores, found, counts, ws, we = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = plain.sentences(t)
                scores.append(noisy_or([p for _, _, p in s]))
                found.append([{"start": a, "end": z, "score": p} for a, z, p in s if p >= 0.5])
                counts.append(len(s))
                worst = max(s, key=lambda x: (x[2], -x[0]), default=(None, None, 0))
                ws.append(worst[0])
                we.append(worst[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, spans), pa.array(counts, pa.int64()), pa.array(ws, pa.int64()), pa.array(we, pa.int64())], names=["doc_id", "score", "sentences", "n_sentences", "worst_start", "worst_end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, sentences array<struct<start:bigint,end:bigint,score:double>>, n_sentences long, worst_start long, worst_end long")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold; null texts stay."""
    plain = ToxicityModel(model.bias, model.weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(plain.score)

    return docs.filter(score(F.coalesce(F.col(text_col), F.lit(""))) < threshold)
