"""Language identification by compression with per-language dictionaries.

Each learned language has a raw-content zstandard dictionary made of whole sample
texts.  A text is compressed with every dictionary; the language with the fewest
bytes is predicted, and the prediction is marked as rejected when the runner-up is
nearly as small.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD_CHARACTER = re.compile(r"[^\W\d_]")
BLOCK = 4096  # bytes compressed at a time, so that a long text's own past doesn't stand in for the dictionary
LEVEL = 3


def has_letter(text: str) -> bool:
    """Whether a character is a letter (categories L*); numbers such as fractions are not."""
    return any(m.group().isalpha() for m in _WORD_CHARACTER.finditer(text))


class LanguageModel:
    def __init__(self, samples: dict[str, bytes]):
        """samples: the dictionary content of each language."""
        self.samples = dict(sorted(samples.items()))
        self._coders = None

    def __getstate__(self):
        return {"samples": self.samples, "_coders": None}

    def coders(self):
        if self._coders is None:
            self._coders = []
            for lang, data in self.samples.items():
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._coders.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress))
        return self._coders

    def sizes(self, text: str) -> list[tuple[int, str]]:
        raw = text.encode("utf-8", "surrogatepass")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return sorted((sum([len(code(b)) for b in blocks]), lang) for lang, code in self.coders())

    def predict(self, text: str | None, margin: float = 0.01) -> tuple[str, float, bool]:
        """(language, score, rejected); score grows from 0.5 to 1 with the relative margin."""
        if not text or not has_letter(text) or not self.samples:
            return "und", 0.0, True
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        (best, lang), (second, _) = sizes[:2]
        gap = (second - best) / second
        return lang, 1 - 0.5 * 2.0 ** (-gap / 0.02), gap < margin


def fit_language(docs: DataFrame, dictionary_bytes: int = 96 << 10, sample: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Dictionaries from at most ``sample`` texts a language, at most dictionary_bytes each.

    Both bounds are parameters.  Only rows with an id and a language whose crc32 (of the
    id as text) mod 3 is not 1 are used: of the distinct texts that a dictionary can hold
    an eighth of, those with the smallest hash, whole and in that order until the dictionary
    is full.  A language without such texts is not learned.
    """
    key = F.col(id_col).cast("string")
    rows = docs.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"), (F.crc32(key) % 3 != 1).alias("m"))
    rows = rows.filter(F.col("l").isNotNull() & F.col("m") & F.octet_length("t").between(8, dictionary_bytes // 8))
    # of every part the smallest hashes, then those of the whole, so no language meets in one task
    seen = rows.select("l", "h").distinct()
    counts = dict(seen.groupBy("l").count().collect())
    near = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, 2.0 * sample / n)
        near = near | ((F.col("l") == lang) & (F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))))
    got: dict[str, dict[bytes, None]] = {}
    for r in sorted(rows.filter(near).groupBy("l", "h").agg(F.min("t").alias("t")).collect(), key=lambda r: (r.l, r.h % (1 << 30), r.t)):
        got.setdefault(r.l, {})[r.t.encode("utf-8", "surrogatepass")] = None
    samples = {}
    for lang, texts in got.items():
        data = b""
        for text in list(texts)[:sample]:
            if len(data) + len(text) < dictionary_bytes:
                data += text + b"\n"
        samples[lang] = data
    return LanguageModel(samples)


def identify(docs: DataFrame, model: LanguageModel, margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row.

    ``und`` with score 0 for null texts and texts without a letter; ties go to the
    smaller language name.
    """
    plain = LanguageModel(model.samples)

    def run(batches):
        for b in batches:
            out = [plain.predict(t, margin) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
