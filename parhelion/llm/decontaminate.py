"""Benchmark decontamination by size-partitioned MinHash containment.

The test items are partitioned by their number of distinct shingles into classes
[2^c, 2^(c+1)).  The sketch of an item of class c is its floor((1 - t) * 2^(c+1)) + 1
smallest shingles by hash: an item of which a share t stands in a document lacks fewer
shingles than that, so one of its sketch at least stands there, however long the
document is.  A sketch hit makes a candidate; the exact containment decides.

Items come in blocks of bounded bytes, each sent to the executors; the documents are
read once per block and never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

BLOCK_BYTES = 16 << 20
#: A-Z in lower case, letters a-z, digits and bytes above ASCII as they are, others blanks.
_WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i > 127 else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def shingles(w: list[bytes], k: int):
    return zip(*(islice(w, i, None) for i in range(k)))


class Items:
    """A block of test items with their sketches."""

    def __init__(self, rows: list[tuple], threshold: float, k: int):
        self.threshold = threshold
        self.sketch: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.items: list[tuple] = []
        for item_id, text in rows:
            w = words(text)
            if not w:
                continue
            own = set(shingles(w, width := min(k, len(w))))
            top = 1 << len(own).bit_length()  # the class has fewer shingles than this
            m = int((1 - threshold) * top + 1e-9) + 1
            for s in sorted(own, key=lambda s: (xxh64_intdigest(b" ".join(s)), s))[:m]:
                self.sketch[width][s].append(len(self.items))
            self.items.append((item_id, width, own))
        self.sketch = {a: dict(b) for a, b in self.sketch.items()}
        self.keys = {a: frozenset(b) for a, b in self.sketch.items()}

    def find(self, text: str | None) -> list[tuple]:
        """(item_id, shared, shingles) of each item contained to the threshold."""
        w, out = words(text), []
        for width, keys in self.keys.items():
            hits = keys.intersection(shingles(w, width))
            if hits:
                whole = set(shingles(w, width))
                for i in sorted({i for s in hits for i in self.sketch[width][s]}):
                    item_id, _, own = self.items[i]
                    shared = len(own & whole)
                    if shared >= self.threshold * len(own) - 1e-9:
                        out.append((item_id, shared, len(own)))
        return out


def item_blocks(items: DataFrame, threshold: float, k: int, id_col: str, text_col: str) -> list[Items]:
    """The items, repeated rows once, in blocks of about BLOCK_BYTES of text."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    return [Items([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()], threshold, k) for b in range(n)]


def contaminated_pairs(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, shared, shingles, containment of every document and test item
    of which a share of at least ``threshold`` of the distinct k-word shingles stands in it.

    Words are runs of ASCII letters (lowered), digits and characters beyond ASCII.  An
    item of fewer than k words is one shingle of its length; items without words and
    null texts match nothing.  Repeated item rows count once, repeated documents each.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_kind = to_arrow_type(items.schema[item_col].dataType)
    out = None
    for block in item_blocks(items, threshold, k, item_col, item_text_col):

        def run(batches, block=block):
            for b in batches:
                rows, found = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for f in block.find(t):
                        rows.append(i)
                        found.append(f)
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([f[0] for f in found], item_kind), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[1] / f[2] for f in found], pa.float64())], names=["doc_id", "item_id", "shared", "shingles", "containment"])

        part = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, shared long, shingles long, containment double")
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no test item; null texts stay."""
    for block in item_blocks(items, threshold, k, item_col, item_text_col):
        docs = docs.filter(_without(block)(F.coalesce(F.col(text_col), F.lit(""))))
    return docs


def _without(block: Items):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: not block.find(t)).astype(bool)

    return clean
