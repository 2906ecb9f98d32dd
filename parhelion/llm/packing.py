"""Packing documents into sequences along a Hilbert curve.

Each document's token ids are hashed into a vector, projected to three dimensions and
turned into a Hilbert key; documents sorted by the key lie next to similar ones.  The
sorted documents are laid end to end and cut every ``length`` tokens, so sequences hold
neighbours on the curve and only the last one of the corpus is padded.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parhelion.llm.shared import Scratch, number_rows

DIMENSIONS, BITS, BUCKETS = 3, 10, 2048
CACHE_WORDS = 600_000
PART_ROWS, PART_BYTES = 2048, 16 << 20
#: An ASCII mark after a Latin letter or a digit begins a piece, so a blank may stand between (others could compose or join, and lowered U+0130 ends in a mark).
_MARK = r"([a-z0-9\x{df}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([!-/:-@\[-`{-~])"


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, d) with coordinates below 2**bits.

    Skilling's transform: undo the excess rotations from the top bit down, Gray-decode
    across the axes, and interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


#: Fixed value: the pattern of the pre-tokenizer for which words may be encoded one by one.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(tokenizer) -> bool:
    """Whether a text's ids are those of its blank-separated words, and A-Z count as a-z."""
    spec = json.loads(tokenizer.to_str())
    kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    return kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": _PIECES} and first.get("invert") is True and spec["model"].get("end_of_word_suffix") == "</w>"


class Encoder:
    """Token ids of texts, with a bounded memory of blank-separated words.

    Words, and marks after letters and digits, are told apart and numbered by Arrow, only words not seen before are encoded, and
    the ids of a batch are laid out from those of its distinct words.  A tokenizer of
    another kind encodes whole texts.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = by_words(self.tokenizer)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end_id = end_id
        rng = np.random.default_rng(7)
        self.hashed = rng.integers(0, BUCKETS, 1 << 17)
        self.projection = rng.choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), the end id after each, and where each text's begin (and the end)."""
        if not self.words:
            own = [np.array([*e.ids, self.end_id], "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(own) if own else np.zeros(0, "<u4"), np.cumsum([0, *map(len, own)])
        # a text's capitals may not become the text of a special token
        lowered = pc.replace_substring_regex(pc.ascii_lower(texts), _MARK, r"\1 \2")
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, lowered)
        split = pc.ascii_split_whitespace(lowered)
        counted = pc.cast(split.flatten(), pa.large_string()).dictionary_encode()
        index = counted.indices.to_numpy(zero_copy_only=False)
        distinct = counted.dictionary.to_pylist()
        own = self.encode(distinct)
        flat = np.frombuffer(b"".join(own), "<u4")
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        first = np.cumsum(size) - size
        # every word's ids, one word after the other
        lengths = size[index]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(first[index] - total[:-1], lengths) + np.arange(total[-1])
        ends = total[split.offsets.to_numpy() - split.offsets[0].as_py()]
        bounds = ends + np.arange(len(ends))
        out = np.empty(int(bounds[-1]), "<u4")
        last = np.zeros(len(out), bool)
        last[bounds[1:] - 1] = True
        out[last] = self.end_id
        out[~last] = flat[at]
        return out, bounds

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids (little-endian, 32 bits) of each word."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        missing = [w for w in words if w not in known]
        self.learn(missing)
        return [known[w] for w in words]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Encode words, those of letters in one text: each ends with its only id that ends a word."""
        known = self.known
        plain, others = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        for start in range(0, len(plain), 4096):
            part = plain[start : start + 4096]
            ids = self._encode([" ".join(part)])[0]
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                others += part
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, (ends * 4).tolist()):
                known[w] = raw[at:end]
                at = end
        for w, ids in zip(others, self._encode(others)):
            known[w] = ids.tobytes()

    def keys(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        hashed = self.hashed[ids & 0x1FFFF]
        at = np.empty((len(bounds) - 1, DIMENSIONS))
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            v = np.bincount(hashed[a:b], minlength=BUCKETS) / (b - a)
            at[i] = v @ self.projection / max(1e-9, np.sqrt((v * v).sum()))
        grid = np.clip((0.5 + 0.5 * np.tanh(at)) * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert_key(grid.astype(np.int64))


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder of a worker, for all its tasks."""
    return Encoder(path, end_id)


def _parts(batch: pa.RecordBatch):
    """Slices of a batch of up to PART_ROWS rows and about PART_BYTES of text (or one row)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, min(at + PART_ROWS, int(np.searchsorted(sizes, before + PART_BYTES))))
        yield batch.slice(at, end - at)
        at = end


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n, ids (binary) of every row; a null text is empty and has the end id only."""

    def run(batches):
        coder = encoder(tokenizer_path, end_id)
        for b in batches:
            for part in _parts(b):
                ids, bounds = coder.ids(pc.fill_null(part.column(1), ""))
                raw = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coder.keys(ids, bounds)), pa.array(np.diff(bounds)), raw], names=["doc_id", "key", "n", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, key long, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, hilbert_key.

    A document longer than what is left of a sequence goes on in the next; every token
    lies in exactly one piece and offsets in a sequence have no gaps.  Null ids stay
    null, repeated rows are packed each, an empty table gives no rows.
    """
    if length < 1:
        raise ValueError("length must be positive")
    scratch = Scratch(docs.sparkSession, "packing")
    coded = scratch.save(encode_documents(docs, tokenizer_path, end_id, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    placed = number_rows(coded.select("_row", "doc_id", "key", "n"), ["key", "doc_id", "n"], scratch, "n")
    pos = coded.select("_row", "ids").join(placed.withColumnRenamed("row", "_at"), "_row")
    first, last = F.expr(f"_at div {length}"), F.expr(f"(_at + n - 1) div {length}")
    cut = pos.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    cut = cut.withColumn("start", F.greatest(F.lit(0), F.expr(f"sequence_id * {length} - _at")))
    cut = cut.withColumn("length", F.least(F.col("n"), F.expr(f"(sequence_id + 1) * {length} - _at")) - F.col("start"))
    piece = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return cut.select("doc_id", "start", "length", F.crc32(piece).alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", (F.col("_at") + F.col("start") - F.col("sequence_id") * length).alias("offset"), F.col("key").alias("hilbert_key"))
