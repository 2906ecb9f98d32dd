"""Near-duplicate documents by SimHash and a grid join on segment popcounts.

Each fingerprint is cut into 32 segments of two bits; the bit counts of the segments
are its place in a grid.  Flipping one bit moves a place by one step, so the Manhattan
distance of two places is a lower bound of the Hamming distance.  Of radius + 2 parts
of the grid's axes, a pair within the radius has the same place in two at least, so
an equi-join on every two parts finds all pairs; Manhattan distance drops most of the
others and the Hamming distance decides.

Cells with more members than ``dense`` are not paired: their members are linked
through one-bit variants (two fingerprints within two bits share a variant), which is
exact and linear in the members.  Nothing is left out in either way.

``keep_one_similar`` links documents by the Jaccard similarity of their shingles instead,
since two bits catch few of the similar documents.  Candidates share one of the
smallest hashes of their shingles, of which a set has as many as ``first_hashes`` says:
similar sets always share one.  Sizes and then the whole sets decide (SimHashes within
``max_bits`` too if that is less than 64: repeated words move them while the sets stay alike).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, islice, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from parhelion.llm.shared import Scratch, connected_components, groups_by_cells

_BLOCK = 1 << 16
_EVEN = "6148914691236517205L"  # 0x5555555555555555, the even bits


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit majority of the XXH64 (seed 42) of all word shingles, repeats counted.

    A-Z are lowered and words stand between ASCII white space.  Fewer words than a
    shingle are one shingle; no words (or null) give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle))))
    total, left = np.zeros(64, np.int64), len(words) - shingle + 1
    n = left
    while left:
        size = min(left, _BLOCK)
        h = np.fromiter(map(xxh64_intdigest, islice(grams, size), repeat(42)), np.uint64, size)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= size
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row."""

    def run(batches):
        for b in batches:
            fps = np.array([simhash(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _place(x: str) -> str:
    """Bit counts of the 32 segments, each in unary (0, 1, 3), so that distances are bit counts of xor."""
    half = f"shiftrightunsigned({x}, 1)"
    return f"((({x} | {half}) & {_EVEN}) | shiftleft(({x} & {half}) & {_EVEN}, 1))"


def grid_keys(fp: str = "fp", radius: int = 2) -> list[str]:
    """SQL for one cell key of each two parts of the grid place."""
    parts = radius + 2
    edges = [round(32 * i / parts) * 2 for i in range(parts + 1)]
    place = _place(fp)
    cut = [f"(shiftrightunsigned({place}, {a}) & {(1 << (b - a)) - 1}L)" for a, b in zip(edges, edges[1:])]
    return [f"shiftleft({cut[i]}, {edges[j + 1] - edges[j]}) | {cut[j]}" for i, j in combinations(range(parts), 2)]


def fingerprint_links(fps: DataFrame, scratch: Scratch, radius: int = 2, dense: int = 64) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fp within radius bits.

    fps: distinct longs in the column fp.  b may be a variant that is no fingerprint
    itself; such nodes have the form of a struct (kind 1), fingerprints kind 0.
    """
    keys = grid_keys("fp", radius)
    cells = fps.select("fp", F.posexplode(F.array(*[F.expr(k) for k in keys])).alias("part", "cell"))
    cells = scratch.save(cells)
    sizes = cells.groupBy("part", "cell").count().filter("count > 1")
    small, large = sizes.filter(F.col("count") <= dense).select("part", "cell"), sizes.filter(F.col("count") > dense).select("part", "cell")
    near = cells.join(small, ["part", "cell"])
    hamming = "bit_count(a.fp ^ b.fp)"
    manhattan = f"bit_count({_place('a.fp')} ^ {_place('b.fp')})"
    pairs = near.alias("a").join(near.alias("b"), F.expr(f"a.part = b.part and a.cell = b.cell and a.fp < b.fp and {manhattan} <= {radius} and {hamming} <= {radius}"))
    node = lambda x, kind=0: F.struct(F.lit(kind).alias("kind"), F.expr(x).alias("fp"))
    links = pairs.select(node("a.fp").alias("a"), node("b.fp").alias("b"))
    crowded = cells.join(large, ["part", "cell"]).select("fp").distinct()
    flips = [f"shiftleft(1L, {i})" for i in range(64)]
    if radius == 2:
        variants = crowded.select("fp", F.explode(F.array(F.lit(0).cast("long"), *[F.expr(x) for x in flips])).alias("flip"))
        return links.union(variants.select(node("fp").alias("a"), node("fp ^ flip", 1).alias("b")))
    # an odd radius: half the way from each side, the middle bit by a join of the variants
    reach = crowded.select("fp", F.expr("fp").alias("at"))
    for _ in range((radius + 1) // 2):
        reach = reach.select("fp", F.explode(F.array(F.col("at"), *[F.expr(f"at ^ {x}") for x in flips])).alias("at")).distinct()
    if radius % 2 == 0:
        return links.union(reach.select(node("fp").alias("a"), node("at", 1).alias("b")))
    inner = crowded.select("fp", F.expr("fp").alias("at"))
    for _ in range(radius // 2):
        inner = inner.select("fp", F.explode(F.array(F.col("at"), *[F.expr(f"at ^ {x}") for x in flips])).alias("at")).distinct()
    meet = inner.select(F.col("fp").alias("p"), "at").join(reach, "at").filter("p < fp").select("p", "fp").distinct()
    return links.union(meet.select(node("p").alias("a"), node("fp").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long), component_id, group_fp for every row.

    Documents link when their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest doc_id reachable (null only if all ids there are
    null) and group_fp the smallest fingerprint reachable.  Equal fingerprints are one node, so copies are never paired.  Null and
    empty texts have fingerprint 0 and link like others; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    prints = scratch.save(fingerprints(docs, shingle, id_col, text_col))
    unique = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = fingerprint_links(unique.select("fp"), scratch, radius)
    found = connected_components(links, scratch).filter("node.kind = 0").select(F.col("node.fp").alias("fp"), "component")
    member = unique.join(found, "fp")
    lowest = member.groupBy("component").agg(F.min("first").alias("low"), F.count("*").alias("n")).filter("n > 1")
    linked = member.join(lowest, "component").select("fp", "low", F.col("component.fp").alias("group_fp"))
    low = F.when(F.col("group_fp").isNotNull(), F.col("low")).otherwise(F.col("first"))
    own = scratch.save(unique.join(linked, "fp", "left").select("fp", low.alias("component_id"), F.coalesce("group_fp", "fp").alias("group_fp")))
    return prints.join(own, "fp").select("doc_id", "fp", "component_id", "group_fp")


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """XXH64 of the word shingles as in ``simhash``, repeats included; no words are one empty shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, shingle))


def _majority(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        total += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def first_hashes(n: int, similarity: float) -> int:
    """How many of the smallest of n hashes are cells.

    Similar sets share ``similarity`` * n hashes at least, so the smallest that they share
    has at most the others before it.
    """
    return n - ceil(similarity * n - 1e-9) + 1


def sketches(rows: DataFrame, shingle: int, similarity: float = 0.8) -> DataFrame:
    """id, h, key (a hash of the shingle set), n (its size), fp (SimHash), cells (its smallest hashes) of rows (id, h, text)."""

    def run(batches):
        for b in batches:
            keys, sizes, prints, cells = [], [], [], []
            for t in b.column(2).to_pylist():
                hashes = shingle_hashes(t, shingle)
                s = np.unique(hashes)
                keys.append(xxh64_intdigest(s.tobytes(), 42))
                sizes.append(len(s))
                prints.append(_majority(hashes))
                cells.append(s[: first_hashes(len(s), similarity)].view(np.int64))
            key = pa.array(np.array(keys, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), key, pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], names=["id", "h", "key", "n", "fp", "cells"])

    return rows.select("id", "h", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, h long, key long, n long, fp long, cells array<long>")


def bitmap(s: np.ndarray) -> np.ndarray:
    """Eight bits or more a hash, a power of two of them, each set by the hashes that end in its number."""
    bits = np.zeros(64 << max(0, int(len(s) - 1).bit_length() - 3), bool)
    bits[s & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def whole_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """key, s (the whole shingle set), n (its size), bits (``bitmap``) of rows (text)."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            key = pa.array(np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64))
            whole, bits = (pa.array(x, pa.list_(pa.int64())) for x in ([s.view(np.int64) for s in sets], [bitmap(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([key, whole, pa.array([len(s) for s in sets], pa.int64()), bits], names=["key", "s", "n", "bits"])

    return rows.select("text").mapInArrow(run, "key long, s array<long>, n long, bits array<long>")


def may_overlap(a: str, b: str, need: str) -> str:
    """SQL: whether sets with the bitmaps and sizes a and b can share ``need`` hashes: a bit that only one has is a hash that only it has."""
    fit = lambda x, y: f"if(size({x}.bits) > size({y}.bits), zip_with(slice({x}.bits, 1, size({y}.bits)), slice({x}.bits, size({y}.bits) + 1, size({y}.bits)), (p, q) -> p | q), {x}.bits)"
    apart = lambda x, y: f"aggregate(zip_with({fit(x, y)}, {fit(y, x)}, (p, q) -> coalesce(bit_count(p & ~q), 0)), 0, (s, v) -> s + v) <= {x}.n - ({need})"
    # sets of which one is over twice as large as the other are left to the whole comparison
    return f"(size({a}.bits) not between size({b}.bits) div 2 and size({b}.bits) * 2 or {apart(a, b)} and {apart(b, a)})"


#: Hashes are counted in so many passes, 1 << RANGES, each with its own range of them, so that the disk holds a part of them at a time.
RANGES = 2


def repeated_shingles(whole: DataFrame, scratch: Scratch) -> DataFrame:
    """k, x, f: the hashes x that f > 1 of the sets whole (key, s) have, each with its sets."""
    parts = []
    for i in range(1 << RANGES):
        # dealt once, for the count and the join
        hashes = whole.select(F.col("key").alias("k"), F.explode("s").alias("x")).filter(f"shiftrightunsigned(x, {64 - RANGES}) = {i}").repartition("x")
        parts.append(scratch.save(hashes.join(hashes.groupBy("x").agg(F.count("*").alias("f")).filter("f > 1"), "x").select("k", "x", "f")))
        scratch.release()
    return reduce(DataFrame.union, parts)


def pairs_by_rare_shingles(things: DataFrame, whole: DataFrame, similarity: float, scratch: Scratch | None = None) -> DataFrame:
    """a, b: pairs of things (k, c) of different c, among them all with a Jaccard similarity of ``similarity``.

    A set's hashes are ranked by the number of sets of whole that have them, the rarest first.  From
    the first hash on that two similar sets share, each has as many as they share at least,
    so it is one of the first (1 - similarity) * n + 1; hashes of one set only are ranked
    and not joined.  The work grows with the sizes of the sets, not with the square of a group.
    """
    least = f"ceil({similarity!r}D * n - 1e-9)"
    sizes = things.join(whole.select(F.col("key").alias("k"), "n"), "k").select("k", "c", "n")
    known = repeated_shingles(whole, scratch or Scratch(whole.sparkSession, "rare")).join(sizes, "k")
    ranked = known.groupBy("k", "c", "n").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("r"))
    first = ranked.select("k", "c", "n", F.expr("n - size(r)").alias("alone"), F.posexplode(F.expr(f"slice(r, 1, cast(greatest(0, size(r) + 1 - {least}) as int))")).alias("i", "e"))
    first = first.select("k", "c", "n", F.col("e.x").alias("x"), F.expr("n - alone - i").alias("left"))
    need = f"{similarity / (1 + similarity)!r}D * (x.n + y.n) - 1e-9"
    pairs = first.alias("x").join(first.alias("y"), F.expr(f"x.x = y.x and x.k < y.k and x.c != y.c and least(x.left, y.left) >= {need}"))
    return pairs.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))


def similar_sets(rows: DataFrame, prints: DataFrame, scratch: Scratch, shingle: int, similarity: float, max_bits: int, last: bool = False) -> DataFrame:
    """node, component of the keys of prints (``sketches`` of rows) linked by a Jaccard similarity of at least ``similarity``.

    prints is deleted as soon as its cells are read, if this is the ``last`` use of it.
    """
    need = lambda a, b: f"{similarity / (1 + similarity)!r}D * ({a} + {b}) - 1e-9"
    keys = prints.select(F.col("key").alias("k"), "h", "n", "fp", "cells")

    def prepare(asked: DataFrame):
        signs = scratch.save(keys.drop("cells").join(asked, "k").groupBy("k").agg(F.min("h").alias("h"), F.max("n").alias("n"), F.max("fp").alias("fp")))
        if last:
            scratch.drop(prints)
        # a key has one h here, whose texts meet in the join, so no set is sent to remove repeats
        whole = scratch.save(whole_sets(rows.join(signs.select("h"), "h", "left_semi").dropDuplicates(["h"]), shingle))
        scratch.release()
        ba, bb = (whole.select(F.col("key").alias(x), F.struct("n", "bits").alias(f"b{x}")) for x in "ab")

        def alike(pairs: DataFrame, likely: bool) -> DataFrame:
            # the bitmaps, an eighth to a quarter of the sets, leave few pairs that are not similar
            few = scratch.save(pairs.join(ba, "a").join(bb, "b").filter(may_overlap("ba", "bb", need("ba.n", "bb.n"))).select("a", "b"))
            sets = scratch.save(whole.select("key", "s").join(few.select(F.explode(F.array("a", "b")).alias("key")), "key", "left_semi"))
            scratch.release()
            sa, sb = (sets.select(F.col("key").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
            return few.join(sa, "a").join(sb, "b").filter(f"size(array_intersect(sa, sb)) >= {need('size(sa)', 'size(sb)')}").select("a", "b")

        def rare(things: DataFrame) -> DataFrame:
            # the SimHashes of these pairs are compared as those of others
            pairs, (fa, fb) = pairs_by_rare_shingles(things, whole, similarity, scratch), (signs.select(F.col("k").alias(x), F.struct("n", "fp").alias(f"f{x}")) for x in "ab")
            return pairs if max_bits >= 64 else pairs.join(fa, "a").join(fb, "b").filter(near("fa", "fb")).select("a", "b")

        near = lambda a, b: f"least({a}.n, {b}.n) >= {need(f'{a}.n', f'{b}.n')} and bit_count({a}.fp ^ {b}.fp) <= {max_bits}"
        return signs.select("k", F.struct("n", "fp").alias("s")), near, alike, rare

    return groups_by_cells(keys.select("k", F.explode("cells").alias("cell")), prepare, scratch)


def keep_one_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, one row of each group of similar documents: its smallest doc_id.

    Documents link when their SimHashes differ in at most max_bits (64: any) and the Jaccard
    similarity of their distinct word shingles is at least ``similarity``; texts without words are alike.  If the smallest id has several rows in
    the group, one of them stays.  Without any id in a group, one of its rows stays.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    prints = scratch.save(sketches(rows, shingle, similarity))
    own = scratch.save(prints.select("id", "h", "key"))
    found = similar_sets(rows, prints, scratch, shingle, similarity, max_bits, last=True).withColumnRenamed("node", "key")
    counted = own.join(found, "key", "left").groupBy(F.coalesce("component", "key").alias("group"), "id", "h").count()
    chosen = counted.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "count")).alias("x"))
    chosen = scratch.save(chosen.select(F.col("x.id").alias("_id"), F.col("x.h").alias("_kh"), F.col("x.count").alias("_c")))
    scratch.drop_since(0, chosen)
    scratch.release()
    # the caller's columns stand in a struct, where no name of ours meets them
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    on = lambda x: marked["id"].eqNullSafe(x["_id"]) & (marked["h"] == x["_kh"])
    one, many = chosen.filter("_c = 1"), chosen.filter("_c > 1")
    kept = marked.join(one, on(one), "left_semi").select("row")
    if not many.isEmpty():
        # written, so that a row's number is the same in both readings
        again = scratch.save(marked.join(many, on(many), "left_semi")).withColumn("number", F.monotonically_increasing_id())
        first = again.groupBy("id", "h").agg(F.min("number").alias("number")).select("number")
        kept = kept.union(again.join(first, "number", "left_semi").select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
