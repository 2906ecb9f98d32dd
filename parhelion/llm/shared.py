"""Scratch tables, connected components and row numbers used by the operators.

Lineage is cut by tables written to the folder in ``spark.checkpoint.dir``, which
every executor sees, so a lost executor costs a re-read and nothing more.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", root := "file://" + tempfile.mkdtemp(prefix="parhelion-"))
    return root


class Scratch:
    """Written intermediate tables of one operator call, deleted when the JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch), True)

    def drop_since(self, first: int, *but: DataFrame) -> None:
        """Delete the tables from number ``first`` on, except ``but``."""
        kept = {t._scratch for t in but}
        for path in (f"{self.base}/{i}" for i in range(first, self.count)):
            if path not in kept:
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now."""
        gc.collect()
        self.spark._jvm.System.gc()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns node, component (the smallest node reachable) for edges (a, b).

    Alternating large-star and small-star steps; each is two aggregations and two
    equi-joins, and the number of rounds grows with the logarithm of the longest
    chain; they end as soon as all edges are stars around their smallest nodes.  Only
    counts come to the driver.  Null ends and loops are ignored; no edges give no rows.
    """
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("a is not null and b is not null and lo < hi")
    e = scratch.save(e.distinct())
    while True:
        ends = e.select(F.col("hi").alias("x"), F.lit(True).alias("up")).union(e.select("lo", F.lit(False)))
        # a node with two smaller ones, or with a smaller and a larger one
        if not ends.groupBy("x").agg(F.count_if("up").alias("n"), F.bool_and("up").alias("all")).filter("n > 1 or n = 1 and not all").agg(F.count("*")).first()[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.save(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = scratch.save(small.union(least.select("hi", "m")).distinct())
        scratch.drop(e, large)
        e = after


def merged_groups(groups: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component of groups (node, component) and links (a, b) together.

    Only the groups that a link joins go through the components, each as one node, the
    smallest of its own; the others are not dealt anew.
    """
    ends = links
    for v in "ab":
        own = groups.select(F.col("node").alias(v), F.col("component").alias("own"))
        ends = ends.join(own, v, "left").withColumn(v, F.coalesce("own", v)).drop("own")
    merged = scratch.save(connected_components(ends, scratch))
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = groups.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return kept.union(merged.join(groups, "node", "left_anti"))


#: Pairs are dealt into so many parts, of which the last step compares these together, one range after the other, if they are more than MANY to a thing.
PARTS, WAVES, MANY = 64, ((0, 1), (1, 8), (8, 64)), 16

#: The ranges where whole things meet, which are sent once for each.
INSIDE_WAVES = ((0, 8), (8, 64))


#: Members of a part of a cell where whole things meet.
INSIDE = 128


def met_inside(parts: DataFrame, near, whole: DataFrame, same, low: int = 0, high: int = PARTS) -> DataFrame:
    """a, b: the alike pairs of different c of parts (cell, k, s, c, i, low, high), each in the smallest of its cells, compared where two parts meet.

    A thing of part i meets those of the parts from low to high of its cell.

    Of all pairs those that are dealt into the parts from ``low`` to before ``high`` of PARTS.
    """
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes = parts.groupBy("k").agg(F.collect_set("cell").alias("homes"))
    full = parts.join(homes.join(whole, "k"), "k")
    # dealt by number, as a part takes time and not bytes
    x = full.withColumn("j", F.explode(F.expr("sequence(i, high)"))).repartition(n, "cell", "i", "j").alias("x")
    y = full.withColumn("j", F.explode(F.expr("sequence(low, i)"))).select("cell", F.col("j").alias("i"), F.col("i").alias("j"), "k", "s", "c", "homes", "t").repartition(n, "cell", "i", "j").alias("y")
    first = "(size(x.homes) = 1 or size(y.homes) = 1 or x.cell = array_min(array_intersect(x.homes, y.homes)))"
    dealt = f"pmod(xxhash64(least(x.k, y.k), greatest(x.k, y.k)), {PARTS}) between {low} and {high - 1}" if high - low < PARTS else "true"
    links = x.join(y, F.expr(f"x.cell = y.cell and x.i = y.i and x.j = y.j and x.c != y.c and (x.i < x.j or x.c < y.c) and {dealt} and {near('x.s', 'y.s')} and {first} and {same('x.t', 'y.t')}"))
    return links.select(F.expr("least(x.k, y.k)").alias("a"), F.expr("greatest(x.k, y.k)").alias("b"))


def groups_by_cells(cells: DataFrame, prepare, scratch: Scratch, rounds: int = 2, chunk: int = 256, dense: int = 64) -> DataFrame:
    """node, component of things (k, longs): the components of all alike pairs that share a cell.

    First, in ``rounds`` rounds, every cell's members are compared with two heads, the
    smallest and the largest k of no head's group; heads have then met the whole cell and
    leave it.  What is left of cells that still hold several groups is compared pair by
    pair, without pairs of one group, so no link between groups is lost.  The members of
    a cell are dealt into parts of about ``chunk``, and a task gets two parts, so that a
    crowded cell is shared out.  Of many pairs a small part is compared first, and pairs
    that it brings into one group are not compared.  ``prepare`` gets the k of all members of shared cells and returns
    signs (k, s), a function from two names of s to the SQL of whether such a pair can be
    alike, a function from pairs (a, b) to those that are, told whether most of them may be,
    and, if there is one, a function from things (k, c) to pairs (a, b) among which are all
    alike pairs of different c: it takes the place of pair by pair in cells with over ``dense`` members left.
    If it also returns whole things (k, t) and a function from two names of t to the SQL of
    whether such a pair is alike, the last step compares the things of a cell where they meet
    and writes no pairs; a pair is compared in the smallest cell where both are left.  A function
    from a name of s to the SQL of a number, and how far apart those of an alike pair are at
    most, may follow: then parts hold things of near numbers and meet only the parts in reach.
    Of cells with the same members one is used.
    """
    # dealt once, for the sums and the join
    cells = cells.repartition("cell")
    shared = cells.groupBy("cell").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo != hi").select("cell")
    everything = scratch.save(cells.join(shared, "cell").distinct())
    members = everything.groupBy("cell").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y"))
    crowd_table = scratch.save(everything.join(members.groupBy("n", "lo", "hi", "x", "y").agg(F.min("cell").alias("cell")).select("cell"), "cell"))
    scratch.drop(everything)
    scratch.release()
    signs, near, alike, rare, inside = (*prepare(crowd_table.select("k").distinct()), None, None)[:5]
    inside, order = (inside[:2], inside[2:]) if inside else (None, ())
    crowd = crowd_table.join(signs, "k").select("cell", "k", "s", F.col("k").alias("c"), F.lit(False).alias("met"))
    groups, last = None, crowd_table

    def joined(pairs: DataFrame, likely: bool | None) -> DataFrame:
        began = scratch.count
        found = pairs if likely is None else scratch.save(alike(pairs, likely))
        out = scratch.save(connected_components(found, scratch) if groups is None else merged_groups(groups, found, scratch))
        scratch.drop_since(began, out)
        scratch.release()
        return out

    for turn in range(rounds + 1):
        fresh = F.lit(True)
        if groups is not None:
            own = groups.select(F.col("node").alias("k"), "component")
            crowd = crowd.join(own, "k", "left").select("cell", "k", "s", F.coalesce("component", "k").alias("c"), "met")
            open_c = F.when(~F.col("met"), F.col("c"))
            spread = crowd.groupBy("cell").agg(F.collect_set(F.when(F.col("met"), F.col("c"))).alias("taken"), F.count(open_c).alias("n"), F.min(open_c).alias("c0"), F.max(open_c).alias("c1"))
            crowd = scratch.save(crowd.join(spread.filter("c0 != c1").drop("c0", "c1"), "cell"))
            scratch.drop(last)
            last = crowd
            fresh = ~F.col("met") & ~F.array_contains("taken", F.col("c"))
        if turn < rounds:
            head = F.when(fresh, F.struct("k", "c", "s"))
            crowd = scratch.save(crowd.join(crowd.groupBy("cell").agg(F.min(head).alias("lo"), F.max(head).alias("hi")), "cell"))
            scratch.drop(last)
            last = crowd
            pairs = crowd.filter("not met").select("k", "c", "s", F.explode(F.array("lo", "hi")).alias("h")).filter(f"h.c != c and {near('h.s', 's')}")
            pairs = pairs.select(F.col("h.k").alias("a"), F.col("k").alias("b"))
            crowd = crowd.select("cell", "k", "s", F.expr("met or k <=> lo.k or k <=> hi.k").alias("met"))
        else:
            size = min(chunk, INSIDE) if inside else chunk
            parts = crowd.filter("not met").select("cell", "k", "s", "c", "n", F.expr(f"ceil(n / {size})").alias("g")).withColumn("i", F.expr("pmod(xxhash64(k), g)"))
            if inside:
                parts = parts.withColumns({"low": F.lit(0).cast("long"), "high": F.expr("g - 1")})
                if order:
                    of, reach = order
                    upto = lambda end: f"count(*) over (partition by cell order by v range between unbounded preceding and {end})"
                    at = {"i": "row_number() over (partition by cell order by v) - 1L", "low": upto(f"{reach!r}D preceding"), "high": upto(f"{reach!r}D following") + " - 1L"}
                    parts = parts.drop(*at).withColumn("v", F.expr(of("s"))).select("cell", "k", "s", "c", "n", *[F.expr(f"({e}) div {size}").alias(x) for x, e in at.items()])
                last = parts = scratch.save(parts)
                members, things = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.approx_count_distinct("k")).first()
                for low, high in INSIDE_WAVES if members > 2 * MANY * things else ((0, PARTS),):
                    own = groups.select(F.col("node").alias("k"), "component")
                    now = parts.join(own, "k", "left").withColumn("c", F.coalesce("component", "c")).drop("component") if low else parts
                    groups = joined(scratch.save(met_inside(now, near, *inside, low, high)), None)
                scratch.drop(last)
                return groups
            crowded = parts.filter(f"n > {dense}").select("k", "c").distinct() if rare else None
            if rare:
                parts = parts.filter(f"n <= {dense}")
            x = parts.withColumn("j", F.explode(F.expr("sequence(i, g - 1)"))).alias("x")
            y = parts.withColumn("j", F.explode(F.expr("sequence(0L, i)"))).alias("y")
            pairs = x.join(y, F.expr(f"x.cell = y.cell and x.i = y.j and x.j = y.i and x.c != y.c and (x.i < x.j or x.c < y.c) and {near('x.s', 'y.s')}"))
            pairs = pairs.select(F.expr("least(x.k, y.k)").alias("a"), F.expr("greatest(x.k, y.k)").alias("b"))
            if rare and not crowded.isEmpty():
                pairs = pairs.union(rare(crowded))
        if turn < rounds:
            groups = joined(pairs.distinct(), turn == 0)
            continue
        pairs = scratch.save(pairs.distinct())
        scratch.drop(last)
        n, things = pairs.agg(F.count("*"), F.approx_count_distinct("a")).first()
        for low, high in WAVES if n > MANY * things else ((0, PARTS),):
            part = pairs.filter(f"pmod(xxhash64(a, b), {PARTS}) between {low} and {high - 1}")
            if low:
                ca, cb = (groups.select(F.col("node").alias(v), F.col("component").alias(f"c{v}")) for v in "ab")
                part = part.join(ca, "a", "left").join(cb, "b", "left").filter("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")
            groups = joined(part, False)
    return groups


def number_rows(rows: DataFrame, keys: list[str], scratch: Scratch, weight: str | None = None) -> DataFrame:
    """Add ``row`` (from 0, in the order of keys), or with weight the sum of it before.

    The rows are range-partitioned by keys and one more column that splits ties, and
    written; the driver sees one total for each partition, never rows.  Rows that tie
    in all keys are interchangeable, so which comes first changes no result.
    """
    order = [*keys, "_tie"]
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = scratch.save(rows.withColumn("_tie", F.monotonically_increasing_id()))
    ranged = first.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.save(ranged)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    totals = dict(ranged.groupBy("_part").agg(F.sum(w)).collect())
    before, starts = 0, []
    for p in sorted(totals):
        starts.append((p, before))
        before += totals[p]
    spark = rows.sparkSession
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumn("_sum", F.sum(w).over(inside) - w).join(F.broadcast(offsets), "_part")
    return out.withColumn("row", F.col("_start") + F.col("_sum")).drop("_tie", "_part", "_start", "_sum")
