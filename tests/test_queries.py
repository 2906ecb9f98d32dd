"""Every query with SQL against DuckDB, and the rest by invariants."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rounded(map(tuple, got.select(*cols).collect())) == rounded(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_elkan_noto(spark):
    rows = entry.queries()["elkan_noto"](spark, SF).collect()
    assert len(rows) == 500 and all(r.probability >= 0 and r.prediction in (0, 1) for r in rows)


def test_golden_metrics(spark):
    from parhelion.operators import metrics

    def risk(y, s, prior):
        df = spark.createDataFrame([(a, b, int(b > 0)) for a, b in zip(y, s)], "y_pu int, score double, pred int")
        return metrics.scalar_metric(df, "pu_zero_one_risk", prior).first()[0]

    # one of four positives at or below zero, three of eight unlabeled rows above it
    y, s = [1] * 4 + [0] * 8, [3.0, 0.2, 0.0, 7.5, 0.1, -2.0, 4.0, -0.3, 0.0, 1.5, -6.0, -1.0]
    assert risk(y, s, 0.3) == pytest.approx(2 * 0.3 / 4 + 3 / 8 - 0.3)
    assert risk(y, [-x for x in s], 0.3) == pytest.approx(2 * 0.3 + 4 / 8 - 0.3)
    assert risk([0, 0], [1.0, -1.0], 0.3) == math.inf


def test_running_sums_of_many_scores(spark):
    from parhelion.operators import metrics

    scores = [float(i * 37 % 500) / 7 for i in range(900)] + [None, math.nan, math.inf, -math.inf]
    by = spark.createDataFrame([(x,) for x in scores], "s double").groupBy("s").count()
    rank = lambda r: (-math.inf, 0) if r.s is None else (math.inf, 1) if r.s != r.s else (r.s, 0)
    for down in (False, True):
        seen = 0
        for r in sorted(metrics._running(by, ["count"], down).collect(), key=lambda r: (r.s is not None, rank(r)), reverse=down):
            assert r.count_before == seen
            seen += r["count"]


def test_calibrated_prior(spark):
    from parhelion.operators import shift

    given = [0.0, 0.1, 0.1, 0.5, 0.8, 1.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "id int, probability double")
    for prior in (0.05, 0.4, 0.9):
        got = [r.probability for r in shift.calibrate_prior(df, prior).orderBy("id").collect()]
        assert got[6] is None and got[:6] == sorted(got[:6])
        assert abs(sum(got[:6]) / 6 - prior) < 1e-8
    assert shift.calibrate_prior(df.limit(0), 0.4).count() == 0
    assert entry.queries()["prior_logit_shift"](spark, SF).count() == 500


def test_stream_monitor(spark, tmp_path):
    from parhelion.sources.adapters import windows
    from parhelion.streaming.monitor import stream_windows

    src = windows(spark, SF)
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = stream_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    got = spark.sql("select sum(n) from w").first()[0]
    q.stop()
    assert got == src.count()
