import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketgrid.operators import ranking

SEED = 5


def sample(n=400):
    rnd = random.Random(SEED)
    rows = []
    for i in range(n):
        # one group holds most rows, many values repeat, signs and sizes vary
        g = "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None])
        v = rnd.choice([None, 0.0, -1.5, 3.0, rnd.uniform(-50, 50), rnd.uniform(1e6, 1e6 + 5), rnd.lognormvariate(0, 6)])
        rows.append((f"id{i:04d}", g, v))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(sample(), "id string, g string, v double")


def test_positions_match_pandas_ranks(frame):
    pdf = pd.DataFrame(sample(), columns=["id", "g", "v"])
    known = pdf[pdf.v.notna()].copy()
    grouped = known.groupby("g", dropna=False).v
    known["desc"] = grouped.rank(ascending=False, method="min")
    known["asc"] = grouped.rank(ascending=True, method="min")
    known["n"] = grouped.transform("size")
    got = ranking.with_positions(frame, ["g"], "v").filter("v is not null").select(
        "id", ranking.rank_desc().alias("desc"), ranking.rank_asc().alias("asc"), "n_group",
        ranking.percent_rank().alias("pr")).toPandas().set_index("id")
    want = known.set_index("id")
    assert len(got) == len(want)
    for i, r in want.iterrows():
        assert (got.loc[i, "desc"], got.loc[i, "asc"], got.loc[i, "n_group"]) == (r.desc, r.asc, r.n)
        assert got.loc[i, "pr"] == pytest.approx(0 if r.n == 1 else (r.asc - 1) / (r.n - 1))


def test_quantiles_match_numpy(frame):
    pdf = pd.DataFrame(sample(), columns=["id", "g", "v"]).dropna(subset=["v"])
    got = {r.g: r for r in ranking.quantiles(frame, ["g"], "v", {"p50": 0.5, "p90": 0.9, "p0": 0.0}, count="n").collect()}
    for g, part in pdf.groupby("g", dropna=False):
        r = got[None if pd.isna(g) else g]
        assert r.n == len(part)
        assert [r.p0, r.p50, r.p90] == pytest.approx(list(np.quantile(part.v, [0, 0.5, 0.9])))
    whole = ranking.quantiles(frame, [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median(pdf.v))


def test_ordinal_is_a_permutation_in_order(frame):
    got = ranking.ordinal(frame, ["g"], "v", "id", "pos").select("id", "g", "v", "pos").toPandas()
    assert got[got.v.isna()].pos.isna().all()
    for _, part in got[got.v.notna()].groupby("g", dropna=False):
        part = part.assign(d=[hashlib.md5(i.encode()).hexdigest() for i in part.id]).sort_values(["v", "d"])
        assert list(part.pos) == list(range(len(part)))


@pytest.mark.parametrize("n", [1, 3, 4, 7, 10, 101])
def test_ntile_matches_the_window_function(spark, n):
    from pyspark.sql import Window as W

    df = spark.range(n).withColumn("n", F.lit(n))
    want = [r[0] for r in df.select("id", F.ntile(4).over(W.partitionBy(F.lit(0)).orderBy("id")).alias("t")).orderBy("id").select("t").collect()]
    got = [r[0] for r in df.select("id", ranking.ntile("id", "n", 4).alias("t")).orderBy("id").select("t").collect()]
    assert got == want


def test_bands_match_qcut(spark):
    values = [1, 1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 40, 41, 42, 300]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r.band for r in ranking.bands(df, "v", 10, "band").orderBy("v").collect()]
    assert got == list(pd.qcut(pd.Series(values), 10, labels=False, duplicates="drop"))


def test_top_share_takes_at_least_one_row(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 2.0)], "g string, v double")
    assert ranking.top_share(df, ["g"], "v").first().top_share == pytest.approx(5 / 12)
    big = spark.range(1, 401).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    assert ranking.top_share(big, ["g"], "v").first().top_share == pytest.approx((400 + 399 + 398 + 397) / (400 * 401 / 2))


def test_value_bucket_keeps_order(spark):
    rnd = random.Random(1)
    values = sorted([rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 12) for _ in range(2000)] + [0.0])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.b for r in df.select("v", ranking.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)
