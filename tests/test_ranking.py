"""Distributed ranks, folds and holdouts against brute force, with hot groups and hot values."""

import random

import pytest
from pyspark.sql import functions as F

from foldwright.functions.hashing import hash_order
from foldwright.operators import folds as FO
from foldwright.operators.encoding import value_positions
from foldwright.operators.ordered_metrics import lorenz_curve
from foldwright.operators.ranking import CODE, ordering_buckets, ranked_by_hash, ranked_by_value


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(3000):
        group = None if i % 11 == 0 else ("hot" if rng.random() < 0.6 else rng.choice("abc"))
        value = 7.0 if rng.random() < 0.4 else rng.choice([0.0, -0.0, rng.gauss(0, 50)])
        out.append((i, group, value))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, g string, v double")


def expected(rows, ascending):
    groups = {}
    for i, g, v in rows:
        groups.setdefault(g, []).append(((v if ascending else -v) + 0.0, i))
    return {i: r for members in groups.values() for r, (_, i) in enumerate(sorted(members), 1)}


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("buckets", [2, 16, 64])
def test_rank_matches_sort(df, rows, ascending, buckets):
    got = ranked_by_value(df, "v", ascending, "row_id", ["g"], buckets).select("row_id", "rank").collect()
    assert {r["row_id"]: r["rank"] for r in got} == expected(rows, ascending)


def test_hot_value_is_split(df):
    sizes = ordering_buckets(df, "v", True, "row_id", 32).groupBy(CODE).count().agg(F.max("count")).first()[0]
    # 40 % of the rows share a value; no bucket may hold anything near that
    assert sizes < 3000 * 0.12


def test_md5_tie_key(spark, rows):
    df = spark.createDataFrame(rows, "n bigint, g string, v double").withColumn("row_id", F.md5(F.col("n").cast("string")))
    got = {r["n"]: r["rank"] for r in ranked_by_value(df, "v", True, "row_id", (), 16).collect()}
    keyed = {r["n"]: r["row_id"] for r in df.select("n", "row_id").collect()}
    order = sorted(((v + 0.0, keyed[i]), i) for i, _, v in rows)
    assert got == {i: r for r, (_, i) in enumerate(order, 1)}


def test_running_sum(df, rows):
    curve = {r["row_id"]: (r["rank"], r["lorenz"], r["even"]) for r in lorenz_curve(df.withColumn("y", F.col("row_id") + 1.0), "v", "y").collect()}
    total, cum = sum(i + 1 for i, _, _ in rows), 0
    for r, (_, i) in enumerate(sorted((-v + 0.0, i) for i, _, v in rows), 1):
        cum += i + 1
        assert curve[i] == (r, pytest.approx(cum / total), pytest.approx((r - 1) / (len(rows) - 1)))


def test_rank_does_not_depend_on_partitions(spark, df):
    def ranks(partitions):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            by_value = ranked_by_value(df.repartition(partitions), "v", False, "row_id", ["g"])
            by_hash = ranked_by_hash(by_value.withColumn("_h", hash_order(7, F.col("row_id"))), "_h", groups=["g"], rank="hr")
            return sorted(tuple(r) for r in by_hash.select("row_id", "rank", "hr").collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    assert ranks(1) == ranks(64)


def test_stratified_folds_are_balanced_and_keep_null_strata(df, rows):
    out = FO.stratified_folds(df, "g", 3, 2)
    assert out.count() == 2 * len(rows)
    sizes = out.groupBy("iter", "g", "fold").count().groupBy("iter", "g").agg((F.max("count") - F.min("count")).alias("gap"))
    assert sizes.agg(F.max("gap")).first()[0] <= 1
    both = out.groupBy("row_id").agg(F.collect_set("iter").alias("i")).filter(F.size("i") != 2).count()
    assert both == 0


def test_block_folds_leave_remainder_out(spark):
    out = FO.block_folds(spark.range(10).withColumnRenamed("id", "row_id"), 3)
    sizes = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert sizes == {-1: 1, 0: 3, 1: 3, 2: 3}


@pytest.mark.parametrize("size", [0, 1, 700, 3000, 5000])
def test_tail_holdout(df, rows, size):
    flagged = {r["row_id"] for r in FO.tail_holdout(df, "v", size).filter("is_valid = 1").collect()}
    order = [i for _, i in sorted((-v + 0.0, i) for i, _, v in rows)]
    assert flagged == set(order[:size])


def test_head_fraction(df, rows):
    flagged = FO.head_fraction(df, "row_id", 0.07843291).filter("is_valid = 1")
    assert flagged.count() == int(0.07843291 * len(rows)) + 1
    assert flagged.agg(F.max("row_id")).first()[0] == int(0.07843291 * len(rows))


def test_large_dictionary(spark, monkeypatch):
    from foldwright.operators import encoding

    monkeypatch.setattr(encoding, "SMALL_DICTIONARY", 10)
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("word"))
    got = {r["word"]: r["code"] for r in value_positions(df, "word", "code").collect()}
    assert got == {w: i for i, w in enumerate(sorted(got))} and len(got) == 500
