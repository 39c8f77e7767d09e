import random

from pyspark.sql import functions as F

from quern.operators.ordering import keep_first, keep_first_text, number_rows, top_per_group


def skewed(spark, n=4000, seed=3):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 50)}", rng.randint(0, 9))
            for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, key string, score int").repartition(7)


def test_keep_first_with_a_hot_key(spark):
    rows, df = skewed(spark)
    want = {}
    for i, key, score in sorted(rows):
        want.setdefault(key, (i, score))
    for result in (keep_first(df, ["key"], ["id"]), keep_first_text(df, "key", ["id"])):
        assert {r.key: (r.id, r.score) for r in result.collect()} == want
        assert result.columns == df.columns


def test_keep_first_is_idempotent(spark):
    _, df = skewed(spark)
    once = keep_first(df, ["key"], ["id"])
    assert sorted(once.collect()) == sorted(keep_first(once, ["key"], ["id"]).collect())


def test_top_per_group_equals_sorting(spark):
    rows, df = skewed(spark)
    groups = {}
    for i, key, score in sorted(rows, key=lambda r: (-r[2], r[0])):
        groups.setdefault(key, []).append(i)
    want = {(key, rank, i) for key, ids in groups.items() for rank, i in enumerate(ids[:20], 1)}
    order = [F.desc("score"), F.asc("id")]
    for parts in (1, 8):
        got = top_per_group(df.repartition(parts), ["key"], order, 20, spread=3).collect()
        assert {(r.key, r["rank"], r.id) for r in got} == want
    assert top_per_group(df, ["key"], order, 0).count() == 0


def test_top_per_group_beyond_the_default_group_limit(spark):
    rows, df = skewed(spark)
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    got = top_per_group(df, ["key"], [F.col("id")], 1500)
    assert got.filter("key = 'hot'").count() == 1500
    assert spark.conf.get(name) == before


def test_a_null_order_key_comes_first_whatever_the_columns(spark):
    rows = [("k", None, 1), ("k", 3, 2)]
    wide = spark.createDataFrame(rows, "key string, id long, x int")
    for df in (wide, wide.drop("x")):
        assert keep_first(df, ["key"], ["id"]).first().id is None


def test_row_numbers_do_not_depend_on_partitions(spark):
    rows, df = skewed(spark)
    want = {i: n for n, i in enumerate(sorted(r[0] for r in rows), 1)}
    for parts in (1, 9):
        got = number_rows(df.repartition(parts), ["id"]).collect()
        assert {r.id: r.row_no for r in got} == want
