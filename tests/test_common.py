from pyspark.sql import functions as F

from corpusloom.operators import common, index


def test_salted_and_broadcast_joins_agree_on_a_hot_key(spark):
    # A third of the rows share one key.
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "k", "v").collect())
    wide = common.join_small(big, small, ["k"], unique=F.col("id"), rows=1)
    assert rows(wide) == rows(common.join_small(big, small, ["k"])) == rows(big.join(small, "k"))
    semi = lambda n: sorted(r["id"] for r in common.join_small(
        big, small.select("k"), ["k"], "left_semi", unique=F.col("id"), rows=n).collect())
    assert semi(1) == semi(1000)


def test_fits_and_first_per_key(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"), "id")
    assert common.fits(df, 10) and not common.fits(df, 9)
    got = common.first_per_key(df, ["k"], F.col("id").desc()).collect()
    assert {r["k"]: r["id"] for r in got} == {0: 9, 1: 7, 2: 8}


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).repartition(4).select((F.col("id") % 3).alias("k"), "id")
    plan = common.top_k(df, ["k"], 2, F.col("id"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(k"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_stored_reads_back_the_same(spark):
    df = spark.range(20).select("id", F.array(F.lit("a")).alias("t"))
    again = common.stored(df)
    assert again.schema == df.schema.__class__(again.schema.fields) and again.count() == 20


def exchanged(df):
    """Tables below an exchange, by their columns, and the number of exchanges."""
    plan = df._jdf.queryExecution().executedPlan()
    found, total = [], [0]

    def walk(p, below):
        if "AdaptiveSparkPlan" in p.nodeName():
            return walk(p.executedPlan(), below)
        here = p.nodeName() in ("Exchange", "BroadcastExchange")
        total[0] += here
        if p.nodeName().startswith("Scan"):
            found.append((p.nodeName(), below or here))
        for i in range(p.children().size()):
            walk(p.children().apply(i), below or here)

    walk(plan, False)
    return [moved for name, moved in found if "corpusloom_" in name], total[0]


def test_stored_sides_are_not_shuffled(spark):
    """Diff, upkeep and cache read the stored table as it lies."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunk = "chunk_id string, doc_id string, source string, title string, text string, year int, url string, tags array<string>, evidence_level string, chunk_index int"
        rows = [(f"d{i}#c0", f"d{i}", "s", "t", f"x{i}", 2000, "u", ["a"], "other", 0) for i in range(50)]
        old = common.stored_by(spark.createDataFrame(rows, chunk), "chunk_id")
        new = spark.createDataFrame([(*r[:4], r[4] + "!", *r[5:]) if i % 5 == 0 else r for i, r in enumerate(rows[:40])], chunk)
        for df, n in ((index.changed_chunks(old, new, compat=True), 8), (index.stale_chunks(old, new), 10)):
            moved, exchanges = exchanged(df)
            assert moved == [False] and exchanges == 1 and df.count() == n
        cache = common.stored_by(spark.createDataFrame([(str(i), [1.0]) for i in range(9)], "text_hash string, vector array<double>"), "text_hash")
        texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
        out = index.embed_with_cache(texts, cache, lambda c: F.array(F.length(c).cast("double")))
        moved, exchanges = exchanged(out)
        assert moved == [False, False] and exchanges == 1 and out.count() == 11
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
