import os

from pyspark.sql import functions as F

from trussline.llm.common import clear_scratch, crc_mod, discard, hashed_sample, lower_ascii, scratch_path, written


def test_hashed_sample_takes_the_lowest_hashes_of_every_label(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a")).when(F.col("id") < 7, F.lit("rare")).otherwise(F.lit("b")).alias("lang"))
    got = hashed_sample(rows, "lang", 40, 7).collect()
    h = {r.doc_id: r.h for r in rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 31)).alias("h")).collect()}
    want = set()
    for lang in ("a", "b", "rare"):
        ids = [r.doc_id for r in rows.where(F.col("lang") == lang).collect()]
        want |= {(i, lang) for i in sorted(ids, key=lambda i: (h[i], i))[:40]}
    assert {(r.doc_id, r.lang) for r in got} == want and len(got) == len(want)
    assert hashed_sample(rows.limit(0), "lang", 5).count() == 0


def test_helpers(spark):
    df = spark.createDataFrame([(0, "AZÉß"), (None, None)], "doc_id long, t string")
    assert [r.v for r in df.select(lower_ascii(F.col("t")).alias("v")).collect()] == ["azÉß", None]
    assert [r.v for r in df.select(crc_mod("doc_id", 5).alias("v")).collect()] == [0xF4DBDF21 % 5, None]
    kept = written(df, "copy")
    assert kept.count() == 2
    discard(kept)
    assert not os.path.exists(kept.scratch_path)
    path = scratch_path(spark, "x")
    os.makedirs(path)
    clear_scratch(spark)
    assert not os.path.exists(path)


def test_sample_drops_rows_before_it_exchanges_them(spark):
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 'a').otherwise('b').alias("lang"))
    plan = hashed_sample(rows, "lang", 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
