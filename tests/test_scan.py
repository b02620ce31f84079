import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions.scan import Running, page_block, position, running, stack_height


def rows(seed, n=600):
    rng = random.Random(seed)
    out, pos = [], 0
    for _ in range(n):
        # A third of all rows fall on one key; pages jump over several blocks.
        key = "hot" if rng.random() < 0.34 else rng.choice("abcde")
        pos += rng.choice([1, 7, 400])
        out.append((key, pos, rng.randint(0, 50), rng.choice([None, rng.randint(0, 9)]), rng.choice([1, -1])))
    return out


def test_running_values_equal_plain_windows(spark):
    df = spark.createDataFrame(rows(1), "k string, page bigint, start int, v int, step int").withColumn("pos", position(F.col("page"), F.col("start")))
    specs = [Running("s", "sum", F.col("v")), Running("m", "min", F.col("v")), Running("x", "max", F.col("v"), inclusive=False), Running("l", "last", F.col("v"), inclusive=False)]
    ours = running(df, ["k"], ["pos"], page_block(F.col("pos")), specs)
    upto = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    plain = (
        df.withColumn("s", F.coalesce(F.sum("v").over(upto), F.lit(0))).withColumn("m", F.min("v").over(upto))
        .withColumn("x", F.max("v").over(before)).withColumn("l", F.last("v", ignorenulls=True).over(before)))
    assert df.select(page_block(F.col("pos"))).distinct().count() > 3
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_stack_height_equals_a_counter(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, page bigint, start int, v int, step int").withColumn("pos", position(F.col("page"), F.col("start")))
    got = {(r.k, r.pos): r.h for r in stack_height(df, ["k"], ["pos"], page_block(F.col("pos")), F.col("step"), "h").collect()}
    heights = {}
    for k, page, start, _, step in sorted(data, key=lambda r: (r[1], r[2])):
        height = heights.get(k, 0)
        assert got[(k, (page << 32) + start)] == height
        heights[k] = max(0, height + step)


def test_input_is_shuffled_once(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = running(df, ["k"], ["pos"], F.floor(F.col("pos") / 100), [Running("s", "sum", F.lit(1))])
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final
