"""Pairs of groups of very unequal size expand from their smaller side, whichever it is."""

from pyspark.sql import functions as F

from quillspan.llm import ngram_join as N


def _sides(members):
    return (members.select(*(F.col(c).alias(f"{side}_{c}") for c in ("node", "gid", "n", "component"))) for side in "xy")


def test_a_large_group_meets_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(N, "HUB", 16)
    # 50 members in group 0, of which all but three are of component 0; singles in the others, of which every fourth is
    large = spark.range(50).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("gid"), F.when(F.col("id") < 47, 0).otherwise(F.col("id")).cast("long").alias("component"))
    small = spark.range(100, 140).select(F.col("id").alias("node"), F.col("id").alias("gid"), F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id")).cast("long").alias("component"))
    members = large.unionByName(small).withColumn("n", F.lit(9).cast("long"))
    # the large group stands on either side
    pairs = spark.range(100, 140).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(0).alias("b")).unionByName(spark.createDataFrame([(100, 104), (101, 105), (100, 101)], "a long, b long"))
    x, y = _sides(members)
    found = N._between(pairs, members, x, y).where("x_component <> y_component").select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    x, y = _sides(members)
    plain = pairs.join(x, F.col("a") == F.col("x_gid")).join(y, F.col("b") == F.col("y_gid")).where("x_component <> y_component").select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    # each single stands in a row of its own for each part of the large group; before, each of these pairs had 50 rows
    x, y = _sides(members)
    all_met = N._between(pairs, members, x, y)
    assert all_met.where("x_gid = 0").isEmpty() and all_met.where("y_gid = 0").count() == 40 * 50
