"""What operators leave on disk: shuffles of spooled tables, and sets that go along with pairs."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from quillspan.llm import spotsigs
from quillspan.llm._common import spool


def shuffles(spark) -> int:
    """Shuffle files that the session's block manager still holds."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(blocks.apply(i).getName().startswith("shuffle_") for i in range(blocks.size()))


def test_spooled_tables_leave_no_shuffle_files(spark):
    before = shuffles(spark)
    made = spool(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "made")
    for _ in range(50):
        if shuffles(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffles(spark) <= before
    assert made.count() == 10


def test_sketches_keep_all_similar_pairs_and_spare_the_sets_of_others(spark):
    rng = random.Random(5)
    sets = []
    for _ in range(40):
        own = [rng.getrandbits(63) - 2**62 for _ in range(rng.randint(1, 90))]
        for change in (0, 1, len(own) // 10, len(own) // 5):
            sets.append((len(sets), sorted(set(own[change:] + [rng.getrandbits(62) for _ in range(change)]))))
    rows = spotsigs.set_rows(spark.createDataFrame(sets, "id long, signatures array<long>"))
    prefixes = spotsigs._prefixes(rows, spotsigs.set_classes(rows), 0.8)
    nodes = rows.select("row_no", "id").join(prefixes.select(F.col("node").alias("row_no")), "row_no")
    ids = {r.row_no: r.id for r in nodes.collect()}
    pairs = nodes.select(F.col("row_no").alias("a")).crossJoin(nodes.select(F.col("row_no").alias("b"))).where("a < b")
    left = {(ids[r.a], ids[r.b]) for r in spotsigs._not_far(pairs, prefixes, 0.8).collect()}
    held = {k: set(v) for k, v in sets}
    alike = {(ids[r.a], ids[r.b]) for r in pairs.collect() if len(held[ids[r.a]] & held[ids[r.b]]) >= 0.8 * len(held[ids[r.a]] | held[ids[r.b]])}
    assert alike and alike <= left
    assert len(left) < 0.05 * pairs.count()
