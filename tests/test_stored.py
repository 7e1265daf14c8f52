"""Cheaper ways of building, parsing and connecting give what the plain ones do."""

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import graph_build as B
from quillspan.operators import graph_walk as G
from quillspan.operators import retrieval as R
from quillspan.plans import fixtures
from quillspan.session import read_table, stored

SF = "/root/testdata/sf0.001"


def test_the_tree_is_what_its_sql_gives(spark):
    used = {t: read_table(spark, SF, t) for t in ("nation", "supplier", "lineitem")}
    want = spark.sql(fixtures.VIEWS["tree"], **used)
    got = fixtures.view(spark, SF, "tree")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_stored_table_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    table = stored(spark.range(5).mapInPandas(count, "id long"))
    assert sorted(r.id for r in table.collect()) == list(range(5)) and table.count() == 5 and seen.value == 5


def test_unions_are_the_same_in_one_row_and_taken_apart(spark, monkeypatch):
    rows = [("a", 2, ["x", "y", "x"]), ("a", 1, ["y", None, "z"]), ("a", 1, ["q", "y"]), ("a", None, ["w"]), ("a", 5, ["w", "n"]), ("b", 1, [None]), ("c", 1, []), ("c", 2, None), (None, 3, ["k"]), (None, 4, ["k", "j"])]
    table = spark.createDataFrame(rows, "key string, seq long, items array<string>")
    plain = sorted(map(str, B._taken_apart(table, ["key"], "items", "seq", False).collect()))
    assert sorted(map(str, B.ordered_union(table, ["key"], "items").collect())) == plain
    monkeypatch.setattr(B, "ELEMENTS_AT_ONCE", 3)
    assert sorted(map(str, B.ordered_union(table, ["key"], "items").collect())) == plain


def test_components_of_chains_stars_and_alien_ends(spark):
    chain = [(f"k{i:02d}", f"k{i + 1:02d}") for i in range(0, 30)]
    star = [("z", f"s{i}") for i in range(9)]
    edges = spark.createDataFrame(chain[::-1] + star + [("alone", "alone"), ("s0", "gone"), ("gone", "k00"), (None, "z")], "src string, dst string")
    keys = {x for pair in chain + star for x in pair} | {"alone"}
    nodes = spark.createDataFrame([(k,) for k in sorted(keys)], "key string")
    got = {r.key: r.component for r in G.components(nodes, edges).collect()}
    assert got == {k: "k00" if k[0] == "k" else "alone" if k == "alone" else "s0" for k in keys}


def test_responses_of_one_block_are_parsed_by_many_tasks(spark):
    responses = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("prompt_id"), F.lit('{"items": [{"a": 1}, 2, {"a": 3}]}').alias("raw"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = R.response_items(responses).select(F.spark_partition_id().alias("task"), "pos").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 800 and len({r.task for r in tasks}) > 1


def test_items_of_every_shape(spark):
    shapes = ['[{"a":1},2]', '{"topics":3,"contents":[{"b":2}]}', '{"x":1}', "7", "not json", None, '```json\n{"items":[]}\n```']
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, raw string").select("i", F.to_json(F.transform(T.parse_items("raw"), lambda v: F.to_json(v))).alias("out"))
    assert [r.out for r in rows.orderBy("i").collect()] == ['["{\\"a\\":1}"]', '["{\\"b\\":2}"]', '["{\\"x\\":1}"]', "[]", "[]", "[]", "[]"]
