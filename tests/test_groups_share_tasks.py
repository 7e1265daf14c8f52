"""nodes at which queries are share tasks, edges are stored as pairs of numbers, words are counted once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import graph_walk as G
from quillspan.operators import similarity as V


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(11)
    kinds = np.round(rng.normal(size=(9, 3)), 1)
    members = sorted({(f"g{g}", f"n{i:02}", i % 9) for g in range(7) for i in range(40) if (i * (g + 2)) % 5 < 3 and (g, i) != (3, 0)} | {("g8", "n00", 0), ("lone", "n01", 1)})
    queries = [(f"g{g}", q, np.round(rng.normal(size=3), 1).tolist()) for q in range(11) for g in range(9) if (q + g) % 3] + [("none", 1, [1.0, 0.0, 0.0]), ("g1", 77, None), ("g1", 78, [1.0])]
    table = spark.createDataFrame([(g, n, f"c{c}") for g, n, c in members], "group string, id string, cls string")
    classes = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(kinds)], "cls string, embedding array<double>")
    return members, kinds, queries, table, classes, spark.createDataFrame(queries, "group string, query_id int, embedding array<double>")


@pytest.mark.parametrize(("block", "part", "own"), [(8192, 16384, 1 << 18), (2, 3, 0)])
def test_groups_that_share_tasks_give_what_each_gives_alone(groups, monkeypatch, block, part, own):
    members, kinds, queries, table, classes, asked = groups
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    monkeypatch.setattr(V, "PART_VECTORS", part)
    for least in (None, 0.3):
        want = set()
        for group, q, v in queries:
            rows = sorted((-round(float(np.dot(kinds[c], v)), 9), n) for g, n, c in members if g == group) if v and len(v) == 3 else []
            want |= {(group, q, n, -s) for s, n in rows[:4] if least is None or -s >= least}
        got = V.topk_within(table, classes, asked, 4, 512, own, least).collect()
        assert {(r.group, r.query_id, r.id, round(r.score, 9)) for r in got} == want and len(got) == len(want) > 50


def test_small_groups_do_not_take_a_task_each(groups):
    *_, table, classes, asked = groups
    one = [F.lit(0).alias("block"), F.lit(0).alias("part")]
    left = asked.where("size(embedding) = 3").select("group", *one, "query_id", "embedding")
    right = table.groupBy("group", "cls").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(classes.withColumnRenamed("embedding", "vector"), "cls").select("group", *one, "ids", "vector")
    found = list(V._within(left.toArrow(), right.toArrow(), 4, None))
    assert len(found) == 1 and len(set(found[0][0].to_pylist())) == 8


def test_starts_outside_the_nodes_and_equal_edges(spark):
    nodes = spark.createDataFrame([("b", "content", [1.0, 0.0]), ("c", "content", [0.8, 0.6]), ("r", "chunk_ref", [1.0, 0.0]), ("n", "content", None)], "key string, node_type string, embedding array<double>")
    edges = spark.createDataFrame([("gone", "b", "HAS_CONTENT", None), ("gone", "b", "HAS_CONTENT", None), ("b", "c", "RELATED_TO", "x"), ("b", "r", "RELATED_TO", "x"), ("b", "n", "RELATED_TO", "x"), ("b", "lost", "RELATED_TO", "x"), ("c", "c", "RELATED_TO", "x")], "src string, dst string, relation string, label string")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<double>")
    starts = spark.createDataFrame([(1, "gone"), (1, "gone"), (2, "nowhere")], "query_id long, node string")
    reached, kept = G.walk(asked, starts, nodes, edges, 3, 0.4, 10)
    assert sorted((r.query_id, r.node, r.hop, r["rank"]) for r in reached.collect()) == [(1, "b", 1, 1), (1, "c", 2, 1), (1, "gone", 0, 1), (2, "nowhere", 0, 1)]
    assert sorted(map(tuple, kept.select("src", "dst").collect())) == [("b", "c"), ("gone", "b"), ("gone", "b")]


def test_a_corpus_is_counted_once(spark):
    corpus = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, None), (4, "d, A")], "id long, text string")
    encoder, vectors = V.encode_corpus(corpus, 64)
    plain = V.fit_encoder(corpus, 64)
    assert vectors.columns == ["id", "embedding"]
    assert sorted(map(str, vectors.collect())) == sorted(map(str, plain.encode(corpus).drop("text").collect()))
    asked = spark.createDataFrame([("a d x",)], "text string")
    assert encoder.encode(asked).collect() == plain.encode(asked).collect()
