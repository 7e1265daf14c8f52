"""nodes below the same topics are kept once, whatever the number of queries and of scopes that hold them."""

from pyspark.sql import functions as F

from quillspan.operators import graph_walk as G


def test_nodes_are_kept_once_for_all_scopes(spark):
    topics = [f"t{i}" for i in range(4)]
    held = {f"c{i:02}": {topics[i % 4], topics[i % 3]} for i in range(30)}
    unit = lambda i: [1.0 if i == j else 0.0 for j in range(4)]
    nodes = spark.createDataFrame([(t, "topic", unit(i)) for i, t in enumerate(topics)] + [(c, "content", unit(0)) for c in held], "key string, node_type string, embedding array<double>")
    edges = spark.createDataFrame([(t, c, "HAS_CONTENT") for c, ts in held.items() for t in ts], "src string, dst string, relation string")
    wish = {q: (q % 4, (q + 1 + q // 4 % 3) % 4) for q in range(24)}
    asked = spark.createDataFrame([(q, [2 * x + y for x, y in zip(unit(a), unit(b))]) for q, (a, b) in wish.items()], "query_id long, embedding array<double>")
    found = G.scopes(asked, nodes, edges, 0.25)
    # six scopes share these nodes
    assert found.kinds.select("scope").distinct().count() == 6
    assert found.members.count() == found.members.select("node").distinct().count() == len(held)
    pairs = sorted(map(tuple, G.scope_topics(asked, nodes, edges, 0.25).collect()))
    assert pairs == sorted((q, c) for q, w in wish.items() for c, ts in held.items() if ts & {topics[i] for i in w})


def test_closure_goes_on_where_leaves_and_inner_nodes_meet(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "b"), ("x", "d"), ("a", "e")]
    table = spark.createDataFrame([(*e, "HAS_SUBTOPIC") for e in edges], "src string, dst string, relation string")
    got = {tuple(r) for r in G.closure(table, spark.createDataFrame([("a",), ("x",), ("e",), ("b",)], "root string")).select("root", "node", "depth").collect()}
    assert got == {("a", "b", 1), ("a", "c", 1), ("a", "e", 1), ("a", "d", 2), ("x", "d", 1), ("x", "b", 2), ("x", "c", 3), ("b", "c", 1), ("b", "d", 2)}
    assert G.closure(table, spark.createDataFrame([("e",)], "root string")).where(F.col("depth") > 0).count() == 0
