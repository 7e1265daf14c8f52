"""An ingest run whole, on a few chunks whose graph is plain to see."""

from pyspark.sql import functions as F

from quillspan.functions.text import make_key
from quillspan.operators import ingest as I
from quillspan.sources.graph_store import EDGES, NODES
from quillspan.sources.store import load_graph, save_graph


def keys(spark, *pairs):
    rows = spark.createDataFrame(list(pairs), "k string, n string")
    return {(r.k, r.n): r.key for r in rows.select("k", "n", make_key(F.col("k"), F.col("n")).alias("key")).collect()}


def embed(df):
    """Two numbers by what a text is about: gravity lies along one, all else along the other, a little apart."""
    tilt = F.when(F.lower("text").contains("gravit"), 0.0).when(F.lower("text").contains("orbit"), 0.7).otherwise(1.5)
    return df.withColumn("embedding", F.array(F.cos(tilt), F.sin(tilt)))


def test_a_run_grows_links_and_prunes_the_graph(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "s", 1), ("c2", "s", 2), ("c3", "t", 3)], "chunk_id string, source_id string, seq long")
    raw = lambda *rows: spark.createDataFrame(list(rows), "prompt_id string, raw string")
    responses = I.Responses(
        raw(("s", '[{"name": "Gravitation", "scope": "narrow"}]'), ("t", '[{"name": "Cells"}]')),
        raw(("c1", '[{"name": "Orbits", "summary": "a"}]'), ("c2", '[{"name": "orbits ", "summary": "longer"}, {"name": "Falling"}]'), ("c3", '[{"name": "Walls", "parent_topic": "Nowhere"}]')),
        raw(("c1", '[{"title": "Kepler"}, {"title": "Apple", "parent_subtopic": "Lost"}]'), ("c2", '[{"title": "Kepler", "key_terms": ["ellipse"]}, {"title": "Newton"}]'), ("c3", '[{"title": "Membrane"}]')),
        spark.createDataFrame([(0, i, "Close to", 0.6) for i in range(10)], "batch long, index long, label string, confidence double"),
    )
    k = keys(spark, *[(kind, n) for kind, names in (("topic", ("Gravity", "Cells")), ("subtopic", ("Orbits", "Falling", "Walls")), ("content", ("Kepler", "Apple", "Newton", "Membrane"))) for n in names])
    old = spark.createDataFrame([(k["topic", "Gravity"], "topic", "Gravity", "", "broad", None, "", [], ["c0"], 0)], ", ".join(NODES.split(", ")[:10])).select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("origin", "string"),)))
    got = I.ingest(chunks, responses, old, spark.createDataFrame([], EDGES), embed, band=(0.7, 0.8))
    nodes = {r.key: r for r in got.nodes.collect()}
    # "Gravitation" is what the graph calls "Gravity"; "Cells" has nothing below it but "Membrane"'s fallback, which isn't needed
    edges = {(r.src, r.dst, r.relation) for r in got.edges.collect()}
    t, s, c = (lambda n: k["topic", n]), (lambda n: k["subtopic", n]), (lambda n: k["content", n])
    want = {(t("Gravity"), s("Orbits"), "HAS_SUBTOPIC"), (t("Gravity"), s("Falling"), "HAS_SUBTOPIC")}
    want |= {(s("Orbits"), c("Kepler"), "HAS_CONTENT"), (s("Falling"), c("Kepler"), "HAS_CONTENT"), (s("Orbits"), c("Newton"), "HAS_CONTENT"), (s("Falling"), c("Newton"), "HAS_CONTENT"), (s("Walls"), c("Membrane"), "HAS_CONTENT"), (t("Gravity"), c("Apple"), "HAS_CONTENT")}
    assert {e for e in edges if e[2] != "RELATED_TO"} == want
    # gravity and orbits are alike enough and not too much
    assert {frozenset(e[:2]) for e in edges if e[2] == "RELATED_TO"} == {frozenset((t("Gravity"), s("Orbits")))} | {frozenset((s("Orbits"), x)) for x in ()}
    assert nodes[t("Gravity")].source_ids == ["c0", "c1", "c2"] and nodes[t("Gravity")].scope == "narrow" and t("Cells") not in nodes
    assert nodes[s("Orbits")].summary == "longer" and nodes[s("Orbits")].source_ids == ["c1", "c2"] and nodes[c("Kepler")].key_terms == ["ellipse"]
    assert {(r.src, r.dst, r.reason) for r in got.warnings.collect()} == {("Nowhere", s("Walls"), "unknown topic"), ("Lost", c("Apple"), "unknown subtopic")}
    save_graph(got.nodes, got.edges, str(tmp_path / "g"))
    first = load_graph(spark, str(tmp_path / "g"))
    # saved again from itself, while the first version is still being read
    save_graph(first[0].where("node_type <> 'topic'"), first[1], str(tmp_path / "g"))
    assert load_graph(spark, str(tmp_path / "g"))[0].count() == len(nodes) - 1 and first[0].count() == len(nodes)
