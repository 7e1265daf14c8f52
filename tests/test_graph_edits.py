"""Bundles, labelled removals and batches of edits, on small tables and against a plain replay."""

import random

from pyspark.sql import functions as F

from quillspan.functions.text import make_key
from quillspan.operators import graph_build as B
from quillspan.operators import metrics as M
from quillspan.operators import proposals as P

NODE = "key string, node_type string, name string, summary string, scope string, content_type string, raw_excerpt string, key_terms array<string>, source_ids array<string>, seq long"
EDGE = "src string, dst string, relation string, label string, confidence double, source_chunk_ids array<string>"
TOPIC = "name string, summary string, scope string, content_type string, raw_excerpt string, key_terms array<string>, source_ids array<string>, seq long"
SUBTOPIC, CONTENT = TOPIC + ", parents array<string>, parent_subtopics array<string>", TOPIC + ", parents array<string>, topic_parents array<string>"
RELATED = "src string, dst string, label string, confidence double, source_chunk_ids array<string>, seq long"


def key(spark, kind, name):
    return spark.range(1).select(make_key(kind, F.lit(name))).first()[0]


def proposal(name, seq, *more, ids=("c1",)):
    return (name, "", "broad", "other", "", [], list(ids), seq, *more)


def apply(spark, topics=(), subtopics=(), contents=(), related=(), graph=None):
    nodes, edges = graph or (spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((topics, TOPIC), (subtopics, SUBTOPIC), (contents, CONTENT), (related, RELATED))]
    return P.apply_bundle(nodes, edges, *frames)


def test_bundle_with_polyhierarchy_nesting_fallback_and_warnings(spark):
    k = lambda kind, name: key(spark, kind, name)
    got = apply(
        spark,
        [proposal("NLP", 1)],
        [proposal("Transformers", 2, ["nlp ", "Nowhere"], ["Attention", "Transformers", "Unknown"]), proposal("Attention", 3, ["NLP"], None)],
        [proposal("Self-Attention", 4, ["Transformers", "attention", "Gone"], ["NLP"]), proposal("Tokens", 5, ["Gone"], ["NLP", "Gone"]), proposal("Tokens", 6, [], ["NLP"], ids=["c2"])],
        [(k("topic", "NLP"), k("content", "Tokens"), "Used In!", 0.4, ["c9"], 1), (k("topic", "NLP"), k("content", "Tokens"), "used in", 0.7, ["c8", "c9"], 2), ("topic:x", "topic:x", "l", 0.5, None, 3)],
    )
    nlp, tr, at, sa, to = k("topic", "NLP"), k("subtopic", "Transformers"), k("subtopic", "Attention"), k("content", "Self-Attention"), k("content", "Tokens")
    edges = {(r.src, r.dst, r.relation, r.label, r.confidence, tuple(r.source_chunk_ids or ())) for r in got.edges.collect()}
    assert edges == {
        (nlp, tr, "HAS_SUBTOPIC", None, None, ()), (nlp, at, "HAS_SUBTOPIC", None, None, ()), (at, tr, "HAS_SUBTOPIC", None, None, ()),
        (tr, sa, "HAS_CONTENT", None, None, ("c1",)), (at, sa, "HAS_CONTENT", None, None, ("c1",)), (nlp, to, "HAS_CONTENT", None, None, ("c1", "c2")),
        (nlp, to, "RELATED_TO", "used_in", 0.7, ("c9", "c8")),
    }
    assert {(r.seq, r.src, r.dst, r.reason) for r in got.warnings.collect()} == {(2, "Nowhere", tr, "unknown topic"), (4, "Gone", sa, "unknown subtopic"), (5, "Gone", to, "unknown subtopic"), (None, "topic:x", "topic:x", "missing end")}
    nodes = {r.key: r for r in got.nodes.collect()}
    assert nodes[tr].parents == [nlp] and nodes[sa].parents == [tr, at] and nodes[to].parents is None and nodes[to].source_ids == ["c1", "c2"]
    assert {r.what: r.n for r in got.counters.collect()} == {"topics added": 1, "topics merged": 0, "subtopics added": 2, "subtopics merged": 0, "contents added": 2, "contents merged": 1, "structural edges added": 6}


def test_bundle_finds_names_in_the_graph_and_changes_nothing_twice(spark):
    first = apply(spark, [proposal("NLP", 1)], [proposal("Deep", 2, ["NLP"], [])])
    graph = (first.nodes.drop("parents").checkpoint(), first.edges.checkpoint())
    more = dict(subtopics=[proposal("Deeper", 3, [], ["deep"])], contents=[proposal("Net", 4, ["DEEP"], [])])
    once = apply(spark, graph=graph, **more)
    assert once.warnings.isEmpty() and once.edges.count() == 3
    again = apply(spark, graph=(once.nodes.checkpoint(), once.edges.checkpoint()), **more)
    assert sorted(map(str, again.edges.collect())) == sorted(map(str, once.edges.collect()))
    assert sorted(map(str, again.nodes.collect())) == sorted(map(str, once.nodes.collect()))


def test_merge_keeps_pictures_parents_origin_and_times(spark):
    wide = NODE + ", illustration struct<kind:string,hint:string>, illustration_path string, parents array<string>, origin string, created_at timestamp, updated_at timestamp"
    day = lambda d: F.lit(f"2024-01-0{d}").cast("timestamp")
    base = ("content", "n", "", "broad", "other", "", [], ["a"])
    rows = [("k", *base, 1, None, None, ["p"], "manual", None, None), ("u", *base, 2, ("code", "h"), "x.png", None, None, None, None)]
    old = spark.createDataFrame(rows, wide).withColumns({"created_at": day(1), "updated_at": day(1)})
    new = spark.createDataFrame([("k", *base, 3, ("image", "first"), "k.png", ["q", "p"], "ingested", None, None), ("k", *base, 4, ("code", "later"), "z.png", ["r"], None, None, None), ("m", *base, 5, None, "", None, None, None, None)], wide)
    got = {r.key: r for r in B.merge_nodes(old, new, day(5))[0].collect()}
    assert (tuple(got["k"].illustration), got["k"].illustration_path, got["k"].parents, got["k"].origin) == (("image", "first"), "k.png", ["p", "q", "r"], "manual")
    assert [got[k].created_at.day for k in "kum"] == [1, 1, 5] and [got[k].updated_at.day for k in "kum"] == [5, 1, 5]
    assert got["u"].illustration_path == "x.png" and got["m"].origin == "ingested"


def test_only_structural_relations_and_labelled_removal(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "key string")
    wanted = spark.createDataFrame([("a", "b", "EVIDENCE_OF", ["c"], 1), ("a", "b", None, ["c"], 2), ("a", "b", "HAS_CONTENT", ["c", "d"], 3)], "src string, dst string, relation string, source_chunk_ids array<string>, seq long")
    edges, warnings = B.structural_edges(wanted, nodes)
    assert [(r.relation, r.source_chunk_ids) for r in edges.collect()] == [("HAS_CONTENT", ["c", "d"])] and warnings.count() == 2
    parallel = spark.createDataFrame([("a", "b", "RELATED_TO", "uses", 1), ("a", "b", "RELATED_TO", "generalises", 2), ("a", "b", "HAS_CONTENT", None, 3)], "src string, dst string, relation string, label string, seq long")
    gone = lambda relation, label: spark.createDataFrame([("a", "b", relation, label)], "src string, dst string, relation string, label string")
    left = lambda relation, label: sorted(r.seq for r in B.remove_edges(parallel, gone(relation, label)).collect())
    assert left("RELATED_TO", "Generalises!") == [1, 3] and left("RELATED_TO", "none") == [1, 2, 3] and left("RELATED_TO", " ") == [2, 3] and left("HAS_CONTENT", "any") == [1, 2]


def test_queries_without_hits_count_as_misses(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, id string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (2, "a")], "query_id long, id string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert tuple(M.hit_rate_mrr(ranked, relevant).first()) == (1.0, 1.0) and tuple(M.hit_rate_mrr(ranked, relevant, queries=asked).first()) == (0.5, 0.5)
    assert M.context_precision(ranked, relevant, queries=asked).first()[0] == 0.25


def replayed(graph_keys, graph_edges, node_edits, edge_edits, keys):
    """One edit after another, as someone at a form would put them in."""
    known, edges, rejected = set(graph_keys), set(graph_edges), {}
    for seq, kind, *edit in sorted([(e[0], "node", *e[1:]) for e in node_edits] + [(e[0], "edge", *e[1:]) for e in edge_edits]):
        if kind == "node":
            node_type, name, content_type, parents = edit
            if not name.strip():
                rejected[seq] = "empty name"
            elif node_type == "content" and content_type == "poem":
                rejected[seq] = "unknown content type"
            elif keys[node_type, name] in known:
                rejected[seq] = "conflict"
            elif any(p not in known for p in parents):
                rejected[seq] = "missing parent"
            else:
                known.add(keys[node_type, name])
                edges |= {(p, keys[node_type, name], B.PARENT_RELATION[node_type], "") for p in parents}
        else:
            src, dst, relation, label = edit
            form = (label or "").strip().lower() if relation == "RELATED_TO" else ""
            reason = "missing source" if src not in known else "missing target" if dst not in known else "unknown relation" if relation == "IS" else "missing label" if relation == "RELATED_TO" and not form else "conflict" if (src, dst, relation, form) in edges else None
            if reason:
                rejected[seq] = reason
            else:
                edges.add((src, dst, relation, form))
    return known, edges, rejected


def test_batches_of_edits_by_replay(spark):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(12)]
    pairs = [(k, n) for k in ("subtopic", "content") for n in names]
    keys = {p: v for p, v in zip(pairs, [r[0] for r in spark.createDataFrame(pairs, "k string, n string").select(make_key(F.col("k"), F.col("n"))).collect()])}
    every = [*keys.values(), "topic:0", "none"]
    numbers = rng.sample(range(1000), 160)
    node_edits = [(s, *((k, n, rng.choice(["theorem", "poem", None]) if k == "content" else None)), rng.sample(every, rng.choice([0, 1, 1, 2]))) for s in numbers[:90] for k, n in [rng.choice(pairs)]] + [(2000, "content", "  ", None, [])]
    edge_edits = [(s, rng.choice(every), rng.choice(every), rng.choice(["HAS_CONTENT", "RELATED_TO", "RELATED_TO", "IS"]), rng.choice(["uses", "Uses ", " ", None])) for s in numbers[90:]] + [(3000 + i, "topic:0", "topic:0", "RELATED_TO", "Again") for i in range(3)]
    nodes = spark.createDataFrame([("topic:0", "topic", "zero")], "key string, node_type string, name string")
    edges = spark.createDataFrame([], "src string, dst string, relation string, label string")
    got = B.apply_batch(nodes, edges, spark.createDataFrame(node_edits, "seq long, node_type string, name string, content_type string, parents array<string>"), spark.createDataFrame(edge_edits, "seq long, src string, dst string, relation string, label string"))
    known, made, rejected = replayed(["topic:0"], [], node_edits, edge_edits, keys)
    assert {r.seq: r.reason for r in got.rejected.collect()} == rejected
    assert {r.key for r in got.nodes.collect()} == known and got.nodes.count() == len(known)
    assert sorted((r.src, r.dst, r.relation, r.label or "") for r in got.edges.collect()) == sorted(made)


def test_the_same_new_edge_twice(spark):
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([], "src string, dst string, relation string, label string")
    accepted, rejected = B.apply_edits(nodes, edges, spark.createDataFrame([("a", "b", "RELATED_TO", "x"), ("a", "b", "RELATED_TO", "X ")], edges.schema))
    assert accepted.count() == 1 and [r.reason for r in rejected.collect()] == ["conflict"]
