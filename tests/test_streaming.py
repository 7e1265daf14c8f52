"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from quillspan.operators import proposals as P
from quillspan.operators.chunking import window_chunks
from quillspan.sources.graph_store import ARRIVALS, EDGES, NODES, GraphStore
from quillspan.streaming.jobs import chunk_versions, graph_stream, ingest_stream, window_chunks_stream


def test_ingest_upserts_by_batches(spark, tmp_path):
    root, schema = str(tmp_path), "chunk_id string, text string, seq long"
    for rows in ([("a", "one", 1), ("b", "one", 2)], [("b", "two", 3), ("c", "two", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root + "/in")
        ingest_stream(spark, root + "/in", schema, root + "/out", root + "/check", buckets=4).awaitTermination(120)
    got = chunk_versions(spark, root + "/out", schema, buckets=4).pin()
    assert got.version == 2 and {r.chunk_id: r.text for r in got.table("chunks").collect()} == {"a": "one", "b": "two", "c": "two"}


def arrivals(spark, batch):
    """Batch k: a topic, subtopics below it and below those of the batch before, and contents of which some come again."""
    rows = [{"kind": "topic", "name": f"T{batch}"}, {"kind": "topic", "name": "T0", "summary": "longer" * batch}]
    rows += [{"kind": "subtopic", "name": f"S{batch}.{i}", "parents": [f"T{batch}", "T0", "nowhere"], "parent_subtopics": [f"S{batch - 1}.{i}"] if batch else []} for i in range(4)]
    rows += [{"kind": "content", "name": f"C{i}", "parents": [f"S{batch}.{i % 4}"] if i % 3 else ["missing"], "topic_parents": ["T0"], "key_terms": [f"k{batch}", "K0"]} for i in range(batch, batch + 6)]
    base = {"summary": "", "scope": "broad", "content_type": "other", "raw_excerpt": "", "key_terms": [], "source_ids": [f"c{batch}"]}
    return [base | r | {"seq": 100 * batch + i} for i, r in enumerate(rows)]


def shape(nodes, edges):
    fields = [f.split(" ")[0] for f in NODES.split(", ") if "_at" not in f and "<kind" not in f]
    return sorted(map(str, nodes.select(*fields).collect())), sorted(map(str, edges.select(*(f.split(" ")[0] for f in EDGES.split(", "))).collect()))


def test_graph_grows_by_touched_buckets_as_a_rebuild_would(spark, tmp_path):
    root, batches = str(tmp_path), [spark.createDataFrame(arrivals(spark, b), ARRIVALS) for b in range(3)]
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(root + "/in")
        graph_stream(spark, root + "/in", root + "/graph", root + "/check", 16).awaitTermination(300)
    store = GraphStore(spark, root + "/graph", 16)
    got = store.pin()
    assert got.version == 3
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    tiers = [whole.where(F.col("kind") == k) for k in ("topic", "subtopic", "content")]
    none = whole.limit(0).select("src", "dst", "label", "confidence")
    rebuilt = P.apply_bundle(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), *tiers, none)
    assert shape(got.table("nodes"), got.table("edges")) == shape(rebuilt.nodes, rebuilt.edges)
    said = got.table("warnings").collect()
    assert {(r.batch, r.src) for r in said} == {(b, w) for b in range(3) for w in ("nowhere", "missing")} and len(said) == rebuilt.warnings.count()
    # a batch that comes again changes nothing; untouched buckets keep their files
    assert store.apply(batches[2], 2, root + "/check").version == 3
    more = store.apply(spark.createDataFrame([arrivals(spark, 0)[0]], ARRIVALS), 3, root + "/check")
    (own,) = store.versions.touched(batches[0].where("seq = 0").selectExpr("'topic:' || substring(sha1('t0'), 1, 12) AS key"), "key")
    old, new = (s.content["tables"]["nodes"]["folders"] for s in (got, more))
    assert {k for k in new if new[k] != old.get(k)} == {str(own)} and more.content["tables"]["edges"] == got.content["tables"]["edges"]


def segments(spark, rows):
    return spark.createDataFrame([(s, q, float(t), float(t) + 5, f"w{q}") for s, q, t in rows], "source_id string, seq long, start double, end double, text string")


def run(spark, root, name, watermark):
    schema = "source_id string, seq long, start double, end double, text string"
    stream = window_chunks_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root + "/in"), 60.0, watermark)
    query = stream.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.read.parquet(f"{root}/{name}")


def test_stream_windows_equal_batch_windows_and_late_rows_go(spark, tmp_path):
    root = str(tmp_path)
    rows = [(s, q, t) for s, n in (("a", 60), ("b", 7)) for q, t in enumerate(range(0, n * 31, 31))]
    early, later = [r for r in rows if r[2] < 600], [r for r in rows if r[2] >= 600]
    for part in (early, later, [("a", 900, 5)], [("end", 0, 100_000)], [("end", 1, 200_000)]):
        segments(spark, part).coalesce(1).write.mode("append").parquet(root + "/in")
    got = run(spark, root, "out", "1 minute").where("source_id <> 'end'")
    want = window_chunks(segments(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
