"""Queries of versioned tables and of the streams that write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.plans.queries_build import _CONTENT, _CONTENTS, _SUB, _TOPIC
from quillspan.plans.registered import Register
from quillspan.session import working_path
from quillspan.sources.graph_store import ARRIVALS, GraphStore
from quillspan.sources.store import upsert, write_export
from quillspan.sources.versions import Snapshot, Versions
from quillspan.streaming.jobs import graph_stream, window_chunks_stream

register = Register()

_CHUNKS = "chunk_id string, source_id string, text string, seq long"
_GONE = ("src1", "src5", "none")


def _changed(chunks) -> tuple[Versions, Snapshot]:
    """Chunks put in twice, the second time onto the table being read."""
    spark = chunks.sparkSession
    store = Versions(spark, working_path(spark, "chunks"), {"chunks": ("chunk_id", _CHUNKS)}, 16)
    rows = chunks.select("chunk_id", "source_id", "text", F.col("seq").cast("long").alias("seq"), "modality")
    store.change("chunks", rows.where("seq % 3 <> 0").drop("modality"), lambda old, new: upsert(old, new))
    again = rows.where("seq % 2 = 0").withColumn("text", F.concat(F.lit("new "), "modality")).drop("modality")
    return store, store.change("chunks", again, lambda old, new: upsert(old, new))


@register.add("s6_versions", "chunks", oracle="""SELECT chunk_id, source_id, CASE WHEN seq % 2 = 0 THEN 'new ' || modality ELSE text END AS text FROM chunks
  WHERE (seq % 3 <> 0 OR seq % 2 = 0) AND source_id NOT IN ('src1', 'src5')""")
def versions(chunks):
    return _changed(chunks)[0].delete("chunks", "source_id", _GONE)[0].table("chunks").drop("seq")


@register.add("s7_versions", "chunks", oracle="""SELECT s.source_id, count(chunk_id) AS removed FROM (VALUES ('src1'), ('src5'), ('none')) s(source_id)
  LEFT JOIN (SELECT * FROM chunks WHERE seq % 3 <> 0 OR seq % 2 = 0) c ON c.source_id = s.source_id GROUP BY 1""")
def versions_removed(chunks):
    removed = _changed(chunks)[0].delete("chunks", "source_id", _GONE)[1]
    return chunks.sparkSession.createDataFrame(sorted(removed.items()), "source_id string, removed long")


@register.add("s10_pinned", "chunks", oracle="SELECT chunk_id, text FROM chunks WHERE seq % 3 <> 0")
def pinned(chunks):
    """What a reader of the first version sees after the second, a whole replacement from itself and a vacuum of the rest."""
    store, second = _changed(chunks)
    store.replace(chunks=second.table("chunks").withColumn("text", F.upper("text")))
    store.vacuum(3)
    return store.pin(1).table("chunks").select("chunk_id", "text")


def _arrivals(part, nation, region):
    """Batches in order: topics and subtopics, contents in two parts, pairs of contents."""
    spark = part.sparkSession
    fields = [f.name for f in spark.createDataFrame([], ARRIVALS).schema]
    texts = {"summary": "x", "scope": "x", "content_type": "x", "raw_excerpt": "x"}
    blank = spark.createDataFrame([], ARRIVALS)

    def shaped(df):
        return blank.unionByName(df.withColumns({c: F.lit(v) for c, v in texts.items()}), allowMissingColumns=True).select(*fields)

    topics = region.select(F.lit("topic").alias("kind"), F.col("r_regionkey").cast("long").alias("seq"), F.col("r_name").alias("name"))
    subtopics = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.lit("subtopic").alias("kind"), F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("name"), F.expr("array(r_name, 'nowhere')").alias("parents"))
    contents = part.join(nation, part.p_partkey % 25 == nation.n_nationkey).select(
        F.lit("content").alias("kind"), F.col("p_partkey").alias("seq"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        F.expr("CASE WHEN p_partkey % 4 = 0 THEN array('unknown') ELSE array(n_name) END").alias("parents"), F.expr("array('EUROPE')").alias("topic_parents"), F.expr("array('c' || p_partkey)").alias("source_ids"),
    )
    keyed = contents.select("seq", T.make_key("content", "name").alias("src"))
    pairs = keyed.join(keyed.select((F.col("seq") + 25).alias("seq"), F.col("src").alias("dst")), "seq").select(F.lit("related").alias("kind"), "seq", "src", "dst", F.lit("Leads to").alias("label"), F.lit(0.5).alias("confidence"))
    return [shaped(topics).unionByName(shaped(subtopics)), shaped(contents.where("seq % 2 = 0")), shaped(contents.where("seq % 2 = 1")), shaped(pairs)]


@register.add("st1_graph_stream", "part", "nation", "region", oracle=f"""WITH {_CONTENTS}
  SELECT {_TOPIC} AS src, {_SUB} AS dst, 'HAS_SUBTOPIC' AS relation, NULL AS label, NULL AS chunk FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT CASE WHEN p_partkey % 4 = 0 THEN 'topic:' || substr(sha1('europe'), 1, 12) ELSE sub END, key, 'HAS_CONTENT', NULL, 'c' || CAST(p_partkey AS STRING) FROM c
  UNION ALL SELECT a.key, b.key, 'RELATED_TO', 'leads_to', NULL FROM c a JOIN c b ON a.p_partkey = b.p_partkey + 25""")
def graph_from_stream(part, nation, region):
    """The graph that a stream of four batches leaves, each merged into the buckets it touches."""
    spark = part.sparkSession
    root = working_path(spark, "graph")
    for batch in _arrivals(part, nation, region):
        batch.coalesce(1).write.mode("append").parquet(f"{root}/in")
        graph_stream(spark, f"{root}/in", f"{root}/graph", f"{root}/check", 16).awaitTermination()
    edges = GraphStore(spark, f"{root}/graph", 16).pin().table("edges")
    return edges.select("src", "dst", "relation", "label", F.array_join("source_chunk_ids", "|").alias("chunk"))


@register.add("st2_windows", "segments", oracle="""WITH w AS (SELECT source_id, CAST(floor(start / 3600) AS BIGINT) AS slot, string_agg(text, ' ' ORDER BY seq) AS text, arg_max("end", seq) AS end_time FROM segments GROUP BY 1, 2)
  SELECT source_id || '_chunk_' || CAST(row_number() OVER (PARTITION BY source_id ORDER BY slot) - 1 AS STRING) AS chunk_id, source_id, text, CAST(slot * 3600 AS DOUBLE) AS start_time, end_time FROM w""")
def stream_windows(segments):
    """All segments as a stream in three parts by time, then two far later ones of another source that close every window."""
    spark = segments.sparkSession
    root = working_path(spark, "windows")
    rows = segments.select("source_id", F.col("seq").cast("long").alias("seq"), "start", "end", "text").repartition(4)
    low, high = rows.agg(F.min("start"), F.max("start")).head()
    cuts = [low + (high - low) * k / 3 for k in (1, 2)] if low is not None else [0.0, 0.0]
    ends = spark.createDataFrame([("", 0, 4e9, 4e9, ""), ("", 1, 5e9, 5e9, "")], rows.schema)
    first, second = F.col("start") < cuts[0], F.col("start") < cuts[1]
    for batch in (rows.where(first), rows.where(~first & second), rows.where(~second), ends.where("seq = 0"), ends.where("seq = 1")):
        batch.write.mode("append").parquet(f"{root}/in")
        stream = window_chunks_stream(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), 3600.0, "1 hour")
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").where("source_id <> ''")


@register.add("s11_export_nodes", "nodes", oracle="""SELECT key, coalesce(CASE WHEN seq % 4 > 0 THEN name END, key) AS name, coalesce(CASE WHEN seq % 5 > 0 THEN node_type END, 'content') AS node_type, CASE WHEN seq % 2 = 0 THEN summary ELSE '' END AS summary,
  CASE WHEN seq % 3 = 0 THEN 'c' || CAST(vec AS STRING) ELSE '' END AS sources, CASE WHEN seq % 3 = 0 THEN name END AS excerpt FROM nodes WHERE seq % 7 > 0""")
def export_nodes(nodes):
    """Nodes with their details, written as JSON lines and read back."""
    spark = nodes.sparkSession
    marked = nodes.where("key IS NOT NULL").select(
        "key", F.expr("CASE WHEN seq % 4 > 0 THEN name END").alias("name"), F.expr("CASE WHEN seq % 7 = 0 THEN 'chunk_ref' WHEN seq % 5 > 0 THEN node_type END").alias("node_type"), F.expr("CASE WHEN seq % 2 = 0 THEN summary END").alias("summary"),
        F.expr("CASE WHEN seq % 3 = 0 THEN array('c' || vec) END").alias("source_ids"), F.expr("CASE WHEN seq % 3 = 0 THEN name END").alias("raw_excerpt"),
    )
    edges = spark.createDataFrame([], "src string, dst string, relation string, label string, confidence double")
    path = working_path(spark, "export")
    write_export(marked, edges, path)
    read = spark.read.schema("key string, name string, node_type string, summary string, source_ids array<string>, raw_excerpt string").json(f"{path}/nodes")
    return read.select("key", "name", "node_type", "summary", F.array_join("source_ids", "|").alias("sources"), F.col("raw_excerpt").alias("excerpt"))
