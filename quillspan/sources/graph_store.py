"""The concept graph as committed versions, grown by bundles of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import make_key
from quillspan.operators import proposals as P
from quillspan.session import stored
from quillspan.sources.versions import Snapshot, Versions

NODES = (
    "key string, node_type string, name string, summary string, scope string, content_type string, raw_excerpt string, key_terms array<string>, source_ids array<string>, seq long, "
    "illustration struct<kind:string,hint:string>, illustration_path string, parents array<string>, origin string, created_at timestamp, updated_at timestamp"
)
EDGES = "src string, dst string, relation string, label string, confidence double, source_chunk_ids array<string>"
WARNINGS = "batch long, seq long, src string, dst string, reason string"

#: What arrives: a proposal for a topic, subtopic or content, or a related pair, by `kind`.
ARRIVALS = (
    "kind string, seq long, name string, summary string, scope string, content_type string, raw_excerpt string, key_terms array<string>, source_ids array<string>, "
    "parents array<string>, parent_subtopics array<string>, topic_parents array<string>, src string, dst string, label string, confidence double"
)
_KINDS = ("topic", "subtopic", "content")


class GraphStore:
    """Nodes by key, edges by source and warnings by batch, in hash buckets; all three change in one commit."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.versions = Versions(spark, root, {"nodes": ("key", NODES), "edges": ("src", EDGES), "warnings": ("batch", WARNINGS)}, buckets)

    def pin(self, version: int | None = None) -> Snapshot:
        return self.versions.pin(version)

    def apply(self, arrivals: DataFrame, batch: int, writer: str = "ingest", at: Column | None = None) -> Snapshot:
        """The graph with the proposals of a batch (ARRIVALS) merged in, as apply_bundle does; a batch that is committed changes nothing.

        Read are the buckets of nodes that the batch proposes or names and those of edges that start at them; written are
        those of nodes proposed and edges made. What names stand for is looked up in the graph as it is and in the batch,
        so a name whose node comes in a later batch is a warning.
        """
        base = self.pin()
        if batch <= base.done(writer):
            return base
        arrivals = stored(arrivals)
        tiers = {k: arrivals.where(F.col("kind") == k) for k in _KINDS}
        related = arrivals.where("kind = 'related'").select("src", "dst", "label", "confidence", F.col("source_ids").alias("source_chunk_ids"), "seq")
        keyed = {k: t.withColumn("key", make_key(k, "name")).where("key IS NOT NULL") for k, t in tiers.items()}
        proposed = keyed["topic"].select("key").union(keyed["subtopic"].select("key")).union(keyed["content"].select("key"))
        named = P.parent_references(keyed["subtopic"], keyed["content"]).select(F.col("parent").alias("key")).where("key IS NOT NULL")
        named = named.union(related.select("src")).union(related.select("dst"))
        own = self.versions.touched(proposed, "key")
        nodes = base.table("nodes", sorted({*own, *self.versions.touched(named, "key")}))
        # edges start at what is named as a parent or as the source of a pair
        starts = self.versions.touched(named, "key")
        grown = P.apply_bundle(nodes, base.table("edges", starts), tiers["topic"], tiers["subtopic"], tiers["content"], related, at)
        mine = F.pmod(F.xxhash64("key"), F.lit(self.versions.buckets)).isin(*own) if own else F.lit(False)
        fields = lambda ddl: [f.name for f in arrivals.sparkSession.createDataFrame([], ddl).schema]
        have = grown.nodes.columns
        kept = grown.nodes.where(mine).select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in fields(NODES) if c != "illustration"), (F.col("illustration") if "illustration" in have else F.lit(None).cast("struct<kind:string,hint:string>")).alias("illustration"))
        said = stored(grown.warnings.select(F.lit(batch).cast("long").alias("batch"), "seq", "src", "dst", "reason"))
        own_warnings = self.versions.touched(said, "batch")
        changes = {
            "nodes": (own, self.versions.write("nodes", kept.select(*fields(NODES)))),
            "edges": (starts, self.versions.write("edges", grown.edges.select(*fields(EDGES)))),
            "warnings": (own_warnings, self.versions.write("warnings", base.table("warnings", own_warnings).unionByName(said))),
        }
        return self.versions.commit(base, changes, writer, batch)
