"""Queries of bundles, batches of edits and labelled removals: nodes, edges, warnings and rejections row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import graph_build as B
from quillspan.operators import proposals as P
from quillspan.plans.registered import Register
from quillspan.session import stored

register = Register()

_NAMED = "summary scope content_type raw_excerpt".split()
_EDGE = "src string, dst string, relation string, label string, confidence double, source_chunk_ids array<string>"


def proposed(df, name, *more):
    return df.select(name.alias("name"), *(F.lit("x").alias(c) for c in _NAMED), F.array(F.lit("t")).alias("key_terms"), F.array(F.concat(F.lit("c"), name)).alias("source_ids"), *more)


def bundle(part, nation, region, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> P.GraphResult:
    """Regions, nations and parts as topics, subtopics and contents; nations also nest, and some names stand for nothing."""
    spark = part.sparkSession
    topics = proposed(region, F.col("r_name"), F.col("r_regionkey").cast("long").alias("seq"))
    nested = nation.select(((F.col("n_nationkey") + 20) % 25).alias("child"), F.col("n_name").alias("above"))
    under = nation.join(region, nation.n_regionkey == region.r_regionkey).join(nested, F.col("n_nationkey") == F.col("child"), "left")
    subtopics = proposed(under, F.col("n_name"), F.col("n_nationkey").cast("long").alias("seq"), F.expr("array(r_name, 'nowhere')").alias("parents"), F.expr("array(above, n_name, 'no subtopic')").alias("parent_subtopics"))
    placed = part.join(nation, part.p_partkey % 25 == nation.n_nationkey)
    contents = proposed(
        placed, F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")), F.col("p_partkey").alias("seq"),
        F.expr("CASE WHEN p_partkey % 4 = 0 THEN array('unknown') ELSE array(n_name, 'unknown') END").alias("parents"), F.expr("array('EUROPE', 'no topic')").alias("topic_parents"),
    )
    keyed = contents.select(T.make_key("content", "name").alias("src"), "seq")
    order = Window.partitionBy(F.pmod("seq", F.lit(25))).orderBy("seq")
    related = keyed.select("src", F.coalesce(F.lag("src").over(order), F.lit("content:none")).alias("dst"), F.lit("Leads to").alias("label"), F.lit(0.5).alias("confidence"))
    none = topics.limit(0).withColumn("key", F.lit("")).withColumn("node_type", F.lit(""))
    no_edges = spark.createDataFrame([], _EDGE)
    return P.apply_bundle(none if nodes is None else nodes, no_edges if edges is None else edges, topics, subtopics, contents, related)


def _sql_key(kind: str, name: str) -> str:
    return f"'{kind}:' || substr(sha1(regexp_replace(lower(trim({name})), '\\s+', ' ', 'g')), 1, 12)"


_SUB, _TOPIC, _CONTENT = _sql_key("subtopic", "n_name"), _sql_key("topic", "r_name"), _sql_key("content", "p_name || ' ' || CAST(p_partkey AS STRING)")
_CONTENTS = f"c AS (SELECT {_CONTENT} AS key, p_partkey, {_SUB} AS sub FROM part JOIN nation ON p_partkey % 25 = n_nationkey)"


@register.add("g6_apply_bundle", "part", "nation", "region", oracle=f"""WITH {_CONTENTS}, s AS (SELECT {_SUB} AS key, n_nationkey, {_TOPIC} AS topic FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT topic AS src, key AS dst, 'HAS_SUBTOPIC' AS relation, NULL AS label, NULL AS confidence, NULL AS chunks FROM s
  UNION ALL SELECT a.key, b.key, 'HAS_SUBTOPIC', NULL, NULL, NULL FROM s a JOIN s b ON (a.n_nationkey + 20) % 25 = b.n_nationkey
  UNION ALL SELECT CASE WHEN p_partkey % 4 = 0 THEN {_sql_key("topic", "'EUROPE'")} ELSE sub END, key, 'HAS_CONTENT', NULL, NULL, 1 FROM c
  UNION ALL SELECT key, before, 'RELATED_TO', 'leads_to', 0.5, NULL FROM (SELECT key, lag(key) OVER (PARTITION BY p_partkey % 25 ORDER BY p_partkey) AS before FROM c) WHERE before IS NOT NULL""")
def apply_bundle(part, nation, region):
    return bundle(part, nation, region).edges.select("src", "dst", "relation", "label", "confidence", F.size(F.nullif("source_chunk_ids", F.array().cast("array<string>"))).alias("n")).select("src", "dst", "relation", "label", "confidence", F.when(F.col("n") > 0, F.col("n")).alias("chunks"))


@register.add("g6_bundle_nodes", "part", "nation", "region", oracle=f"""WITH {_CONTENTS}
  SELECT {_TOPIC} AS key, r_name AS name, 'topic' AS node_type, NULL AS parents FROM region
  UNION ALL SELECT {_SUB}, n_name, 'subtopic', {_TOPIC} FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT key, p_name || ' ' || CAST(p_partkey AS STRING), 'content', CASE WHEN p_partkey % 4 <> 0 THEN sub END FROM c JOIN part USING (p_partkey)""")
def bundle_nodes(part, nation, region):
    return bundle(part, nation, region).nodes.select("key", "name", "node_type", F.array_join("parents", "|").alias("parents"))


@register.add("g6_bundle_warnings", "part", "nation", "region", oracle=f"""WITH {_CONTENTS}
  SELECT CAST(n_nationkey AS BIGINT) AS seq, 'nowhere' AS src, {_SUB} AS dst, 'unknown topic' AS reason FROM nation
  UNION ALL SELECT p_partkey, 'unknown', key, 'unknown subtopic' FROM c
  UNION ALL SELECT NULL, key, 'content:none', 'missing end' FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_partkey) = 1""")
def bundle_warnings(part, nation, region):
    return bundle(part, nation, region).warnings


@register.add("g6_bundle_counters", "part", "nation", "region", oracle="""SELECT kind || 's ' || what AS what, CASE WHEN what = 'added' THEN 0 ELSE n END AS n
  FROM (SELECT 'topic' AS kind, count(*) AS n FROM region UNION ALL SELECT 'subtopic', count(*) FROM nation UNION ALL SELECT 'content', count(*) FROM part), (VALUES ('added'), ('merged')) w(what)
  UNION ALL SELECT 'structural edges added', 0""")
def bundle_counters(part, nation, region):
    """The same bundle twice: all is merged, nothing added."""
    once = bundle(part, nation, region)
    return bundle(part, nation, region, stored(once.nodes), stored(once.edges)).counters


@register.add("g7_remove_labelled", "related", oracle="""WITH r AS (SELECT *, regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g') AS form FROM related)
  SELECT src, dst, label, seq FROM r QUALIFY NOT (seq = min(seq) OVER (PARTITION BY src, dst, form) AND contains(label, 'BRUSHED'))""")
def remove_labelled(related):
    """Of parallel edges the first of each label goes whose label is asked for, spelt in another way."""
    edges = related.withColumn("relation", F.lit("RELATED_TO"))
    gone = edges.where("contains(label, 'BRUSHED')").select("src", "dst", "relation", F.concat(F.lit(" "), F.lower("label"), F.lit("!")).alias("label"))
    return B.remove_edges(edges, gone).select("src", "dst", "label", "seq")


@register.add("g4_alien_relations", "tree", "nodes", oracle="SELECT src, dst, 'not a structural relation' AS reason FROM tree WHERE relation = 'HAS_CONTENT' AND seq % 3 = 0")
def alien_relations(tree, nodes):
    wanted = tree.withColumn("relation", F.when((F.col("relation") == "HAS_CONTENT") & (F.col("seq") % 3 == 0), "EVIDENCE_OF").otherwise(F.col("relation")))
    return B.structural_edges(wanted.withColumn("source_chunk_ids", F.array(F.lit("c"))), nodes)[1]


def _batch(nodes, tree, part, nation) -> B.EditResult:
    """Nations make subtopics, parts contents below them; several parts make one content; edges repeat and point at what the batch made."""
    edges = tree.select("src", "dst", "relation", F.lit(None).cast("string").alias("label"))
    subtopics = nation.select(F.col("n_nationkey").cast("long").alias("seq"), F.lit("subtopic").alias("node_type"), F.concat(F.lit(" "), "n_name").alias("name"), F.lit(None).cast("string").alias("content_type"), F.expr("CASE WHEN n_nationkey % 5 < 4 THEN array('topic:' || n_regionkey) ELSE array('topic:none') END").alias("parents"))
    names = nation.select(F.col("n_nationkey").alias("at"), T.make_key("subtopic", "n_name").alias("parent"))
    contents = part.join(names, (F.col("p_partkey") + F.expr("p_partkey DIV 50")) % 25 == F.col("at")).select(
        (F.col("p_partkey") + 100).cast("long").alias("seq"), F.lit("content").alias("node_type"), F.expr("CASE WHEN p_partkey % 50 = 49 THEN '  ' ELSE 'c' || (p_partkey % 50) END").alias("name"),
        F.expr("CASE WHEN p_partkey % 50 = 48 THEN 'poem' END").alias("content_type"), F.array("parent").alias("parents"),
    )
    seq = F.lit(10_000_000) + F.col("seq") * 4
    fresh = tree.select(seq.cast("long").alias("seq"), "src", "dst", F.lit("related_to").alias("relation"), F.lit("Fine").alias("label"))
    again = tree.select((seq + 1).cast("long").alias("seq"), "src", "dst", F.lit("RELATED_TO").alias("relation"), F.lit("fine!").alias("label"))
    known = tree.select((seq + 2).cast("long").alias("seq"), "src", "dst", F.expr("CASE WHEN seq % 2 = 0 THEN relation ELSE 'EVIDENCE_OF' END").alias("relation"), F.lit(None).cast("string").alias("label"))
    made = nation.select(F.col("n_nationkey").cast("long").alias("n"), T.make_key("subtopic", "n_name").alias("src"))
    to_made = made.select((F.col("n") * 2 - 50).alias("seq"), "src", F.lit("topic:0").alias("dst"), F.lit("RELATED_TO").alias("relation"), F.lit("x").alias("label")).unionByName(
        made.select((F.col("n") * 2 + 9_000_000).alias("seq"), "src", F.lit("topic:0").alias("dst"), F.lit("RELATED_TO").alias("relation"), F.lit("x").alias("label"))
    )
    return B.apply_batch(nodes, edges, subtopics.unionByName(contents), fresh.unionByName(again).unionByName(known).unionByName(to_made))


_G22 = f"""WITH n AS (SELECT n_nationkey, {_SUB} AS key, n_nationkey % 5 < 4 AS good FROM nation),
  p AS (SELECT p_partkey, p_partkey % 50 AS slot, good, n.key AS parent FROM part JOIN n ON (p_partkey + p_partkey // 50) % 25 = n_nationkey),
  f AS (SELECT *, min(p_partkey) FILTER (WHERE good) OVER (PARTITION BY slot) AS first_ok FROM p)"""


@register.add("g22_batch", "nodes", "tree", "part", "nation", oracle=f"""{_G22}
  SELECT CAST(n_nationkey AS BIGINT) AS seq, 'missing parent' AS reason FROM n WHERE NOT good
  UNION ALL SELECT p_partkey + 100, CASE WHEN slot = 49 THEN 'empty name' WHEN slot = 48 THEN 'unknown content type' WHEN p_partkey > first_ok THEN 'conflict' ELSE 'missing parent' END FROM f WHERE slot >= 48 OR first_ok IS NULL OR p_partkey <> first_ok
  UNION ALL SELECT 10000001 + seq * 4, 'conflict' FROM tree
  UNION ALL SELECT 10000002 + seq * 4, CASE WHEN seq % 2 = 0 THEN 'conflict' ELSE 'unknown relation' END FROM tree
  UNION ALL SELECT n_nationkey * 2 - 50, 'missing source' FROM n
  UNION ALL SELECT n_nationkey * 2 + 9000000, 'missing source' FROM n WHERE NOT good""")
def batch_rejected(nodes, tree, part, nation):
    return _batch(nodes, tree, part, nation).rejected


@register.add("g22_batch_edges", "nodes", "tree", "part", "nation", oracle=f"""{_G22}
  SELECT src, dst, relation, NULL AS label FROM tree UNION ALL SELECT src, dst, 'RELATED_TO', 'fine' FROM tree
  UNION ALL SELECT 'topic:' || CAST(n_regionkey AS STRING), {_SUB}, 'HAS_SUBTOPIC', NULL FROM nation WHERE n_nationkey % 5 < 4
  UNION ALL SELECT parent, {_sql_key("content", "'c' || CAST(slot AS STRING)")}, 'HAS_CONTENT', NULL FROM f WHERE slot < 48 AND p_partkey = first_ok
  UNION ALL SELECT key, 'topic:0', 'RELATED_TO', 'x' FROM n WHERE good""")
def batch_edges(nodes, tree, part, nation):
    return _batch(nodes, tree, part, nation).edges
