"""Traversal of the concept graph, for all queries at once."""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import strip
from quillspan.operators.chunking import cosine
from quillspan.operators.graph_build import STRUCTURAL
from quillspan.operators.similarity import topk, topk_of_classes, topk_within, vector_classes
from quillspan.session import stored

#: Characters by which names and terms are looked up in texts.
GRAM = 6
#: A node whose neighbours have more different vectors is a hub, whose queries meet them in tasks of its own; and tasks among which a kind's nodes are dealt.
HUB, SALTS = 512, 64
#: Rows that a task of scope_topics makes, about.
ROWS_OF_TASK = 4 << 20
#: Pairs of a query and a different vector beyond which a node has tasks of its own too; nodes at which queries are that go to all tasks, at most.
PAIRS_AT_NODE, KEYS_TO_ALL = 1 << 18, 1 << 19


def closure(edges: DataFrame, roots: DataFrame, direction: str = "down", relations: tuple[str, ...] = STRUCTURAL, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) of all nodes below (or above) each of roots (root), at their least depth; cycles end.

    Steps are made distinct once for all depths. Each depth's rows are stored, those that lead further are known, and only whether
    there are any comes to the driver. Nodes deeper than max_depth, where it is given, are an error.
    """
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    steps = stored(edges.where(F.col("relation").isin(*relations)).select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    inner = steps.select(F.col("node").alias("next"), F.lit(True).alias("inner")).distinct()
    steps = stored(steps.join(inner, "next", "left").select("node", "next", F.coalesce("inner", F.lit(False)).alias("inner")))
    frontier = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(True).alias("inner")).distinct()
    seen = frontier = stored(frontier)
    for depth in count(1):
        reached = frontier.where("inner").join(steps.withColumnRenamed("inner", "further"), "node").select("root", F.col("next").alias("node"), F.lit(depth).alias("depth"), F.col("further").alias("inner")).distinct()
        frontier = stored(reached.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"nodes deeper than {max_depth}")
        seen = seen.unionByName(frontier)
        if frontier.where("inner").isEmpty():
            break
    return seen.where("depth > 0").select("root", "node", "depth")


def scope_topics(queries: DataFrame, nodes: DataFrame, edges: DataFrame, second_min: float = 0.25) -> DataFrame:
    """(query_id, node): what lies below a query's best topic, and below the second if that scores above second_min.

    A query without rows has nothing below its topics, and all nodes are open to it. The best topics come from topk, and
    only what is below those is looked up. The result is as large as the queries' scopes together, and is made by one join, in which a node
    stands once for all queries; `scopes` gives the same apart.
    """
    assigned, kinds, members = scopes(queries, nodes, edges, second_min)
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    asked = stored(assigned.join(kinds, "scope").select("kind", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).alias("part"), "query_id").groupBy("kind", "part").agg(F.collect_list("query_id").alias("askers")))
    met = asked.groupBy("kind").agg(F.sum(F.size("askers")).alias("m")).join(members.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind")
    rows = met.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    # small tables that meet as many rows: the number of tasks is that of the rows to come
    dealt = members.withColumn("salt", salt).repartition(max(1, -(-rows // ROWS_OF_TASK)), "kind", "salt")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(asked, ["kind", "salt"]).select("node", F.explode("askers").alias("query_id")).select("query_id", "node")


class Scopes(NamedTuple):
    """What is open to queries: the scope of each (query_id, scope), the kinds of nodes in each scope (scope, kind) and the nodes of each kind (kind, node), distinct.

    A node is in one of a scope's kinds at most.
    """

    assigned: DataFrame
    kinds: DataFrame
    members: DataFrame


def scopes(queries: DataFrame, nodes: DataFrame, edges: DataFrame, second_min: float = 0.25) -> Scopes:
    """As scope_topics, with one scope for all queries of the same topics. Nodes below the same topics are of one kind, so that they are repeated neither for queries nor for scopes."""
    topics = nodes.where("node_type = 'topic'").select(F.col("key").alias("id"), "embedding")
    best = topk(topics, queries.select("query_id", "embedding"), 2)
    chosen = best.where((F.col("rank") == 1) | (F.col("score") > second_min)).groupBy("query_id").agg(F.sort_array(F.collect_set("id")).alias("roots"))
    chosen = stored(chosen.select("query_id", "roots", F.to_json("roots").alias("scope")))
    of_scope = chosen.select("scope", F.explode("roots").alias("root")).distinct()
    below = closure(edges, of_scope.select("root").distinct())
    members = stored(below.groupBy("node").agg(F.to_json(F.sort_array(F.collect_set("root"))).alias("kind")))
    of_kind = members.select("kind").distinct().select("kind", F.explode(F.from_json("kind", "array<string>")).alias("root"))
    return Scopes(chosen.select("query_id", "scope"), stored(of_scope.join(of_kind, "root").select("scope", "kind").distinct()), members.select("kind", "node"))


def term_hits(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node) of nodes (key, name, key_terms) whose name or any key term stands in a query's text, without regard to case.

    Names and terms are found by their first GRAM characters among those substrings of the texts that are as long; only
    what meets so is searched whole. Blank names, blank terms and null texts hit nothing.
    """
    terms = F.transform(F.coalesce("key_terms", F.array().cast("array<string>")), lambda t: F.lower(strip(t)))
    needles = nodes.select(F.col("key").alias("node"), F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), terms))).alias("needle")).where("needle <> ''")
    needles = stored(needles.withColumn("gram", F.substring("needle", 1, GRAM)))
    # substrings are made of those lengths alone that are looked up, GRAM at most
    lengths = ", ".join(str(r["n"]) for r in needles.select(F.length("gram").alias("n")).distinct().collect()) or "1"
    asked = queries.select("query_id", F.lower("text").alias("question")).where("question <> ''")
    windows = f"flatten(transform(array({lengths}), n -> transform(sequence(1, greatest(length(question) - n + 1, 1)), i -> substring(question, i, n))))"
    grams = asked.select("query_id", F.explode(F.array_distinct(F.expr(windows))).alias("gram"))
    met = grams.join(needles, "gram").select("query_id", "node", "needle").join(asked, "query_id")
    return met.where(F.contains("question", F.col("needle"))).select("query_id", "node").distinct()


def anchors(queries: DataFrame, nodes: DataFrame, pool: DataFrame | Scopes | None = None, k: int = 3, boost: float = 0.15) -> DataFrame:
    """(query_id, node, rank): k nodes of a query (query_id, text, embedding) where its walk begins.

    Nodes of the pool (query_id, node; all nodes for queries without rows there) that the query names, or a key term of
    which it holds, come first in order of seq; the rest follow by score. Nodes outside the pool count only where it has
    fewer than k, with `boost` for a hit. A pool may be given as Scopes. Queries and nodes meet by terms and by topk, of all or of
    a scope, where equal vectors count as one; never all with all.
    """
    asked = queries.select("query_id", F.col("embedding").alias("query_embedding"))
    vectors = nodes.select(F.col("key").alias("node"), "seq", "embedding")
    classed, classes = vector_classes(nodes.select(F.col("key").alias("id"), "embedding"))
    nearest = lambda some, n: topk_of_classes(classed, classes, some.select("query_id", "embedding"), n).select("query_id", F.col("id").alias("node"))
    hits = stored(term_hits(queries, nodes).withColumn("hit", F.lit(True)))
    scored = lambda rows: rows.join(vectors, "node").join(asked, "query_id").select("query_id", "node", "seq", "inside", cosine(F.col("embedding"), F.col("query_embedding")).alias("score"))
    # hits among the 2 k highest are no loss: k of them, or k others, are left
    if pool is None:
        rows = nearest(queries, 2 * k).withColumn("inside", F.lit(True))
    else:
        if isinstance(pool, DataFrame):
            asking = pool.select("query_id").distinct()
            pool = Scopes(asking.select("query_id", F.col("query_id").alias("scope")), asking.select(F.col("query_id").alias("scope"), F.col("query_id").alias("kind")), pool.select(F.col("query_id").alias("kind"), "node").distinct())
        assigned, kinds = pool.assigned, pool.kinds
        members = pool.members.join(vectors.select("node"), "node", "left_semi")
        held = kinds.join(members.groupBy("kind").agg(F.count(F.lit(1)).alias("held")), "kind").groupBy("scope").agg(F.sum("held").alias("size"))
        sizes = stored(queries.select("query_id").join(assigned, "query_id", "left").join(held, "scope", "left").select("query_id", "size"))
        # of the rows (query_id, node) those whose node is in the query's scope
        open_to = lambda rows: rows.join(members, "node").join(kinds, "kind").join(assigned, ["query_id", "scope"]).select("query_id", "node").distinct()
        free, short = (queries.join(sizes.where(c), "query_id", "left_semi") for c in ("size IS NULL", f"size < {k}"))
        # of a kind's equal vectors the first are enough for any scope that has it
        turn = F.row_number().over(Window.partitionBy("kind", "cls").orderBy("node"))
        first = members.join(classed.withColumnRenamed("id", "node"), "node").withColumn("turn", turn).where(F.col("turn") <= 2 * k)
        inside = stored(first.join(kinds, "kind").select(F.col("scope").alias("group"), F.col("node").alias("id"), "cls"))
        own = topk_within(inside, classes, queries.join(assigned.withColumnRenamed("scope", "group"), "query_id"), 2 * k).select("query_id", F.col("id").alias("node"), F.lit(True).alias("inside"))
        named = open_to(hits.select("query_id", "node")).withColumn("inside", F.lit(True))
        outside = nearest(short, 3 * k).union(hits.select("query_id", "node").join(short.select("query_id"), "query_id", "left_semi"))
        outside = stored(outside.distinct())
        outside = outside.join(open_to(outside), ["query_id", "node"], "left_anti").withColumn("inside", F.lit(False))
        every = nearest(free, 2 * k).withColumn("inside", F.lit(True))
        named = named.unionByName(hits.join(free.select("query_id"), "query_id", "left_semi").select("query_id", "node", F.lit(True).alias("inside")))
        rows = own.unionByName(named).unionByName(outside).unionByName(every)
    if pool is None:
        rows = rows.unionByName(hits.select("query_id", "node", F.lit(True).alias("inside")))
    found = scored(rows.distinct()).join(hits, ["query_id", "node"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    first = F.col("inside") & F.col("hit")
    weight = F.col("score") + F.when(F.col("hit") & ~F.col("inside"), F.lit(boost)).otherwise(0.0)
    order = [F.desc(first), F.when(first, F.col("seq")), F.desc(F.round(weight, 9)), F.col("node")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "node", "rank")


def retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 3, second_min: float = 0.25, max_hops: int = 3, threshold: float = 0.4, max_per_hop: int = 10, boost: float = 0.15) -> GraphEvidence:
    """Graph evidence of all queries (query_id, text, embedding): anchors, the walk from them, its triples and its nodes' chunks.

    Chunks are ranked by hop, then by rank within it, then by id. A graph without nodes, and a query without anchors,
    give nothing.
    """
    shown = nodes.where("node_type <> 'chunk_ref'")
    starts = stored(anchors(queries, shown, scopes(queries, shown, edges, second_min), k, boost))
    reached, walked = walk(queries, starts, shown, edges, max_hops, threshold, max_per_hop)
    sourced = reached.join(shown.select(F.col("key").alias("node"), F.explode("source_ids").alias("chunk_id")), "node")
    first = sourced.groupBy("query_id", "chunk_id").agg(F.min(F.struct("hop", "rank")).alias("at"))
    chunks = first.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id")).alias("rank"))
    return GraphEvidence(starts, reached, triples(walked, shown), chunks)


class GraphEvidence(NamedTuple):
    anchors: DataFrame
    nodes: DataFrame
    triples: DataFrame
    chunks: DataFrame


def walk(queries: DataFrame, starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 3, threshold: float = 0.4, max_per_hop: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes: query_id, node, hop, rank, score; edges: query_id, src, dst, relation, label) reached from starts (query_id, node).

    Each hop looks at all neighbours of the last hop's nodes, either way, that weren't reached yet, and accepts those
    of the highest score, at most max_per_hop and none below threshold. All edges between the last hop's nodes and the
    accepted ones are kept, parallel ones too; they are looked up when they are read.

    Nodes are numbered in order of their keys, and neighbours are stored as pairs of numbers. Of a node's neighbours only those that may be
    accepted come to its queries: the max_per_hop nearest and as many more as a query may have reached before, found by
    topk_within for all queries at the node together.
    """
    linked = edges.where("relation <> 'EVIDENCE_OF'").select("src", "dst", "relation", "label")
    shown = nodes.where("node_type <> 'chunk_ref'").select("key", "embedding")
    known = shown.select("key").unionByName(starts.select(F.col("node").alias("key"))).where("key IS NOT NULL").distinct()
    # numbers grow from range to range and within each
    keys = stored(known.repartitionByRange("key").sortWithinPartitions("key").select("key", F.monotonically_increasing_id().alias("ix")))
    end = lambda key, ix: keys.select(F.col("key").alias(key), F.col("ix").alias(ix))
    classed, classes = vector_classes(shown.join(keys, "key").select(F.col("ix").alias("id"), "embedding"))
    ends = linked.where("src <> dst").select("src", "dst").join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    ends = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ways = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next"))))
    adjacent = stored(ends.select(ways.alias("x")).select("x.node", "x.next").join(classed.withColumnRenamed("id", "next"), "next").select("node", "next", "cls"))
    frontier = stored(starts.select("query_id", "node").distinct().join(end("node", "ix"), "node").select("query_id", F.col("ix").alias("node")))
    most = frontier.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    reached = frontier.select("query_id", "node", F.lit(0).alias("hop"), F.row_number().over(Window.partitionBy("query_id").orderBy("node")).alias("rank"), F.lit(None).cast("double").alias("score"))
    by_key = lambda rows, column: rows.withColumnRenamed(column, "ix").join(keys, "ix").withColumnRenamed("key", column).drop("ix")
    kept_edges = None
    for hop in range(1, max_hops + 1):
        at = _few(frontier.select("node").distinct())
        around = adjacent.join(at, "node", "left_semi").select(F.col("node").alias("group"), F.col("next").alias("id"), "cls")
        waiting = frontier.join(queries.select("query_id", "embedding"), "query_id").withColumnRenamed("node", "group")
        near = topk_within(around, classes, waiting, max_per_hop + most, HUB, PAIRS_AT_NODE, threshold)
        most += max_per_hop
        # a neighbour of several nodes is one, whatever the last digits of its scores
        fresh = near.groupBy("query_id", F.col("id").alias("next")).agg(F.max("score").alias("score")).join(reached.select("query_id", F.col("node").alias("next")), ["query_id", "next"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "next"))
        accepted = stored(fresh.withColumn("rank", rank).where((F.col("rank") <= max_per_hop) & (F.col("score") >= threshold)))
        if accepted.isEmpty():
            break
        # a hop's nodes are new, so no pair has both its ends among the last hop's
        pairs = by_key(frontier, "node").withColumnRenamed("node", "a").join(by_key(accepted.select("query_id", F.col("next").alias("b")), "b"), "query_id")
        pairs = pairs.select("query_id", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("x"))
        own = pairs.select("query_id", "x.src", "x.dst").join(linked, ["src", "dst"]).select("query_id", "src", "dst", "relation", "label", F.lit(hop).alias("hop"))
        kept_edges = own if kept_edges is None else kept_edges.unionByName(own)
        reached = reached.unionByName(accepted.select("query_id", F.col("next").alias("node"), F.lit(hop).alias("hop"), "rank", "score"))
        frontier = accepted.select("query_id", F.col("next").alias("node"))
    if kept_edges is None:
        kept_edges = starts.limit(0).select("query_id", *(F.lit(None).cast("string").alias(c) for c in ("src", "dst", "relation", "label")), F.lit(0).alias("hop"))
    return by_key(reached, "node").select("query_id", "node", "hop", "rank", "score"), kept_edges


def _few(rows: DataFrame) -> DataFrame:
    """`rows` stored, and marked to go to all tasks if they are no more than KEYS_TO_ALL."""
    rows = stored(rows)
    return F.broadcast(rows) if rows.count() <= KEYS_TO_ALL else rows


def triples(walk_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, head, relation, tail) by the nodes' names, in the edges' own direction; the label of semantic edges."""
    names = nodes.select("key", "name")
    return (
        walk_edges.join(names.select(F.col("key").alias("src"), F.col("name").alias("head")), "src")
        .join(names.select(F.col("key").alias("dst"), F.col("name").alias("tail")), "dst")
        .select("query_id", "head", F.when(F.col("relation") == "RELATED_TO", F.coalesce("label", "relation")).otherwise(F.col("relation")).alias("relation"), "tail")
    )


def node_chunks(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of all sources of the nodes reached."""
    return reached.join(nodes.select(F.col("key").alias("node"), F.explode("source_ids").alias("chunk_id")), "node").select("query_id", "chunk_id").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, component): the smallest key that is connected with each node, whatever the edges' direction.

    Each turn every key takes the smallest key among its neighbours and itself, then that one's, and the edges are drawn
    between what was taken: edges inside a component vanish, and only different ones stay for the next turn. Edges to keys
    that aren't nodes connect nothing.
    """
    keys = stored(nodes.select("key").where("key IS NOT NULL").distinct())
    known = lambda rows, end: rows.join(keys.withColumnRenamed("key", end), end, "left_semi")
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    links, labels = stored(known(known(ends, "a"), "b")), nodes.select("key", F.col("key").alias("component"))
    while not links.isEmpty():
        both = links.select(F.col("a").alias("old"), F.col("a").alias("new")).unionAll(links.select(F.col("b").alias("old"), F.col("a").alias("new")))
        nearest = stored(both.groupBy("old").agg(F.min("new").alias("new")))
        jump = nearest.select(F.col("old").alias("new"), F.col("new").alias("newer"))
        taken = stored(nearest.join(jump, "new").select("old", F.col("newer").alias("new")))
        moved = lambda rows, end: rows.join(taken.withColumnRenamed("old", end), end).drop(end).withColumnRenamed("new", end)  # noqa: E731,B023
        ends = moved(moved(links, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = stored(ends)
        labels = stored(labels.join(taken.select(F.col("old").alias("component"), "new"), "component", "left").select("key", F.coalesce("new", "component").alias("component")))
    return labels


def collapse(nodes: DataFrame, edges: DataFrame, collapsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes shown, hidden counts (root, hidden)): below collapsed topics (key) nothing shows that no open topic reaches; topics always show."""
    topics = nodes.where("node_type = 'topic'").select(F.col("key").alias("root"))
    closed = topics.join(collapsed.select(F.col("key").alias("root")).distinct(), "root", "left_semi")
    below = closure(edges, topics)
    open_nodes = below.join(closed, "root", "left_anti").select("node").distinct()
    hidden = below.join(closed, "root", "left_semi").join(open_nodes, "node", "left_anti").join(topics.withColumnRenamed("root", "node"), "node", "left_anti")
    shown = nodes.join(hidden.select(F.col("node").alias("key")).distinct(), "key", "left_anti")
    counts = hidden.groupBy("root").agg(F.countDistinct("node").alias("hidden"))
    return shown, closed.join(counts, "root", "left").select("root", F.coalesce("hidden", F.lit(0)).alias("hidden"))


def knowledge_gaps(wrong: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic, wrong): how many of the wrong answers (question_id, source_node_keys) lie below each topic."""
    starts = wrong.select("question_id", F.explode("source_node_keys").alias("root")).distinct()
    topics = nodes.where("node_type = 'topic'").select(F.col("key").alias("node"), F.col("name").alias("topic"))
    up = closure(edges, starts.select("root").distinct(), "up").select("root", "node").unionByName(starts.select("root", F.col("root").alias("node")).distinct())
    return starts.join(up, "root").join(topics, "node").select("question_id", "topic").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("wrong"))


def neighbours(nodes: DataFrame, edges: DataFrame, starts: DataFrame, n: int = 5) -> DataFrame:
    """(key, neighbour, rank): the first n distinct names beside each of starts (key), successors before predecessors, by seq."""
    names = nodes.select("key", "name")
    both = edges.select(F.col("src").alias("key"), F.col("dst").alias("other"), F.lit(0).alias("way"), "seq").unionAll(edges.select(F.col("dst").alias("key"), F.col("src").alias("other"), F.lit(1).alias("way"), "seq"))
    named = both.join(starts.select("key").distinct(), "key", "left_semi").join(names.select(F.col("key").alias("other"), F.col("name").alias("neighbour")), "other")
    first = named.groupBy("key", "neighbour").agg(F.min(F.struct("way", "seq")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("at", "neighbour"))).where(F.col("rank") <= n).select("key", "neighbour", "rank")


def highlight(nodes: DataFrame, edges: DataFrame, hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes among hops (key), and edges both of whose ends are."""
    keys = hops.select("key").distinct()
    return nodes.join(keys, "key", "left_semi"), edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
