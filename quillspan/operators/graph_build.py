"""Building, merging, pruning and editing the concept graph: nodes (key, ...) and edges (src, dst, relation, label, ...)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import make_key, norm_label, strip
from quillspan.session import stored

STRUCTURAL = ("HAS_SUBTOPIC", "HAS_CONTENT")


#: Elements of a group's different lists that are put in order in one row, at most.
ELEMENTS_AT_ONCE = 10_000


def ordered_union(rows: DataFrame, by: list[str], list_col: str, seq: str = "seq", fold_case: bool = False) -> DataFrame:
    """by..., list_col: the distinct elements of all lists of a group, in order of first sight; with fold_case the first spelling stays.

    Equal lists of a group are one before anything is gathered. Lists of groups with more than ELEMENTS_AT_ONCE elements are taken
    apart and made distinct before they are gathered, so a group of many rows costs as many as it has elements.
    """
    if fold_case:
        return _taken_apart(rows, by, list_col, seq, fold_case)
    # a null seq comes first
    first = F.when(F.count(seq) == F.count(F.lit(1)), F.min(seq)).alias(seq)
    lists = stored(rows.where(F.size(list_col) > 0).groupBy(*by, list_col).agg(first))
    large = stored(lists.groupBy(*by).agg(F.sum(F.size(list_col)).alias("_n")).where(F.col("_n") > ELEMENTS_AT_ONCE).drop("_n"))
    none = large.isEmpty()
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}"))
    small = lists if none else lists.alias("s").join(large.alias("l"), same, "left_anti")
    entries = F.flatten(F.transform("all", lambda x: F.transform(x[list_col], lambda item, pos: F.struct(x[seq].alias("seq"), pos.alias("pos"), item.alias("item")))))
    items = F.array_distinct(F.transform(F.sort_array(F.filter(entries, lambda x: x["item"].isNotNull())), lambda x: x["item"]))
    found = small.groupBy(*by).agg(F.collect_list(F.struct(seq, list_col)).alias("all")).select(*by, items.alias(list_col)).where(F.size(list_col) > 0)
    return found if none else found.unionByName(_taken_apart(lists.alias("s").join(large.alias("l"), same, "left_semi"), by, list_col, seq, False))


def _taken_apart(rows: DataFrame, by: list[str], list_col: str, seq: str, fold_case: bool) -> DataFrame:
    items = rows.select(*by, seq, F.posexplode(list_col).alias("pos", "item")).where("item IS NOT NULL")
    form = F.lower("item") if fold_case else F.col("item")
    first = items.groupBy(*by, form.alias("_item_form")).agg(F.min(F.struct(seq, "pos", "item")).alias("at"))
    return first.groupBy(*by).agg(F.sort_array(F.collect_list("at")).alias("all")).select(*by, F.transform("all", lambda x: x["item"]).alias(list_col))


# What a node may have beyond its key, kind and place in order, with types; a table without one of these counts as having nulls.
OPTIONAL = {
    "illustration": "struct<kind:string,hint:string>", "illustration_path": "string", "parents": "array<string>", "origin": "string", "created_at": "timestamp", "updated_at": "timestamp",
}
_MERGED = ["key", "node_type", "name", "summary", "scope", "content_type", "raw_excerpt", "key_terms", "source_ids", "seq"]


def _widened(rows: DataFrame, more: list[str]) -> DataFrame:
    return rows.select(*_MERGED, *(F.col(c).cast(OPTIONAL[c]).alias(c) if c in rows.columns else F.lit(None).cast(OPTIONAL[c]).alias(c) for c in more))


def merge_nodes(existing: DataFrame, proposals: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, counters): proposals (key, node_type, name, summary, scope, content_type, raw_excerpt, key_terms, source_ids, seq) merged by key.

    Of equal keys in order of seq, existing rows first: the first name, the longest summary and excerpt (the first of
    equally long ones), narrow scope if any is narrow, the first content type that isn't other, and the ordered unions of
    key terms (by case-folded form) and sources. Where either table has them, also the first illustration, picture path and
    origin, the ordered union of parents, the first created_at (`at` for a new node without one), and as updated_at `at` (by
    default the time now) for every node that a proposal touches. counters: added (keys unseen so far) and merged (all other proposals).

    Lists are taken apart, made distinct and put together in one pass for all of them.
    """
    more = [c for c in OPTIONAL if c in existing.columns or c in proposals.columns]
    low = _widened(existing, more).withColumn("seq", F.struct(F.lit(0).alias("age"), F.col("seq").alias("seq")))
    rows = low.unionByName(_widened(proposals, more).withColumn("seq", F.struct(F.lit(1).alias("age"), F.col("seq").alias("seq"))))
    at = F.current_timestamp() if at is None else at

    def longest(column: str) -> Column:
        return F.max_by(column, F.struct(F.length(F.coalesce(F.col(column), F.lit(""))), F.struct(-F.col("seq.age"), -F.col("seq.seq"))))

    def first_of(column: str, given: Column) -> Column:
        return F.min_by(F.when(given, F.col(column)), F.when(given, F.col("seq")))

    typed = F.col("content_type").isNotNull() & (F.col("content_type") != "other")
    touched = F.max("seq.age") == 1
    extras = {
        "illustration": first_of("illustration", F.col("illustration").isNotNull()) if "illustration" in more else None,
        "illustration_path": first_of("illustration_path", F.coalesce(F.col("illustration_path"), F.lit("")) != "") if "illustration_path" in more else None,
        "origin": F.coalesce(first_of("origin", F.col("origin").isNotNull()), F.lit("ingested")) if "origin" in more else None,
        "created_at": F.coalesce(F.min_by("created_at", "seq"), at) if "created_at" in more else None,
        "updated_at": F.when(touched, at).otherwise(F.max("updated_at")) if "updated_at" in more else None,
    }
    merged = rows.groupBy("key").agg(
        F.min_by("node_type", "seq").alias("node_type"),
        F.min_by("name", "seq").alias("name"),
        longest("summary").alias("summary"),
        F.when(F.max(F.col("scope") == "narrow"), "narrow").otherwise(F.min_by("scope", "seq")).alias("scope"),
        F.coalesce(first_of("content_type", typed), F.max("content_type")).alias("content_type"),
        longest("raw_excerpt").alias("raw_excerpt"),
        *(value.alias(name) for name, value in extras.items() if value is not None),
    )
    lists = ["key_terms", "source_ids", *(["parents"] if "parents" in more else [])]

    def entries(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(c).alias("list"), i.alias("pos"), x.alias("item")))

    def union(c: str) -> Column:
        return F.nullif(F.transform(F.filter("all", lambda x: x["list"] == c), lambda x: x["at"]["item"]), F.array().cast("array<string>")).alias(c)

    tagged = F.concat(*map(entries, lists))
    items = rows.select("key", "seq", F.explode(tagged).alias("x")).select("key", "seq", "x.*").where("item <> ''")
    form = F.when(F.col("list") == "key_terms", F.lower("item")).otherwise(F.col("item"))
    first = items.groupBy("key", "list", form.alias("form")).agg(F.min(F.struct("seq", "pos", "item")).alias("at"))
    gathered = first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "list"))).alias("all"))
    unions = gathered.select("key", *map(union, lists))
    nodes = merged.join(unions, "key", "left")
    new = proposals.select("key").join(existing.select("key"), "key", "left_anti")
    counters = proposals.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(new.agg(F.countDistinct("key").alias("added")))).select("added", (F.col("n") - F.col("added")).alias("merged"))
    return nodes, counters


def dedup_subtopics(props: DataFrame) -> DataFrame:
    """Subtopics (seq, name, summary, source_chunk_ids) of one lower-case name as one: longest summary, all chunk ids, else the first's."""
    keyed = props.withColumn("form", F.lower(F.trim("name")))
    best = keyed.groupBy("form").agg(F.min_by("name", "seq").alias("name"), F.max_by("summary", F.struct(F.length("summary"), -F.col("seq"))).alias("summary"), F.min("seq").alias("seq"))
    return best.join(ordered_union(keyed, ["form"], "source_chunk_ids"), "form", "left").drop("form")


def structural_edges(wanted: DataFrame, nodes: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, warnings) of wanted (src, dst, relation, source_chunk_ids, seq): one edge for each src, relation and dst.

    Only STRUCTURAL relations hold and both ends must be nodes, else the edge becomes a warning; edges from a node to
    itself vanish. HAS_SUBTOPIC has no chunk ids, others the ordered union. Edges that are `existing` (the same columns)
    hold as they are.
    """
    keys = nodes.select("key").distinct()
    alien = wanted.where(~F.col("relation").isin(*STRUCTURAL) | F.col("relation").isNull()).select("src", "dst", F.lit("not a structural relation").alias("reason"))
    loose = wanted.where(F.col("relation").isin(*STRUCTURAL) & (F.col("src") != F.col("dst")))
    kept = loose.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
    warnings = loose.join(keys.withColumnRenamed("key", "src"), "src", "left_anti").select("src", "dst", F.lit("missing source").alias("reason")).unionByName(
        loose.join(keys.withColumnRenamed("key", "dst"), "dst", "left_anti").select("src", "dst", F.lit("missing target").alias("reason"))
    )
    by = ["src", "dst", "relation"]
    kept = kept if existing is None else existing.select(*by, "source_chunk_ids", "seq").unionByName(kept.select(*by, "source_chunk_ids", "seq"))
    lists = ordered_union(kept.where("relation <> 'HAS_SUBTOPIC'"), by, "source_chunk_ids")
    return kept.groupBy(*by).agg(F.min("seq").alias("seq")).join(lists, by, "left"), warnings.unionByName(alien)


def attach_contents(links: DataFrame, topic_links: DataFrame) -> DataFrame:
    """(src, dst): contents hang on their subtopics (links: content, parent), and on topics only where no subtopic is known."""
    orphans = topic_links.join(links.select("content").distinct(), "content", "left_anti")
    return links.unionByName(orphans).select(F.col("parent").alias("src"), F.col("content").alias("dst")).distinct()


def semantic_edges(existing: DataFrame, related: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, warnings): one edge for each src, dst and normalised label, with the highest confidence and, where there are any, the ordered union of chunk ids.

    Pairs without both ends are warnings; edges from a node to itself vanish.
    """
    keys = nodes.select("key").distinct()
    none = F.array().cast("array<string>")

    def shaped(rows: DataFrame, age: int) -> DataFrame:
        ids = F.coalesce("source_chunk_ids", none) if "source_chunk_ids" in rows.columns else none
        seq = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")
        return rows.select("src", "dst", norm_label("label").alias("label"), "confidence", ids.alias("source_chunk_ids"), F.struct(F.lit(age).alias("age"), seq.alias("seq")).alias("seq"))

    fresh = shaped(related, 1)
    kept = fresh.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
    warnings = fresh.join(kept.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst", "label", "confidence")
    both = shaped(existing, 0).unionByName(kept.where("src <> dst"))
    by = ["src", "dst", "label"]
    edges = both.groupBy(*by).agg(F.max("confidence").alias("confidence")).join(ordered_union(both, by, "source_chunk_ids"), by, "left")
    return edges.withColumn("relation", F.lit("RELATED_TO")), warnings


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes in gone (key) and all edges at them."""
    keys = gone.select("key").distinct()
    left = edges.join(keys.withColumnRenamed("key", "src"), "src", "left_anti").join(keys.withColumnRenamed("key", "dst"), "dst", "left_anti")
    return nodes.join(keys, "key", "left_anti"), left


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without one edge, the first by seq, for each (src, relation, dst) in gone; with a label there, of RELATED_TO edges the first that has it.

    Labels are compared in their normal form; a blank or null one, and any of another relation, matches every label.
    """
    named = (F.col("relation") == "RELATED_TO") & (F.trim(F.coalesce("label", F.lit(""))) != "") if "label" in gone.columns else F.lit(False)
    asked = gone.select("src", "relation", "dst", (F.when(named, norm_label("label")) if "label" in gone.columns else F.lit(None).cast("string")).alias("_asked")).distinct()
    own = (norm_label("label") if "label" in edges.columns else F.lit("")).alias("_own")
    met = edges.select("src", "relation", "dst", "seq", own).join(asked, ["src", "relation", "dst"]).where("_asked IS NULL OR _asked = _own")
    first = met.groupBy("src", "relation", "dst", "_asked").agg(F.min(F.struct("seq", "_own")).alias("at"))
    one = ["src", "relation", "dst", "seq", "_own"]
    first = first.select("src", "relation", "dst", "at.seq", "at._own").distinct().withColumn("_gone", F.lit(True))
    # of rows equal in all of this one goes
    turn = F.row_number().over(Window.partitionBy(*one).orderBy("seq"))
    return edges.withColumn("_own", own).join(first, one, "left").withColumn("_turn", turn).where("NOT (coalesce(_gone, false) AND _turn = 1)").select(*edges.columns)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, degree): in and out, parallel edges each, an edge to itself twice; 0 for nodes without edges."""
    ends = edges.select(F.col("src").alias("key")).unionAll(edges.select(F.col("dst").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("key").join(ends, "key", "left").select("key", F.coalesce("degree", F.lit(0)).alias("degree"))


def prune_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that have an edge."""
    ends = edges.select(F.col("src").alias("key")).unionAll(edges.select(F.col("dst").alias("key"))).distinct()
    return nodes.join(ends, "key", "left_semi")


def prune_to_ratio(nodes: DataFrame, edges: DataFrame, max_rounds: int = 20, min_keep: int = 0) -> tuple[DataFrame, DataFrame]:
    """Fewer topics than subtopics than contents: of a tier that isn't smaller than the next one the nodes of lowest degree go, by seq on ties.

    Only the three counts come to the driver each round; the graph is stored between rounds.
    """
    for _ in range(max_rounds):
        n = {r["node_type"]: r["count"] for r in nodes.groupBy("node_type").count().collect()}
        for upper, lower in (("topic", "subtopic"), ("subtopic", "content")):
            high, low = n.get(upper, 0), n.get(lower, 0)
            if low > 0 and high >= low:
                drop = min(high - low + 1, high - min_keep)
                break
        else:
            break
        if drop <= 0:
            break
        tier = nodes.where(F.col("node_type") == upper).join(degrees(nodes, edges), "key")
        lowest = tier.orderBy("degree", "seq").limit(drop).select("key")
        nodes, edges = remove_nodes(nodes, edges, lowest)
        nodes, edges = stored(nodes), stored(edges)
    return nodes, edges


# What of a node may be changed.
MUTABLE = ("name", "summary", "scope", "content_type", "raw_excerpt", "key_terms", "source_ids")


def patch_nodes(nodes: DataFrame, patches: DataFrame, fields: tuple[str, ...] = MUTABLE, at: Column | None = None) -> DataFrame:
    """Nodes with the fields of patches (key, ...) that are given and may change; other fields and unknown keys change nothing.

    Where nodes have updated_at it becomes `at`, by default the time now, for every node with a patch. Of several patches
    of a key the largest value of each field counts.
    """
    given = [f for f in fields if f in patches.columns and f in nodes.columns]
    small = patches.groupBy("key").agg(F.lit(True).alias("_patched"), *(F.max(f).alias(f"_new_{f}") for f in given))
    joined = nodes.join(small, "key", "left")

    def value(c: str) -> Column:
        if c == "updated_at":
            return F.when(F.col("_patched"), at if at is not None else F.current_timestamp()).otherwise(F.col(c)).alias(c)
        return F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c)

    return joined.select(*map(value, nodes.columns))


class EditResult(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    rejected: DataFrame


# Kinds of nodes and of contents that may be put in, and what a kind's parents are linked by.
NODE_KINDS = ("topic", "subtopic", "content")
CONTENT_TYPES = ("definition", "theorem", "technique", "example", "question", "figure", "other")
PARENT_RELATION = {"subtopic": "HAS_SUBTOPIC", "content": "HAS_CONTENT"}


def _accepted_nodes(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, seq) of the `wanted` nodes (seq, key, parents) that hold, of `known` (key): the first of each key whose parents are all there before it.

    A parent is there if it is known, or if a node of the batch with a smaller seq that holds makes it. Each round
    decides what no undecided node stands before; the rounds are as many as the longest chain of new parents.
    """
    fresh = stored(wanted.join(known, "key", "left_anti").select("seq", "key", "parents"))
    refs = fresh.select("seq", F.explode("parents").alias("parent")).distinct()
    refs = stored(refs.join(known.withColumnRenamed("key", "parent"), "parent", "left_anti"))
    undecided, made = fresh.select("seq", "key"), fresh.select("key", "seq").limit(0)
    while True:
        waiting = undecided.groupBy("key").agg(F.min("seq").alias("first_seq"))
        makers = made.select(F.col("key").alias("parent"), F.col("seq").alias("made_seq"))
        state = refs.join(undecided.select("seq"), "seq", "left_semi").join(makers, "parent", "left").join(waiting.select(F.col("key").alias("parent"), "first_seq"), "parent", "left")
        verdict = F.when(F.col("made_seq") < F.col("seq"), 0).when(F.col("first_seq") < F.col("seq"), 1).otherwise(2)
        worst = state.groupBy("seq").agg(F.max(verdict).alias("worst"))
        judged = undecided.join(worst, "seq", "left").select("seq", "key", F.coalesce("worst", F.lit(0)).alias("worst")).where("worst < 2")
        lead = stored(judged.groupBy("key").agg(F.min(F.struct("seq", "worst")).alias("lead")).select("key", F.col("lead.seq").alias("seq"), "lead.worst"))
        ready = lead.where("worst = 0").select("key", "seq")
        made = stored(made.unionByName(ready))
        undecided = stored(judged.select("seq", "key").join(ready.select("key"), "key", "left_anti"))
        if undecided.isEmpty():
            return made


def apply_batch(nodes: DataFrame, edges: DataFrame, node_edits: DataFrame, edge_edits: DataFrame) -> EditResult:
    """Nodes and edges put in by hand, in order of seq (unique over both tables of edits), and those rejected (seq, reason).

    node_edits: seq, node_type, name, parents (keys), content_type, and any other columns of nodes. A node's key is made
    of kind and name; it is rejected with an empty name, an unknown kind or content type (null counts as other), where its key is there already, or where a
    parent isn't (topics have none). Links to its parents come with it. edge_edits: seq, src, dst, relation (any case), label: both ends
    must be there before it, the relation must be one of the three, RELATED_TO needs a label, and no edge may be there twice, labels
    compared in normal form. What an edit before it in the batch made counts as there, what was rejected doesn't.
    """
    known = stored(nodes.select("key").distinct())
    kind = F.lower(F.coalesce("node_type", F.lit("")))
    wanted = node_edits.withColumns(
        {
            "node_type": kind,
            "name": strip(F.coalesce("name", F.lit(""))),
            "content_type": F.when(kind == "content", F.coalesce("content_type", F.lit("other"))),
            "parents": F.when(kind == "topic", F.array().cast("array<string>")).otherwise(F.coalesce("parents", F.array().cast("array<string>"))),
        }
    ).withColumn("key", make_key(F.col("node_type"), F.col("name")))
    reason = F.when(F.col("name") == "", "empty name").when(~F.col("node_type").isin(*NODE_KINDS), "unknown kind").when((F.col("node_type") == "content") & ~F.col("content_type").isin(*CONTENT_TYPES), "unknown content type")
    wanted = stored(wanted.withColumn("_reason", reason))
    sound = wanted.where("_reason IS NULL")
    made = _accepted_nodes(known, sound)
    taken = sound.join(made.select("seq"), "seq", "left_semi")
    first = known.select("key", F.lit(None).cast("long").alias("first")).unionByName(made.select("key", F.col("seq").cast("long").alias("first")))
    lost = sound.join(made.select("seq"), "seq", "left_anti").select("seq", "key").join(first.withColumn("_has", F.lit(True)), "key", "left")
    clash = F.coalesce(F.col("_has") & (F.col("first").isNull() | (F.col("first") < F.col("seq"))), F.lit(False))
    bad_nodes = wanted.where("_reason IS NOT NULL").select("seq", F.col("_reason").alias("reason")).unionByName(lost.select("seq", F.when(clash, "conflict").otherwise("missing parent").alias("reason")))

    by_kind = F.create_map(*(F.lit(x) for pair in PARENT_RELATION.items() for x in pair))
    auto = taken.select("seq", F.explode("parents").alias("src"), F.col("key").alias("dst"), by_kind[F.col("node_type")].alias("relation"), F.lit(None).cast("string").alias("label"), F.lit(True).alias("_auto"))
    relation = F.upper(strip(F.coalesce("relation", F.lit(""))))
    asked = edge_edits.select("seq", strip("src").alias("src"), strip("dst").alias("dst"), relation.alias("relation"), "label", F.lit(False).alias("_auto"))
    there = first.select("key", F.coalesce("first", F.lit(-(2**63)).cast("long")).alias("first"))
    asked = asked.join(there.select(F.col("key").alias("src"), F.col("first").alias("_src")), "src", "left").join(there.select(F.col("key").alias("dst"), F.col("first").alias("_dst")), "dst", "left")
    gone = lambda c: F.coalesce(F.col(c) >= F.col("seq"), F.lit(True))
    unsound = (
        F.when(F.col("relation") == "", "empty relation")
        .when(gone("_src"), "missing source")
        .when(gone("_dst"), "missing target")
        .when(~F.col("relation").isin(*STRUCTURAL, "RELATED_TO"), "unknown relation")
        .when((F.col("relation") == "RELATED_TO") & (F.trim(F.coalesce("label", F.lit(""))) == ""), "missing label")
    )
    asked = stored(asked.withColumn("reason", unsound).drop("_src", "_dst"))
    tagged = auto.unionByName(asked.where("reason IS NULL").drop("reason")).withColumn("_label", F.when(F.col("relation") == "RELATED_TO", norm_label("label")).otherwise(F.lit("")))
    same = ["src", "dst", "relation", "_label"]
    before = edges.select("src", "dst", "relation", F.when(F.col("relation") == "RELATED_TO", norm_label("label")).otherwise(F.lit("")).alias("_label")).distinct()
    # an edge's first edit; its seq names it, so that many edits of one edge meet nowhere
    firsts = tagged.groupBy(*same).agg(F.min(F.when(F.col("_auto"), F.col("seq"))).alias("auto"), F.min(F.when(~F.col("_auto"), F.col("seq"))).alias("hand")).join(before, same, "left_anti")
    firsts = stored(firsts.select(*same, F.least("auto", "hand").alias("seq"), (F.col("auto").isNull() | F.coalesce(F.col("hand") < F.col("auto"), F.lit(False))).alias("by_hand")))
    by_hand = firsts.where("by_hand").select("seq")
    clashing = asked.where("reason IS NULL").join(by_hand, "seq", "left_anti").select("seq", F.lit("conflict").alias("reason"))
    rejected = bad_nodes.unionByName(asked.where("reason IS NOT NULL").select("seq", "reason")).unionByName(clashing)

    grown = nodes.unionByName(taken.withColumn("origin", F.lit("manual")).select(*(c for c in [*node_edits.columns, "key", "origin"] if c in nodes.columns)), allowMissingColumns=True)
    new_edges = firsts.select("src", "dst", "relation", F.when(F.col("relation") == "RELATED_TO", F.col("_label")).alias("label"), "seq")
    return EditResult(grown, edges.unionByName(new_edges.select(*(c for c in new_edges.columns if c in edges.columns)), allowMissingColumns=True), rejected)


def apply_edits(nodes: DataFrame, edges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of edge edits (src, dst, relation, label, and seq, else in any order): as apply_batch judges them."""
    numbered = edits if "seq" in edits.columns else edits.withColumn("seq", F.monotonically_increasing_id())
    numbered = stored(numbered.select("src", "dst", "relation", "label", "seq"))
    none = nodes.limit(0).select(F.lit(0).cast("long").alias("seq"), F.lit("").alias("node_type"), F.lit("").alias("name"), F.lit("").alias("content_type"), F.array().cast("array<string>").alias("parents"))
    rejected = stored(apply_batch(nodes.select("key"), edges.select("src", "dst", "relation", "label"), none, numbered).rejected)
    return numbered.join(rejected, "seq", "left_anti").drop("seq"), numbered.join(rejected, "seq").drop("seq")
