"""Document fingerprints from chains of content words that follow common words (SpotSigs), in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm._common import discard, shuffle_partitions, spool, text_of
from quillspan.llm.components import connected_components

#: Sets at least so similar are near copies.
LEAST = 0.8
#: Entries of a signature's list, or of a part of one, that are compared with one another in one place.
BLOCK = 2048
#: Turns before the last in which each set is compared with BEST others among the first HEADS of its lists.
TURNS, BEST, HEADS = 3, 4, 16
#: First members right before one, by which a pair of sets that has met at one of these is told.
WINDOW = 32
#: Longs of a set's sketch, a power of two.
SKETCH = 4
#: Sets from which frequent signatures are counted, and how many of those come last in the common order, by tiers.
SAMPLED, TIERS = 50_000, (64, 512, 4096)

#: Common words of the languages at hand; the mark . stands for any end of a clause or line, and for a text's start.
COMMON_WORDS = {
    "en": "a about an and are as at be been but by can for from had has have he her his i if in is it its not of on or she so that the their there they this to was we were which who will with you",
    "de": "als am an auch auf aus bei das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so um und unter vom von vor war was wie wir zu zum zur über",
    "fr": "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur tu un une vous y à été être",
    "es": "al como con de del donde el ella ellos en entre era es esta este fue ha hay la las le lo los me mi muy más no nos o para pero por que se ser si sin sobre son su sus también un una y ya yo",
}
ANCHORS = tuple(sorted({w for words in COMMON_WORDS.values() for w in words.split()} | {"."}))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words and clause marks, a mark first."""
    marked = F.regexp_replace(F.lower(text), r"[.!?;:,|\n\r]+", " . ")
    return F.filter(F.split(F.concat(F.lit(". "), marked), r"[^\p{L}\p{N}.]+"), lambda w: w != "")


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = 2) -> Column:
    """The distinct signatures of a text as an ascending array of long (64-bit hashes); null counts as empty and has none.

    Wherever an anchor comes right before a content word, the anchor and the next `chain` content words make one;
    chains pass over other anchors, and are shorter at the end of the text.
    """

    def of_words(words: Column) -> Column:
        flagged = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.get(words, i - 1).alias("before")))
        return _let(F.filter(flagged, lambda s: ~s["word"].isin(*anchors)), of_content)

    def of_content(content: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            following = [F.get(content, i + k)["word"] for k in range(1, chain)]
            return F.when(s["before"].isin(*anchors), F.xxhash64(s["before"], s["word"], *following))

        return F.filter(F.transform(content, one), lambda x: x.isNotNull())

    return F.array_sort(F.array_distinct(_let(tokens(text_of(text)), of_words)))


def fingerprint(signature_set: Column) -> Column:
    """Sixteen hex digits for each signature."""
    return F.array_join(F.transform(signature_set, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def length_class(size: Column, least: float) -> Column:
    """Sets whose classes differ by two or more can't be as similar as `least`."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1 / least)))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets, 1 for two empty ones, null if either is null; below `least` it may be 0.

    Sets are told apart by their lengths first: only if those allow `least` are their members intersected.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = F.when(large == 0, 1.0).when(small == 0, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))
    if least <= 0:
        return exact
    far = F.abs(length_class(F.size(a), least) - length_class(F.size(b), least)) >= 2
    return F.when((large > 0) & (far | (small / F.greatest(large, F.lit(1)) < least)), 0.0).otherwise(exact)


def spot_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id_col, signatures, fingerprint. Equal texts have equal ones.

    Null and empty texts have no signatures and an empty fingerprint; texts of any length are read whole. Null ids and
    repeated rows pass through; an empty table gives no rows. Other columns are not read.
    """
    return docs.select(F.col(id_col), signatures(F.col(text_col).cast("string")).alias("signatures")).withColumn("fingerprint", fingerprint(F.col("signatures")))


def set_rows(sets: DataFrame, id_col: str = "id", set_col: str = "signatures") -> DataFrame:
    """`sets` with a number for each row, row_no, and a 128-bit hash of its set, k1 and k2; spooled, so that numbers stay."""
    hashed = sets.withColumns({"row_no": F.monotonically_increasing_id(), "k1": F.xxhash64(F.lit(1), set_col), "k2": F.xxhash64(F.lit(2), set_col)})
    return spool(hashed.withColumnsRenamed({id_col: "id", set_col: "signatures"}), "sets")


def set_classes(rows: DataFrame) -> DataFrame:
    """(node, k1, k2): of `rows` those with equal sets as one, by its smallest row_no; empty sets are left out. No set is shuffled."""
    return spool(rows.where(F.size("signatures") > 0).groupBy("k1", "k2").agg(F.min("row_no").alias("node")), "classes")


def _sets_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, signatures) of the rows that `nodes` (node) names."""
    return rows.select(F.col("row_no").alias("node"), "signatures").join(nodes.select("node"), "node", "left_semi")


def _first_members(n: Column, share: Column | float) -> Column:
    """Sets of n members that have `share` of them in common with another share one of the first so many, in any common order."""
    return (n - F.ceil(F.lit(share) * n - 1e-9) + 1).cast("int")


def _parities(signature_set: Column) -> list[Column]:
    """SKETCH longs, whose bits tell whether an odd number of a set's members falls on each; they differ in no more bits than sets do in members."""

    def word(k: int) -> Column:
        own = F.filter(signature_set, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(SKETCH - 1)) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))

    return [word(k).alias(f"s{k}") for k in range(SKETCH)]


def _not_far(pairs: DataFrame, prefixes: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches allow them to be as similar as `least`; none that is gets lost, and no set is shuffled."""
    sketches = prefixes.select("node", F.struct("n", *(f"s{k}" for k in range(SKETCH))).alias("sketch"))
    x, y = (sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")) for side in ("a", "b"))
    apart = sum((F.bit_count(F.col(f"sketch_a.s{k}").bitwiseXOR(F.col(f"sketch_b.s{k}"))) for k in range(SKETCH)), F.lit(0))
    members = F.col("sketch_a.n") + F.col("sketch_b.n")
    return pairs.join(x, "a").join(y, "b").where(apart <= members * ((1 - least) / (1 + least)) + 1e-9).select("a", "b")


def _prefixes(rows: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(node, n, prefix, s0 and so on): the first members of each set, rare signatures first, and its sketch; spooled.

    Which signatures count as frequent is told from at most about SAMPLED sets. It only sets the order of members,
    which may be any: it decides how long lists are, not what is found.
    """
    sets = _sets_of(rows, classes)
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(max(1, -(-classes.count() // SAMPLED)))) == 0).select(F.explode("signatures").alias("token"))
    hot = [r["token"] for r in some.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(TIERS[-1]).collect()]

    def placed(x: Column) -> Column:
        tier = sum((x.isin(*hot[:k]).cast("int") for k in TIERS if hot), F.lit(0))
        return F.struct(tier.alias("tier"), x.alias("token"))

    n = F.size("signatures")
    first = F.slice(F.sort_array(F.transform("signatures", placed)), F.lit(1), _first_members(n, least))
    return spool(sets.select("node", n.alias("n"), first["token"].alias("prefix"), *_parities(F.col("signatures"))), "prefixes")


def _postings(prefixes: DataFrame) -> DataFrame:
    """(token, node, n, pos, df): the first members that two sets or more have among theirs; spooled."""
    entries = prefixes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return spool(entries.join(shared, "token"), "postings")


def _mixed(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists with each set's component; with labels (node, component) only lists that have two components or more."""
    if labels is None:
        return postings.withColumn("component", F.col("node"))
    lists = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return lists.join(mixed.select("token"), "token")


def _candidates(postings: DataFrame, prefixes: DataFrame, least: float, labels: DataFrame | None = None) -> DataFrame:
    """(a, b): all pairs of sets that lengths and first members allow to be as similar as `least`; with labels (node, component) those of different components.

    Lists are partitioned by length class: the smaller set of a pair lies in its own, the larger one in its own and in
    the one below. A list of more than BLOCK entries is dealt in parts. Two sets meet at a member if it and all that
    follows may be enough; where one of the WINDOW members before it is in both, they have met already, as near copies
    share many members in a row. What is left of pairs that meet twice is made one.
    """
    window = F.slice("prefix", F.greatest(F.col("pos") - WINDOW, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(WINDOW)))
    lists = _mixed(postings, labels).join(prefixes.select("node", "prefix"), "node").withColumn("before", window).drop("prefix")
    own, parts = length_class(F.col("n"), least), F.ceil(F.col("df") / BLOCK).cast("int")
    entry = lambda side: F.struct("node", "n", "pos", "component", "before").alias(side)
    small = lists.where(F.col("pos") < _first_members(F.col("n"), 2 * least / (1 + least)))
    small = small.select("token", own.alias("band"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), entry("x"))
    large = lists.select("token", F.explode(F.array(own, own - 1)).alias("band"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), entry("y"))
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    alike = ordered & (F.col("x.component") != F.col("y.component")) & (F.col("x.n") / F.col("y.n") >= least)
    enough = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= F.ceil(F.lit(least / (1 + least)) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    met = small.join(large, ["token", "band", "part"]).where(alike & enough & ~F.arrays_overlap("x.before", "y.before"))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _heads(postings: DataFrame, least: float, labels: DataFrame | None, turn: int) -> DataFrame:
    """(a, b): for each set the BEST of other components with which it shares most of its lists, among the first HEADS of each list.

    The order is one for all lists and another each turn, so that many choose the same. A few rows for each set.
    """
    lists = _mixed(postings, labels)
    first = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(turn)), "node"))
    heads = lists.withColumn("place", first).where(F.col("place") <= HEADS).select("token", *(F.col(c).alias(f"head_{c}") for c in ("node", "n", "component")))
    alike = (F.col("component") != F.col("head_component")) & (F.least("n", "head_n") / F.greatest("n", "head_n") >= least)
    met = lists.join(heads, "token").where(alike).groupBy(F.col("node").alias("a"), F.col("head_node").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("lists"), F.xxhash64("b", F.lit(turn)), "b"))
    chosen = met.withColumn("rank", rank).where(F.col("rank") <= BEST)
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, prefixes: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of the pairs whose whole sets are as similar as `least`; spooled. Only sets of pairs that sketches leave go along with pairs."""
    pairs = spool(_not_far(pairs, prefixes, least), "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = spool(_sets_of(rows, asked), "candidate-sets")
    x, y = sets.select(F.col("node").alias("a"), F.col("signatures").alias("x")), sets.select(F.col("node").alias("b"), F.col("signatures").alias("y"))
    links = spool(pairs.join(x, "a").join(y, "b").select("a", "b", likeness(F.col("x"), F.col("y"), least).alias("likeness")).where(F.col("likeness") >= least), "links")
    discard(pairs, sets)
    return links


def near_pairs(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, likeness): every pair of different sets of `rows` (as set_rows gives them) whose Jaccard similarity is at least `least`, once.

    a and b are the smallest row_no of their sets; empty sets pair with nothing. Exact. The result grows with the square
    of a group of near copies; near_groups does without all its pairs.
    """
    prefixes = _prefixes(rows, set_classes(rows), least)
    return _verified(_candidates(_postings(prefixes), prefixes, least), prefixes, rows, least)


def near_groups(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(row_no, id, near_group) for each of `rows` (as set_rows gives them): the smallest id reachable by near copies.

    Two sets link when their Jaccard similarity is at least `least`; equal sets are one. First each set is compared with
    a few others, in TURNS turns, so that a large group is mostly joined; then all candidates between different
    components are, so no link between components is lost. Sets without members link with nothing: their group is their own id. A group
    without any id has none.
    """
    classes = set_classes(rows)
    prefixes = _prefixes(rows, classes, least)
    postings = _postings(prefixes)
    components = None
    for turn in range(TURNS + 1):
        pairs = _heads(postings, least, components, turn) if turn < TURNS else _candidates(postings, prefixes, least, components)
        links = _verified(pairs, prefixes, rows, least).select("a", "b")
        # components so far are links to their smallest nodes
        known = links if components is None else links.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b")))
        components = connected_components(known)
    placed = classes.join(components, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    members = rows.select("row_no", "id", "k1", "k2").join(placed, ["k1", "k2"], "left").select("row_no", "id", "component")
    smallest = members.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("smallest"))
    found = members.join(smallest, "component", "left").select("row_no", "id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("near_group"))
    found = spool(found, "near-groups")
    discard(postings, prefixes, classes)
    return found


def with_next(docs: DataFrame, id_col: str, carried: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """`docs` (id_col, `carried` and what is `derived` from these) with following: a struct of the same of the next row in order of id, the first row's after the last.

    Rows go to ranges of ids once, and in front of a range's end stands the first row of the next range again, so that
    each range knows all it needs; what is derived is worked out there, once a row. Ranges are told apart by their first ids, of which the driver holds a few for each
    shuffle partition, whatever the table. Null ids come first. Rows that repeat an id follow one another in order of
    what they carry. A single row follows itself.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), *carried)
    ranges = docs.select("id").repartitionByRange(4 * shuffle_partitions(spark), "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("first_id"), F.count_if(F.col("id").isNull()).alias("blank")).collect()
    firsts, blank = sorted({r["first_id"] for r in ranges if r["first_id"] is not None}), any(r["blank"] for r in ranges)
    kind = docs.schema["id"].dataType
    if not firsts:
        place, begins = F.lit(0), F.lit(True)
    else:
        table = F.array(*(F.lit(x).cast(kind) for x in firsts))
        place = F.greatest(F.size(F.filter(table, lambda x: x <= F.col("id"))) - 1, F.lit(0))
        begins = F.when(F.col("range") > 0, F.col("id") == F.get(table, F.col("range"))).otherwise(F.col("id").isNull() if blank else F.col("id") == F.get(table, F.lit(0)))
    last = max(0, len(firsts) - 1)
    before = F.when(F.col("range") > 0, F.col("range") - 1).otherwise(F.lit(last))
    spot = lambda where, again: F.struct(where.alias("range"), F.lit(again).alias("again"))
    spots = F.when(begins, F.array(spot(F.col("range"), False), spot(before, True))).otherwise(F.array(spot(F.col("range"), False)))
    dealt = docs.withColumn("range", place).withColumn("spot", F.explode(spots)).select("id", *carried, "spot.range", "spot.again")
    dealt = dealt.repartition(4 * shuffle_partitions(spark), "range").withColumns(derived or {})
    known = [*carried, *(derived or {})]
    order = Window.partitionBy("range").orderBy("again", F.asc_nulls_first("id"), *carried)
    return dealt.withColumn("following", F.lead(F.struct(*known)).over(order)).where("NOT again").select(F.col("id").alias(id_col), *known, "following")
