"""N-gram Jaccard join: a grouped prefix join over word shingles, and the components of its links."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm._common import broadcast_if_small, discard, lean, shuffle_partitions, spool, text_slices
from quillspan.llm.components import connected_components
from quillspan.llm.mph import mix

#: Tokens ordered last because they are frequent: in how many prefixes at least, and how many at most.
HOT_DF, HOT_TOKENS = 32, 65_536
#: Entries of a posting list, or of a part of one, that one task compares with one another.
BLOCK = 2048
#: Bits of the short sketches, as so many 64-bit words.
SKETCH_BITS, SKETCH_WORDS = 512, 8
#: Bits of the bitmap that picks documents for verification, and how many documents it is used for.
FILTER_BITS, FILTER_NODES = 1 << 24, 1 << 20
#: Members of a prefix that go to one place when what is known of its group is looked up.
CHUNK = 256
#: Pairs with one and the same set that go to one place, and members of a group that others meet before the last turn.
HUB, HEADS = 1024, 16
CACHED = 200_000
#: Bytes of text that a task holds as words at a time.
SLICE = 2_000_000
#: Candidates that a class has verified in a turn, but for the last turn, which verifies all.
BEST = 3
#: Entries of a long list that are compared with the rest of it at once.
ROWS_AT_ONCE = 64


class WordHashes(dict):
    """64-bit hashes of words, remembered by the worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[str], words: int, hashes: WordHashes) -> list[np.ndarray]:
    """The distinct word shingles of each text, A-Z lower-cased, as ascending 64-bit hashes.

    Words stand between ASCII white space. A text with fewer words is one shingle, one without words has none. The
    texts' words lie behind one another while they are hashed; shingles that would cross from text to text are left out.
    """
    found = [x.encode().lower().split() for x in texts]
    size = [len(x) for x in found]
    own = np.fromiter(map(hashes.__getitem__, chain.from_iterable(found)), np.uint64, sum(size))
    n = max(0, len(own) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total = mix(total + own[k : k + n], k)
    out, at = [], 0
    for these, k in zip(found, size, strict=True):
        if k >= words:
            part = np.sort(total[at : at + k - words + 1])
            keep = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            out.append(part[keep])
        elif k:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(these), seed=k)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def prefix_length(n: np.ndarray | int, numer: int, denom: int):
    """Sets as similar as numer / denom share one of their first so many members, in any common order."""
    return n - -(-numer * n // denom) + 1


def sketch(members: np.ndarray, bits: int) -> bytes:
    """For each bin whether an odd number of members fall in it. Two sketches differ in no more bits than the sets in members."""
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def wide_bits(n: int) -> int:
    """Bins of a set's second sketch: twice its members, as a power of two."""
    return max(SKETCH_BITS, 1 << (2 * n - 1).bit_length()) if n else SKETCH_BITS


def sketches_differ(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(y) < len(x):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def hot_tokens(docs: DataFrame, words: int, numer: int, denom: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (ascending) that stand in HOT_DF prefixes or more when members are in order of hash, and in how many.

    They only set the order of members, which may be any: it decides how long posting lists are, not what links.
    The HOT_TOKENS most frequent are kept, so what is broadcast has a bound.
    """

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for _, texts in text_slices(batch.column(1), SLICE):
                flat = [x[: prefix_length(len(x), numer, denom)] for x in shingle_sets(texts, words, hashes) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*flat, np.zeros(0, np.uint64)]).view(np.int64))], ["token"])

    found = docs.mapInArrow(lean(run), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_DF).orderBy(F.desc("n"), "token").limit(HOT_TOKENS).collect()
    tokens = np.array([r["token"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["n"] for r in found], np.int64)[order]


def _words(name: str, make=F.col) -> list:
    return [make(f"{name}{k}") for k in range(SKETCH_WORDS)]


def signatures(docs: DataFrame, words: int, numer: int, denom: int) -> DataFrame:
    """(id, n, key, group_key, prefix, s0 .. s7, wide): size, 128-bit hashes of the set and of prefix and size, first members in
    the common order, two sketches (the short one as longs)."""
    tokens, counts = hot_tokens(docs, words, numer, denom)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, counts))
    names = ["id", "n", "key", "group_key", "prefix", *_words("s", str), "wide"]

    def run(batches):
        hot, df = shared.value
        hashes = WordHashes()
        for batch in batches:
            for start, texts in text_slices(batch.column(1), SLICE):
                n, key, group_key, prefix, short, wide = [], [], [], [], [], []
                for own in shingle_sets(texts, words, hashes):
                    first = own
                    if len(hot) and len(own):
                        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                        is_hot = hot[at] == own
                        if is_hot.any():
                            first = own[np.argsort(np.where(is_hot, df[at], 0), kind="stable")]
                    head = first[: prefix_length(len(own), numer, denom)].tobytes() if len(own) else b""
                    n.append(len(own))
                    key.append(xxhash.xxh3_128_digest(own.tobytes()))
                    group_key.append(xxhash.xxh3_128_digest(head, seed=len(own)))
                    prefix.append(head)
                    short.append(sketch(own, SKETCH_BITS))
                    wide.append(sketch(own, wide_bits(len(own))))
                bits = np.frombuffer(b"".join(short), np.int64).reshape(-1, SKETCH_WORDS)
                columns = [batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (key, group_key, prefix)), *(pa.array(bits[:, k].copy()) for k in range(SKETCH_WORDS)), pa.array(wide, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(lean(run), "id long, n long, key binary, group_key binary, prefix binary, " + ", ".join(_words("s", lambda c: f"{c} long")) + ", wide binary")


def grouped(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of classes (node, n, group_key, prefix, s0 .. s7): sets with the same prefix and size are one group.

    groups: gid (its smallest node), n, size, prefix, the bits that all (a0 ..) and that any (o0 ..) of its members'
    sketches have. members: node, gid, n, s0 .. s7. Both spooled. Members are counted before the shuffle; a group of any
    size is a row.
    """
    bits = [f(c).alias(name + c[1:]) for f, name in ((F.bit_and, "a"), (F.bit_or, "o")) for c in _words("s", str)]
    groups = spool(classes.groupBy("group_key").agg(F.min("node").alias("gid"), F.max("node").alias("last"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size"), F.first("prefix").alias("prefix"), *bits), "groups")
    many = broadcast_if_small(groups.where("size > 1").select("group_key", "gid"))
    members = classes.join(many, "group_key", "left").select("node", F.coalesce("gid", "node").alias("gid"), "n", *_words("s"))
    return groups.drop("group_key"), spool(members, "members")


def _postings(groups: DataFrame) -> DataFrame:
    """(token, df, pos, gid): members of prefixes that two groups or more have there."""

    def run(batches):
        for batch in batches:
            prefixes = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            size = [len(x) for x in prefixes]
            flat = np.concatenate([*prefixes, np.zeros(0, np.int64)])
            pos = np.concatenate([*(np.arange(k) for k in size), np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(pos), batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))], ["token", "pos", "gid"])

    entries = groups.select("gid", "prefix").mapInArrow(lean(run), "token long, pos long, gid long")
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return entries.join(shared, "token")


def _pairs_of(table: pa.Table, numer: int, denom: int, every: bool, turn: int) -> pa.Table:
    """Candidate pairs (a < b) of groups within each token's list, but those whose members all are of one component.

    Sizes, positions and the bits that all or no members' sketches have rule pairs out. `every` gives all candidates,
    otherwise each group's best in an order dealt anew each turn. Pairs come as (a, b, token), b the one earlier in that
    order.
    """
    order = np.lexsort((table["n"].to_numpy(), table["token"].to_numpy()))
    token, n, pos, node, low, high, part = (table[c].to_numpy()[order] for c in ("token", "n", "pos", "gid", "low", "high", "part"))
    two = table["i"][0].as_py() != table["j"][0].as_py()
    all_, any_ = (np.stack([table[c].to_numpy()[order] for c in _words(x, str)], axis=1) for x in "ao")
    deal = mix(node.astype(np.int64).view(np.uint64), turn)
    out_a, out_b, out_token = [], [], []

    def passing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small, large = n[x], n[y]
        ok = (np.minimum(low[x], low[y]) != np.maximum(high[x], high[y])) & (node[x] != node[y]) & (denom * small >= numer * large)
        if two:
            ok &= part[x] != part[y]
        bound = np.minimum(pos[x], pos[y]) + 1 + np.minimum(small - pos[x], large - pos[y]) - 1
        ok &= (numer + denom) * bound >= numer * (small + large)
        x, y = x[ok], y[ok]
        differ = np.bitwise_count(((all_[x] & ~any_[y]) | (all_[y] & ~any_[x])).view(np.uint64)).sum(axis=1, dtype=np.int64)
        ok = differ * (numer + denom) <= (n[x] + n[y]) * (denom - numer)
        return x[ok], y[ok]

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        if not every and len(x):
            own, other = np.concatenate((x, y)), np.concatenate((y, x))
            by = np.lexsort((deal[other], own))
            own, other = own[by], other[by]
            first = np.concatenate(([True], own[1:] != own[:-1]))
            x, y = own[first], other[first]
        swap = deal[x] < deal[y]
        out_a.append(node[np.where(swap, y, x)])
        out_b.append(node[np.where(swap, x, y)])
        out_token.append(token[x])

    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    sizes = np.diff(np.append(starts, len(token)))
    small_list = np.repeat(sizes <= 64, sizes)
    found_x, found_y = [], []
    for step in range(1, int(min(64, sizes.max(initial=1)))):
        at = np.flatnonzero((token[step:] == token[:-step]) & small_list[step:])
        if len(at):
            x, y = passing(at, at + step)
            found_x.append(x)
            found_y.append(y)
    if found_x:
        keep(np.concatenate(found_x), np.concatenate(found_y))
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        stop = start + size
        for first in range(start, stop, ROWS_AT_ONCE):
            last = min(first + ROWS_AT_ONCE, stop)
            reach = int(np.searchsorted(n[start:stop], denom * n[last - 1] // numer, side="right")) + start
            x, y = np.meshgrid(np.arange(first, last), np.arange(first + 1, reach), indexing="ij")
            above = y > x
            keep(*passing(x[above], y[above]))
    found = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (out_a, out_b, out_token)]
    return pa.table(dict(zip(("a", "b", "token"), found, strict=True))).group_by(["a", "b", "token"]).aggregate([])


def _candidates(postings: DataFrame, groups: DataFrame, spans: DataFrame | None, numer: int, denom: int, every: bool, turn: int, buckets: int) -> DataFrame:
    """(a, b, token): candidate pairs of groups. spans (gid, low, high): the smallest and largest component of a group's members."""
    state = groups.drop("prefix", "size")
    state = state.withColumn("low", F.col("gid")).withColumnRenamed("last", "high") if spans is None else state.drop("last").join(spans, "gid")
    # what is known of a group goes to its prefix in chunks, so that a long text's prefix has no place of its own
    last = F.expr(f"(n + ((-{numer} * n) DIV {denom})) DIV {CHUNK}")
    state = state.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    lists = postings.withColumn("chunk", F.expr(f"pos DIV {CHUNK}")).join(state, ["gid", "chunk"])
    if spans is not None:
        mixed = lists.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
        lists = lists.join(mixed.select("token"), "token")
    parts = F.ceil(F.col("df") / BLOCK).cast("long")
    lists = lists.withColumn("part", F.pmod(F.xxhash64("gid"), parts))
    # a list of up to BLOCK entries lies in a bucket with others; a longer one is dealt as pairs of its parts
    own = F.when(parts == 1, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    )
    dealt = lists.withColumn("bucket", F.when(parts == 1, F.pmod(F.xxhash64("token"), F.lit(buckets))).otherwise(F.col("token"))).withColumn("at", F.explode(own))
    dealt = dealt.select("bucket", "at.i", "at.j", "token", "n", "pos", "gid", "low", "high", "part", *_words("a"), *_words("o"))
    return dealt.groupBy("bucket", "i", "j").applyInArrow(lambda table: _pairs_of(table, numer, denom, every, turn), "a long, b long, token long")


def _best(found: DataFrame, turn: int) -> DataFrame:
    """Of the candidates of each group from all its lists a few, in one order for all groups, so that many choose the same."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b", F.lit(turn)), "b"))
    return found.select("a", "b").distinct().withColumn("rank", rank).where(F.col("rank") <= BEST).drop("rank")


def _between(pairs: DataFrame, members: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """The members x and y of pairs of groups (a, b), all that may be of different components.

    A pair has a row for each member of its smaller group, but those of the one component that the larger group has; these meet the members
    of the larger group, of which parts of about HUB lie in one place.
    """
    spans = members.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    of = lambda side: spans.select(F.col("gid").alias(side), F.struct("size", "gid", "low", "high").alias(f"of_{side}"))
    sided = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("of_a", "of_b").alias("few"), F.greatest("of_a", "of_b").alias("many"))
    parts = lambda size: F.ceil(size / HUB).cast("long")
    asking = sided.join(x, F.col("few.gid") == F.col("x_gid")).where((F.col("many.low") < F.col("many.high")) | (F.col("x_component") != F.col("many.low")))
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("many.size")) - 1)))
    asked = y.join(spans.select(F.col("gid").alias("y_gid"), "size"), "y_gid").withColumn("y_part", F.pmod(F.xxhash64("y_node"), parts(F.col("size"))))
    return asking.join(asked, (F.col("many.gid") == F.col("y_gid")) & (F.col("part") == F.col("y_part")))


def _expanded(pairs: DataFrame, members: DataFrame, numer: int, denom: int, every: bool, turn: int) -> DataFrame:
    """(a, b): pairs of members of different components, for pairs of groups (a, b) and within groups, that sketches don't rule out.

    members: node, gid, n, component, s0 .. s7. With `every` all of them. Otherwise each member meets the first HEADS
    members of its own and of the other group, in one order for all, and the first BEST of these that may link stay.
    """
    x, y = (members.select(*(F.col(c).alias(f"{side}_{c}") for c in ("node", "gid", "n", "component", *_words("s", str)))) for side in "xy")
    if every:
        split = members.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gid")
        inner = members.join(split, "gid", "left_semi")
        x_in = inner.select(*(F.col(c).alias(f"x_{c}") for c in ("node", "gid", "n", "component", *_words("s", str))))
        within = x_in.join(y, (F.col("x_gid") == F.col("y_gid")) & (F.col("x_node") < F.col("y_node")) & (F.col("x_component") != F.col("y_component")))
        between = _between(pairs, members, x, y)
        met = within.select(*x.columns, *y.columns).unionByName(between.select(*x.columns, *y.columns))
    else:
        sizes = broadcast_if_small(members.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b")))
        turned = F.row_number().over(Window.partitionBy("y_gid").orderBy(F.xxhash64("y_node", F.lit(turn)), "y_node"))
        heads = y.withColumn("place", turned).where(F.col("place") <= HEADS)
        met = pairs.unionByName(sizes).join(x, F.col("a") == F.col("x_gid")).join(heads, F.col("b") == F.col("y_gid")).drop("place")
    differ = sum((F.bit_count(F.col(f"x_s{k}").bitwiseXOR(F.col(f"y_s{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))
    near = (F.col("x_component") != F.col("y_component")) & (differ * (numer + denom) <= (F.col("x_n") + F.col("y_n")) * (denom - numer)) & (F.least("x_n", "y_n") * denom >= F.greatest("x_n", "y_n") * numer)
    found = met.where(near)
    if not every:
        rank = F.row_number().over(Window.partitionBy("x_node").orderBy(F.xxhash64("y_node", F.lit(turn)), "y_node"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= BEST)
    return found.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct()


def _with_value(pairs: DataFrame, key: str, values: DataFrame, name: str) -> DataFrame:
    """`pairs` with the value (node, value) of their column `key` as `name`; the pairs of a hub are dealt in parts of about HUB."""
    hubs = broadcast_if_small(pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / HUB).cast("long").alias("_parts")).where("_parts > 1"))
    part = F.pmod(F.xxhash64("a", "b"), F.coalesce("_parts", F.lit(1).cast("long")))
    dealt = pairs.join(hubs, key, "left").withColumn("_part", part).drop("_parts")
    held = values.select(F.col("node").alias(key), F.col("value").alias(name)).join(hubs, key, "left")
    held = held.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))).drop("_parts")
    return dealt.join(held, [key, "_part"]).drop("_part")


def _filtered(pairs: DataFrame, test, values: DataFrame) -> DataFrame:
    """Pairs (a, b) for which test(value of a, value of b) holds; `values` (node, value) has a row for each node."""

    def run(batches):
        for batch in batches:
            keep = pa.array([test(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    both = _with_value(_with_value(pairs, "a", values, "left"), "b", values, "right")
    return both.select("a", "b", "left", "right").mapInArrow(lean(run), "a long, b long")


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A bitmap of 2^24 bits in which two bits of each node are set. Built in Spark; at most 2^18 words come to the driver."""
    bit = F.explode(F.array(*(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(FILTER_BITS)) for k in (1, 2))))
    words = nodes.select(bit.alias("bit")).groupBy(F.expr("bit DIV 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out


def _members(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, value): whole sets of `nodes` (node, rep, key), read from the rows of their documents `rep` whose sets have their keys.

    For up to FILTER_NODES nodes a bitmap of fixed size goes to all tasks, so that texts are neither shuffled nor all
    split. For more it would let most texts pass, so they are joined with the nodes. Either way the sets are then joined
    with the nodes, as an id may have rows of other texts; of rows that repeat one counts.
    """
    schema = "id long, key binary, value binary"

    def sets(batch: pa.RecordBatch, hashes: WordHashes):
        for start, texts in text_slices(batch.column(1), SLICE):
            found = [x.tobytes() for x in shingle_sets(texts, words, hashes)]
            keys = [xxhash.xxh3_128_digest(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["id", "key", "value"])

    reps = nodes.select(F.col("rep").alias("id")).distinct()
    if nodes.count() > FILTER_NODES:

        def every(batches):
            hashes = WordHashes()
            for batch in batches:
                yield from sets(batch, hashes)

        found = docs.join(reps, "id", "left_semi").select("id", "text").mapInArrow(lean(every), schema)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(node_filter(reps.withColumnRenamed("id", "node")))
        marked = docs.select("id", "text", *(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(FILTER_BITS)).alias(f"bit{k}") for k in (1, 2)))

        def run(batches):
            bits, hashes = shared.value, WordHashes()
            for batch in batches:
                at = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]
                ok = np.logical_and(*((bits[x >> 6] >> (x & 63)) & 1 for x in at)) & ~np.asarray(batch.column(0).is_null())
                yield from sets(batch.filter(pa.array(ok)), hashes)

        found = marked.mapInArrow(lean(run), schema)
    return found.join(broadcast_if_small(nodes.withColumnRenamed("rep", "id")), ["id", "key"]).select("node", "value").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, wide: DataFrame, words: int, numer: int, denom: int) -> DataFrame:
    """The pairs whose whole sets are as similar as numer / denom; spooled. Wide sketches, a thirtieth of the sets' size, go first.

    wide: node, rep, key, n, wide for each node.
    """

    def may(a: dict, b: dict) -> bool:
        return sketches_differ(a["wide"], b["wide"]) * (numer + denom) <= (a["n"] + b["n"]) * (denom - numer)

    def alike(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = np.sort(np.concatenate((x, y)))
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return denom * common >= numer * (len(x) + len(y) - common)

    pairs = spool(pairs, "member-pairs")
    near = spool(_filtered(pairs, may, wide.select("node", F.struct("wide", "n").alias("value"))), "near-pairs")
    nodes = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    sets = spool(_members(docs, wide.select("node", "rep", "key").join(nodes, "node", "left_semi"), words), "sets")
    links = spool(_filtered(near, alike, sets), "links")
    discard(pairs, near, sets)
    return links


def _of_one_id(signed: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """`components` with the classes of each id as one; ids of several classes are told by hashes of their keys, before any join."""
    hashes = [F.xxhash64("key"), F.xxhash64(F.lit(1), "key")]
    sound = signed.where("n > 0 AND id IS NOT NULL")
    several = sound.groupBy("id").agg(*(f(h).alias(f"{name}{k}") for k, h in enumerate(hashes) for f, name in ((F.min, "low"), (F.max, "high")))).where("low0 < high0 OR low1 < high1").select("id")
    links = sound.join(several, "id", "left_semi").select("id", "key").distinct().join(classes.select("key", "node"), "key")
    links = spool(links.join(links.groupBy("id").agg(F.min("node").alias("b")), "id").where("node > b").select(F.col("node").alias("a"), "b"), "id-links")
    if links.isEmpty():
        return components
    return connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, numer: int = 80, denom: int = 100) -> DataFrame:
    """One row for each row of `docs`: id_col (long), n_shingles, component_id.

    Two documents link when denom * intersection >= numer * union of their sets of word shingles. component_id is the
    smallest id reachable by links. Equal sets are one class. Classes with the same prefix and size are one group, and
    groups whose prefixes share a member are candidates: members are ordered by how many prefixes hold them, lists are
    compared in blocks of bounded size, and pairs of groups that size, position or sketches rule out go no further.
    Pairs that are left expand to pairs of members, which sketches sift again; whole sets verify the rest.

    Links are found in turns, so that a dense family of near copies doesn't give all its pairs: first each group
    proposes a few others and its members one each, links are verified and their components merged, then again in
    another order, and at last all candidates between different components are verified. No link between different
    components is lost. Sets just below the threshold to many others are all verified, pair by pair.

    Texts that are null or have no words have no shingles and link with nothing. A row without an id links with
    nothing and has no component. Rows that repeat an id are one document: what any of them links with is linked with all.
    Texts of any length are read whole. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = spool(signatures(rows, words, numer, denom), "signatures")
    same = [F.first(c).alias(c) for c in ("n", "group_key", "prefix", *_words("s", str))]
    # a class has a number of its own, as an id may have rows of several classes
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), *same)
    classes = spool(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups, members = grouped(classes)
    postings = spool(_postings(groups), "postings")
    buckets = max(shuffle_partitions(spark) * 2, postings.count() // 50_000)

    raw = spool(_candidates(postings, groups, None, numer, denom, False, 1, buckets), "pairs")
    # a list or group without a candidate now has none later: what may pass doesn't change
    active = raw.select(F.col("a").alias("gid")).union(raw.select(F.col("b").alias("gid"))).distinct()
    own = spool(members.join(active.union(groups.where("size > 1").select("gid")).distinct(), "gid", "left_semi"), "active-members")
    reps = classes.select("node", "rep", "key").join(own.select("node"), "node", "left_semi")
    wide = spool(signed.select(F.col("id").alias("rep"), "key", "n", "wide").join(reps, ["rep", "key"]).dropDuplicates(["node"]), "wide")
    lists = spool(postings.join(raw.select("token").distinct(), "token", "left_semi").join(broadcast_if_small(active), "gid", "left_semi"), "postings")
    links = _verified(_expanded(_best(raw, 1), own.withColumn("component", F.col("node")), numer, denom, False, 1), rows, wide, words, numer, denom)
    discard(raw, postings)
    components = connected_components(links)
    for turn, every in ((2, False), (3, True)):
        placed = spool(own.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "active-members")
        spans = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        more = spool(_candidates(lists, groups, spans, numer, denom, every, turn, buckets), "pairs")
        chosen = more.select("a", "b").distinct() if every else _best(more, turn)
        new = _verified(_expanded(chosen, placed, numer, denom, every, turn), rows, wide, words, numer, denom)
        discard(more, placed)
        if new.isEmpty():
            continue
        # components so far are links to their smallest nodes
        components = connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))
    discard(lists, wide, own)
    components = _of_one_id(signed, classes, components)
    placed = spool(classes.select("key", "rep", "node").join(components, "node", "left").select("key", "rep", F.coalesce("component", "node").alias("component")), "placed")
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = placed.join(smallest, "component").select("key", "component_id")
    return (
        signed.select("id", "n", "key")
        .join(found, "key", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id")).alias("component_id"))
    )
