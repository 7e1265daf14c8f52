"""Merkle manifest of a table: trees of row digests, and proofs from one union of missing nodes for each block of leaves.

A leaf is the digest of a row. Leaves of a group stand in order of id, and while there are several nodes every two
consecutive ones (a last one alone) become their digest; what remains is the group's subroot, and the subroots, in order
of group, become the root in the same way. Digests are sha256 over concatenated inputs, inner ones as lowercase hex.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm._common import broadcast_if_small, shuffle_partitions, spool

#: Levels that one task works out of a block of 2^SPAN nodes.
SPAN = 10
#: The number of the tree whose leaves are the subroots.
TOP = -1

NODE = "tree long, level int, idx long, n long, digest binary"
_ASKED = "part_tree long, part long, tree long, level int, idx long"
_PROVED = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean, tree long, idx long, n_leaves long"


def row_digest(fields: Sequence[Column]) -> Column:
    """sha256 of a row, binary: each field `-` if null, else its length in UTF-8 bytes, `:` and itself."""
    shown = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)), 256))


def depth(n: int) -> int:
    """Levels above n leaves."""
    return max(0, n - 1).bit_length()


def joined(*digests: bytes) -> bytes:
    """The digest of one or two nodes."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """`rows` with idx, the place among the rows of its group, and n, the group's rows; null groups are a group.

    Rows go to ranges of (group, order), so that a large group has many ranges; a range's first place is the count of
    its group's rows in the ranges before. Only these counts, one for each range and group in it, meet by group.
    Rows equal in `order` may stand in either order.
    """
    keys = [F.asc_nulls_first(c) for c in (group, *order, "_tie")]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(2 * shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    ranged = spool(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "ranged")
    counts = spool(ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "counts")
    by_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = broadcast_if_small(counts.select(F.col(group).alias("_group"), F.col("_range").alias("_in"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(by_group).alias("n")))
    return ranged.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_in"))).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_group", "_in", "_shift")


def _interiors(level: int) -> Callable[[pa.Table], pa.Table]:
    """The nodes of up to SPAN levels above a block of consecutive nodes of `level`, whose first is at a multiple of 2^SPAN."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        tree, n, first, digests = rows["tree"][0].as_py(), rows["n"][0].as_py(), rows["idx"][0].as_py(), rows["digest"].to_pylist()
        left, found = -(-n >> level), []
        for step in range(1, SPAN + 1):
            if left == 1:
                break
            digests = [joined(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
            first, left = first >> 1, (left + 1) >> 1
            found += [(tree, level + step, first + i, n, d) for i, d in enumerate(digests)]
        names = ["tree", "level", "idx", "n", "digest"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def _levels(leaves: DataFrame) -> list[tuple[int, int, DataFrame]]:
    """(lowest level, highest level, nodes) of all trees of `leaves` (tree, idx, n, digest), the leaves first.

    Each round takes blocks of 2^SPAN nodes to the next SPAN levels; the driver learns only the largest tree's size.
    """
    own = leaves.select("tree", F.lit(0).alias("level"), "idx", "n", "digest")
    tables, top = [(0, 0, own)], depth(own.agg(F.max("n")).head()[0] or 0)
    current, level = own, 0
    while level < top:
        blocks = current.withColumn("block", F.shiftright("idx", SPAN)).groupBy("tree", "block")
        nodes = spool(blocks.applyInArrow(_interiors(level), NODE), "nodes")
        tables.append((level + 1, level + SPAN, nodes))
        level += SPAN
        # a tree that ended below this level has no node there
        current = nodes.where(F.col("level") == level)
    return tables


@dataclass
class Manifest:
    """leaves: (doc_id, group, tree, idx, n, trees, digest, presented); levels: the nodes of the groups' trees and of the top one."""

    leaves: DataFrame
    levels: list[tuple[int, int, DataFrame]]
    top: list[tuple[int, int, DataFrame]]

    def prove(self, wanted: Column | None = None) -> DataFrame:
        """A row for each leaf (of those `wanted`) with its proof, checked against the manifest's root.

        proof: the hex digests of its siblings from leaf to root, in one string; tree, idx and n_leaves tell on which
        side each stands. folded_root is worked out of the presented digest and the siblings, verified says whether
        it is the root. Leaves of a block of 2^SPAN places are proved together: the least set of nodes that none of
        them gives is asked for once, what they share is derived once, and each proof is expanded there.
        """
        leaves = (self.leaves if wanted is None else self.leaves.where(wanted)).withColumns({"part_tree": F.col("tree"), "part": F.shiftright("idx", SPAN)})
        keys = ["part_tree", "part"]
        asked = spool(leaves.select(*keys, "tree", "idx", "n", "trees").groupBy(*keys).applyInArrow(_missing, _ASKED), "asked")
        # at most two rows a level: which tables of nodes must be read
        levels = {(r["top"], r["level"]) for r in asked.select((F.col("tree") == TOP).alias("top"), "level").distinct().collect()}
        read = [df for top, tables in ((False, self.levels), (True, self.top)) for low, high, df in tables if any(low <= level <= high for t, level in levels if t == top)]
        fetched = asked.select(*keys, F.lit(None).cast("long").alias("tree"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(None).cast("binary").alias("digest")).where("false")
        if read:
            store = read[0]
            for more in read[1:]:
                store = store.unionByName(more)
            fetched = broadcast_if_small(asked).join(store.drop("n"), ["tree", "level", "idx"]).select(*(F.col(c).alias(c) for c in (*keys, "tree", "level", "idx", "digest")))
        return leaves.select(*keys, "doc_id", "tree", "idx", "n", "trees", "digest", "presented").groupBy(*keys).cogroup(fetched.groupBy(*keys)).applyInArrow(_proved, _PROVED)


def manifest(rows: DataFrame, id_col: str, group_col: str, digest: Column, presented: Column | None = None) -> Manifest:
    """The Merkle trees of `rows`, one for each value of `group_col` and one over their roots.

    `digest` is a row's leaf (row_digest); `presented` is the digest of what a reader was given in its place, the same if
    not stated. Groups stand in order of their bytes, null first; leaves in order of id, null first; rows that
    repeat an id are leaves of their own, in order of digest. Other columns of `rows` play no part. An empty table has an empty manifest.
    """
    own = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).alias("group"), digest.alias("digest"), (digest if presented is None else presented).alias("presented"))
    leaves = placed(own, "group", ["doc_id", "digest"])
    groups = leaves.select("group").distinct().withColumn("all", F.lit(True))
    numbered = placed(groups, "all", ["group"]).select(F.col("group").alias("of"), F.col("idx").alias("tree"), F.col("n").alias("trees"))
    leaves = spool(leaves.join(broadcast_if_small(numbered), F.col("group").eqNullSafe(F.col("of"))).drop("of"), "leaves")
    levels = _levels(leaves)
    # a tree has one node whose level leaves nothing of n - 1, and none above it
    tops = [df.where("shiftright(n - 1, level) = 0") for _, _, df in levels]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    count = leaves.select("tree", "trees").distinct()
    crowns = spool(subroots.select("tree", "digest").join(count, "tree").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "digest"), "subroots")
    return Manifest(leaves, levels, _levels(crowns))


def missing_nodes(known: Sequence[int], n: int) -> list[tuple[int, int]]:
    """(level, idx) of the fewest nodes of a tree of n leaves that, with the leaves `known`, give its root."""
    have, found = set(known), []
    level = 0
    while n > 1:
        found += [(level, i) for i in sorted({i ^ 1 for i in have if i ^ 1 < n} - have)]
        have, n, level = {i >> 1 for i in have}, (n + 1) >> 1, level + 1
    return found


def _missing(rows: pa.Table) -> pa.Table:
    """The nodes that a block of leaves must fetch for all its proofs, and its subroot and the root to compare with."""
    tree, n, trees, part = (rows[c][0].as_py() for c in ("tree", "n", "trees", "part"))
    asked = [(tree, level, i) for level, i in missing_nodes(rows["idx"].to_pylist(), n)] + [(tree, depth(n), 0)] * (n > 1)
    asked += [(TOP, level, i) for level, i in missing_nodes([tree], trees)] + [(TOP, depth(trees), 0)]
    count = len(asked)
    return pa.table(
        {
            "part_tree": pa.array([tree] * count, pa.int64()),
            "part": pa.array([part] * count, pa.int64()),
            "tree": pa.array([a[0] for a in asked], pa.int64()),
            "level": pa.array([a[1] for a in asked], pa.int32()),
            "idx": pa.array([a[2] for a in asked], pa.int64()),
        }
    )


def _derived(own: dict[int, bytes], n: int, fetched: dict[tuple[int, int], bytes]) -> list[dict[int, bytes]]:
    """All nodes that a block's proofs need, level by level: what was fetched, and what its leaves give."""
    levels, level = [], 0
    while True:
        here = {i: d for (at, i), d in fetched.items() if at == level and i < n} | own if n > 1 else dict(own)
        levels.append(here)
        if n == 1:
            return levels
        own = {p: joined(*(here[i] for i in (2 * p, 2 * p + 1) if i < n)) for p in {i >> 1 for i in own}}
        n, level = (n + 1) >> 1, level + 1


def _siblings(levels: list[dict[int, bytes]], n: int, above: str) -> dict[int, str]:
    """For each node that proofs may start from at the lowest level, its siblings up to the root, then `above`."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) >> 1)
    texts = {0: above}
    for level in range(len(levels) - 2, -1, -1):
        here, size = levels[level], sizes[level]
        texts = {i: (here[i ^ 1].hex() if i ^ 1 < size else "") + texts[i >> 1] for i in here if i >> 1 in texts and (i ^ 1 in here or i ^ 1 >= size)}
    return texts


def _folded(digest: bytes, idx: int, n: int, levels: list[dict[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for here in levels[:-1]:
        pair = [digest] if idx ^ 1 >= n else [digest, here[idx ^ 1]] if idx % 2 == 0 else [here[idx ^ 1], digest]
        digest, idx, n = joined(*pair), idx >> 1, (n + 1) >> 1
    return digest


def _proved(rows: pa.Table, nodes: pa.Table) -> pa.Table:
    """The proofs of one block of leaves."""
    tree, n, trees = (rows[c][0].as_py() for c in ("tree", "n", "trees"))
    fetched: dict[bool, dict[tuple[int, int], bytes]] = {False: {}, True: {}}
    for t, level, i, d in zip(*(nodes[c].to_pylist() for c in ("tree", "level", "idx", "digest"))):
        fetched[t == TOP][level, i] = d
    idx, digests, shown = (rows[c].to_pylist() for c in ("idx", "digest", "presented"))
    # the roots to compare with are the stored ones, never those derived here
    root = fetched[True][depth(trees), 0]
    subroot = fetched[False].get((depth(n), 0), digests[0])
    levels = _derived(dict(zip(idx, digests)), n, fetched[False])
    crown = _derived({tree: levels[-1][0]}, trees, fetched[True])
    texts = _siblings(levels, n, _siblings(crown, trees, "")[tree])
    honest = crown[-1][0]
    folds = [honest if p == d else _folded(_folded(p, i, n, levels), tree, trees, crown) for i, d, p in zip(idx, digests, shown)]
    count = len(idx)
    return pa.table(
        {
            "doc_id": rows["doc_id"],
            "leaf": [d.hex() for d in digests],
            "subroot": [subroot.hex()] * count,
            "root": [root.hex()] * count,
            "proof": [texts[i] for i in idx],
            "folded_root": [f.hex() for f in folds],
            "verified": [f == root for f in folds],
            "tree": rows["tree"],
            "idx": rows["idx"],
            "n_leaves": rows["n"],
        }
    )
