"""Cheapest repair of conversations' turns, with an audit of the edits.

A conversation's rows, in order of turn, are kept, given another role, deleted or preceded by inserted ones so that their
role initials read `(s?(ua)+)?`. Costs: keep 0, rerole 1, delete 2, insert 5; a truncated row that stays 5 more. Blank rows
and duplicates have to go; a row whose role has no initial of these, or is empty, can't be kept. The audit is the edits' initials in order; of equally cheap ones the least in ASCII wins.

The audits of the dynamic programme are persistent: each is a node that points to the one it prolongs, with
ancestors at distances of powers of two and a rolling hash. Of two equally cheap ones the longest common prefix
is searched by hash and confirmed character by character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm._common import ASCII_SPACE, shuffle_partitions, spool

#: Rows of one task's unit of work are 2^BLOCK consecutive rows of a range, whole conversations or parts of a long one.
BLOCK = 10

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row kept leads, by state and role initial; where an inserted or reroled one leads, by state; what it is called.
KEPT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FORCED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")

_CHUNK = (
    "conv_id long, bucket long, rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
    "turns long, first_turn long, last_turn long, came array<int>, left array<int>, costs array<long>, audits array<string>"
)
_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PLAN = "conv_id long, bucket long, came int, piece string, chunks long, " + ", ".join(f"{f} long" for f in _FIGURES) + ", audit string"
_DRAWN = _PLAN + ", repaired_sha256 string, drawn string"
_REPAIRED = "conv_id long, " + ", ".join(f"{f} long" for f in _FIGURES) + ", audit string, repaired_sha256 string"
_ROWS = "conv_id long, bucket long, place long, edit string, role string, text string"

_BASE, _PRIME = 911_382_323, (1 << 61) - 1


class Trail:
    """A persistent string: the string of `parent` followed by `piece`."""

    __slots__ = ("parent", "piece", "state", "length", "depth", "code", "up")

    def __init__(self, parent: Trail | None = None, piece: str = "", state: int = BEGIN):
        self.parent, self.piece, self.state = parent, piece, state
        self.length, self.depth, self.code, self.up = 0, 0, 0, []
        if parent is not None:
            self.length, self.depth = parent.length + len(piece), parent.depth + 1
            self.code = rolled(parent.code, piece)
            up, k = [parent], 0
            while k < len(up[k].up):
                up.append(up[k].up[k])
                k += 1
            self.up = up

    def nodes(self, since: Trail | None = None) -> list[Trail]:
        """The nodes after `since` (an ancestor), first to last."""
        found, node = [], self
        while node is not since and node.parent is not None:
            found.append(node)
            node = node.parent
        return found[::-1]

    def text(self, since: Trail | None = None) -> str:
        return "".join(n.piece for n in self.nodes(since))

    def over(self, at: int) -> Trail:
        """The first node of this string that reaches beyond `at`, which is less than its length."""
        node = self
        while node.parent is not None and node.parent.length > at:
            node = next((a for a in reversed(node.up) if a.length > at), node.parent)
        return node

    def code_at(self, at: int) -> int:
        """The rolling hash of the first `at` characters."""
        if at >= self.length:
            return self.code
        node = self.over(at)
        return rolled(node.parent.code, node.piece[: at - node.parent.length])

    def letter(self, at: int) -> str:
        node = self.over(at)
        return node.piece[at - node.parent.length]


def rolled(code: int, piece: str) -> int:
    for ch in piece:
        code = (code * _BASE + ord(ch)) % _PRIME
    return code


def meeting(a: Trail, b: Trail) -> Trail:
    """The last node that two strings of one root share, by their ancestors."""
    if a.depth < b.depth:
        a, b = b, a
    while a.depth > b.depth:
        a = a.up[(a.depth - b.depth).bit_length() - 1]
    while a is not b:
        jump = next((k for k in range(len(a.up) - 1, -1, -1) if a.up[k] is not b.up[k]), None)
        if jump is None:
            return a.parent
        a, b = a.up[jump], b.up[jump]
    return a


def precedes(a: Trail, b: Trail) -> bool:
    """Whether string a is less than b: their longest common prefix is searched by hash, then confirmed."""
    shared, end = meeting(a, b), min(a.length, b.length)
    low, high = shared.length, end
    while low < high:
        middle = (low + high + 1) // 2
        if a.code_at(middle) == b.code_at(middle):
            low = middle
        else:
            high = middle - 1
    if low > shared.length:
        x, y = (t.text(shared)[: low - shared.length] for t in (a, b))
        if x != y:  # the hashes collide: the characters decide
            return x < y
    if low == end:
        return a.length < b.length
    return a.letter(low) < b.letter(low)


Front = dict[int, tuple[int, Trail]]


def better(front: Front, state: int, cost: int, parent: Trail, piece: str, came: int) -> None:
    """Put (cost, parent + piece) at `state` if nothing as good is there."""
    known = front.get(state)
    if known is None or cost < known[0]:
        front[state] = (cost, Trail(parent, piece, came))
    elif cost == known[0]:
        node = Trail(parent, piece, came)
        if precedes(node, known[1]):
            front[state] = (cost, node)


def with_inserts(front: Front) -> Front:
    """What insertions reach from here; more than two in a row never pay."""
    front = dict(front)
    for _ in range(2):
        for state, (cost, trail) in list(front.items()):
            better(front, FORCED[state], cost + INSERT_COST, trail, INSERT, state)
    return front


def after_row(front: Front, initial: str, must_go: bool, truncated: bool) -> Front:
    """The best audits after one more row."""
    found: Front = {}
    extra = TRUNCATED_COST if truncated else 0
    for state, (cost, trail) in with_inserts(front).items():
        better(found, state, cost + DELETE_COST, trail, DELETE, state)
        if not must_go:
            better(found, FORCED[state], cost + REROLE_COST + extra, trail, REROLE, state)
            if (state, initial) in KEPT:
                better(found, KEPT[state, initial], cost + extra, trail, KEEP, state)
    return found


def conversation_rows(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, present, blank, truncated, key, pos, bucket) of `rows` in their order, spooled.

    Rows stand in order of conversation and turn, nulls first, then of role and text; rows equal in all of it may stand either
    way, unless a column `copy` says how. Nulls in role and text count as one space. They go to ranges of that order, so a
    long conversation has many. Rows not `present` only name their conversation.
    """
    blank = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (F.col("copy") if "copy" in rows.columns else F.lit(0)).cast("int").alias("copy"),
        (F.col("tie") if "tie" in rows.columns else F.monotonically_increasing_id()).alias("tie"),
        F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"),
    )
    rows = rows.withColumn("key", F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16))
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("key"), F.asc("tie"), F.asc("copy")]
    ranged = rows.repartitionByRange(2 * shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    trimmed = F.rtrim("text", F.lit(ASCII_SPACE))
    marked = ranged.select("conv_id", "turn", "role", "text", "present", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "key", F.monotonically_increasing_id().alias("pos"))
    return spool(marked.withColumn("bucket", F.shiftright("pos", BLOCK)), "turns", "zstd")


def _parts(rows: pa.Table, column: str = "conv_id") -> Iterator[tuple[int | None, pa.Table]]:
    """Runs of equal values, in the order of the rows."""
    ids, start = rows[column].to_pylist(), 0
    for at in range(1, len(ids) + 1):
        if at == len(ids) or ids[at] != ids[start]:
            yield ids[start], rows.slice(start, at - start)
            start = at


def _chunks(rows: pa.Table, firsts: pa.Table) -> pa.Table:
    """For each conversation in a block: its faults, and the best audit from each state it may be come to in to each other."""
    rows, first = rows.sort_by("pos"), set(firsts["pos"].to_pylist())
    found = []
    for k, (conv, part) in enumerate(_parts(rows)):
        counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        # only a block's first conversation may have begun before
        fronts: list[Front] = [{p: (0, Trail())} for p in ((BEGIN, SYSTEM, USER, ASSISTANT) if k == 0 else (BEGIN,))]
        begun, initials, turns = [min(f) for f in fronts], [], []
        columns = (part[c].to_pylist() for c in ("pos", "turn", "initial", "present", "blank", "truncated"))
        for pos, turn, initial, present, blank, truncated in zip(*columns):
            if not present:
                continue
            fault = "blank" if blank else "duplicate" if pos not in first else "truncated" if truncated else None
            if fault:
                counts[fault] += 1
            counts["illegal"] += bool(initials) and initials[-1] + initial not in LEGAL
            initials.append(initial)
            if turn is not None:
                turns.append(turn)
            fronts = [after_row(f, initial, fault in ("blank", "duplicate"), fault == "truncated") for f in fronts]
        ends = [(p, q, cost, trail.text()) for p, f in zip(begun, fronts) for q, (cost, trail) in sorted(f.items())]
        found.append(
            {
                "conv_id": conv,
                "bucket": rows["bucket"][0].as_py(),
                "rows": len(initials),
                **counts,
                "first_initial": initials[0] if initials else None,
                "last_initial": initials[-1] if initials else None,
                "turns": len(set(turns)),
                "first_turn": turns[0] if turns else None,
                "last_turn": turns[-1] if turns else None,
                **{name: [e[i] for e in ends] for i, name in enumerate(("came", "left", "costs", "audits"))},
            }
        )
    kinds = {"first_initial": pa.string(), "last_initial": pa.string(), "came": pa.list_(pa.int32()), "left": pa.list_(pa.int32()), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
    return pa.table({name: pa.array([f[name] for f in found], kinds.get(name, pa.int64())) for name in found[0]})


class _Conversation:
    """The chunks of one conversation, taken in as they come."""

    def __init__(self, conv: int | None):
        self.conv, self.front, self.buckets = conv, {BEGIN: (0, Trail())}, []
        self.sums = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.initial = self.low = self.high = None
        self.turns = 0

    def add(self, chunk: dict) -> None:
        self.buckets.append(chunk["bucket"])
        for name in self.sums:
            self.sums[name] += chunk[name]
        if chunk["rows"]:
            self.sums["illegal"] += self.initial is not None and self.initial + chunk["first_initial"] not in LEGAL
            self.initial = chunk["last_initial"]
        if chunk["turns"]:
            self.turns += chunk["turns"] - (self.high == chunk["first_turn"])
            self.low = chunk["first_turn"] if self.low is None else self.low
            self.high = chunk["last_turn"]
        found: Front = {}
        for came, left, cost, audit in zip(*(chunk[c] for c in ("came", "left", "costs", "audits"))):
            if came in self.front:
                known, trail = self.front[came]
                better(found, left, known + cost, trail, audit, came)
        self.front = found

    def plan(self) -> Iterator[tuple]:
        """A row for each chunk; the last has what inserts follow, and the figures."""
        ends: Front = {}
        for state, (cost, trail) in with_inserts(self.front).items():
            if state in (BEGIN, ASSISTANT):
                better(ends, 0, cost, trail, "", state)
        cost, trail = ends[0]
        nodes, count = trail.nodes(), len(self.buckets)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        for k, bucket in enumerate(self.buckets):
            last = k + 1 == count
            piece = nodes[k].piece if not last else "".join(n.piece for n in nodes[k:])
            figures = (gaps, *self.sums.values(), cost, trail.text()) if last else (None,) * 7
            yield (self.conv, bucket, nodes[k].state, piece, count, *figures)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of conversation and place, as one stream; a conversation's audits are all that stays of it."""
    current: _Conversation | None = None
    for batch in batches:
        out = []
        for chunk in batch.to_pylist():
            if current is None or chunk["conv_id"] != current.conv:
                if current is not None:
                    out += current.plan()
                current = _Conversation(chunk["conv_id"])
            current.add(chunk)
        if out:
            yield _table(out, _PLAN)
    if current is not None:
        yield _table(list(current.plan()), _PLAN)


def repair_plan(turns: DataFrame) -> DataFrame:
    """(conv_id, bucket, came, piece, chunks, figures, audit) of `turns` (conversation_rows): what is done to each chunk; spooled.

    A row is a duplicate where another of its conversation, role and text has a smaller place; these places are found
    by an aggregation that combines before its shuffle and are sent to the blocks. Blocks work alone, also those of one conversation: each
    gives the best audit between any two states, and these, not rows, are put together in order.
    """
    firsts = turns.where("present").groupBy("conv_id", "key").agg(F.min("pos").alias("pos")).select("pos", F.shiftright("pos", BLOCK).alias("bucket"))
    facts = turns.select("bucket", "pos", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "present", "blank", "truncated")
    chunks = facts.groupBy("bucket").cogroup(firsts.groupBy("bucket")).applyInArrow(_chunks, _CHUNK)
    ordered = chunks.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "bucket")
    return spool(ordered.mapInArrow(_composed, _PLAN), "plan")


def _edited(rows: pa.Table, came: int, piece: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what a chunk's rows become; deleted ones have no place."""
    state, row = came, zip(rows["role"].to_pylist(), rows["text"].to_pylist())
    for edit in piece:
        if edit == INSERT:
            state = FORCED[state]
            yield edit, NAMES[state], ""
            continue
        role, text = next(row)
        if edit == DELETE:
            continue
        if edit == REROLE:
            state = FORCED[state]
            role = NAMES[state]
        else:
            state = KEPT[state, role[0]]
        yield edit, role, text


def _with_plans(rows: pa.Table, plans: pa.Table) -> Iterator[tuple[dict, pa.Table]]:
    known = {p["conv_id"]: p for p in plans.to_pylist()}
    rows = rows.sort_by("pos")
    for conv, part in _parts(rows):
        yield known[conv], part.filter(part["present"])


def _drawn(rows: pa.Table, plans: pa.Table) -> pa.Table:
    """The digest of each conversation that is whole in its block, and the text of a part of a longer one."""
    out = []
    for plan, part in _with_plans(rows, plans):
        text = "\n".join(f"{role}:{said}" for _, role, said in _edited(part, plan["came"], plan["piece"]))
        whole = plan["chunks"] == 1
        out.append((*plan.values(), sha256(text.encode()).hexdigest() if whole else None, None if whole else text))
    return pa.Table.from_batches([_table(out, _DRAWN)])


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations in order, as one stream, each into its conversation's digest."""
    digest, begun = sha256(), False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["drawn"]:
                digest.update((("\n" if begun else "") + row["drawn"]).encode())
                begun = True
            if row["audit"] is not None:
                out.append((row["conv_id"], *(row[f] for f in _FIGURES), row["audit"], row["repaired_sha256"] or digest.hexdigest()))
                digest, begun = sha256(), False
        if out:
            yield _table(out, _REPAIRED)


def repair_digests(turns: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """A row for each conversation: its gaps and faults, the cheapest repair's cost and audit, and the digest of the repaired text.

    The text is `role:text` of each row, joined by newlines. The digest of a conversation of several blocks is the one
    thing that has to see its text in order: it is read as a stream of blocks' texts, which are drawn apart.
    """
    drawn = _by_block(turns, plan).applyInArrow(_drawn, _DRAWN)
    ordered = drawn.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "bucket")
    return ordered.mapInArrow(_digested, _REPAIRED)


def repaired_rows(turns: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The repaired conversations' rows: conv_id, bucket and place (their order), edit (kept, reroled or inserted), role, text."""

    def run(rows: pa.Table, plans: pa.Table) -> pa.Table:
        out = []
        for p, part in _with_plans(rows, plans):
            out += [(p["conv_id"], p["bucket"], k, *edited) for k, edited in enumerate(_edited(part, p["came"], p["piece"]))]
        return pa.Table.from_batches([_table(out, _ROWS)])

    return _by_block(turns, plan).applyInArrow(run, _ROWS)


def _by_block(turns: DataFrame, plan: DataFrame | None):
    plan = repair_plan(turns) if plan is None else plan
    return turns.select("bucket", "pos", "conv_id", "role", "text", "present").groupBy("bucket").cogroup(plan.groupBy("bucket"))
