"""Conversation repair against exhaustive search, SQL and a plain string order."""

import hashlib
import itertools
import random
import re

import duckdb

from pyspark.sql import functions as F

from quillspan.llm import queries, turn_repair

COLUMNS = "conv_id long, turn long, role string, text string, bucket int, pos string, key string"


def rows(spark, found):
    return spark.createDataFrame([(*f, 1, "clash", "clash") for f in found], COLUMNS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        said = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(turns):
    """Cost, audit and text of the best repair by trying all edits, with up to two inserts in every gap."""
    found, wrong = [], faults(turns)
    for gaps in itertools.product(range(3), repeat=len(turns) + 1):
        for edits in itertools.product("DKR", repeat=len(turns)):
            cost, audit, initials, lines = 5 * sum(gaps), "", "", []
            for k in range(len(turns) + 1):
                audit += "I" * gaps[k]
                for _ in range(gaps[k]):
                    name = "assistant" if initials[-1:] == "u" else "user"
                    initials += name[0]
                    lines.append(f"{name}:")
                if k == len(turns):
                    break
                (role, text), fault, edit = turns[k], wrong[k], edits[k]
                audit += edit
                if edit == "D":
                    cost += 2
                    continue
                if fault in ("blank", "duplicate"):
                    cost = 10**9
                    break
                if edit == "R":
                    role = "assistant" if initials[-1:] == "u" else "user"
                cost += (edit == "R") + 5 * (fault == "truncated")
                initials += role[:1] or "?"  # a row without a role can't be kept
                lines.append(f"{role}:{text}")
            if cost < 10**9 and re.fullmatch("(s?(ua)+)?", initials):
                found.append((cost, audit, "\n".join(lines)))
    return min(found)


def made(seed, count, longest):
    rng = random.Random(seed)
    texts = ["fine.", "well?", "so!", "cut", "cut off ", "", " \t\n", None, "é.", " ", "one more.", "yes.\x0b"]
    found = []
    for conv in range(count):
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(1, longest)):
            found.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), rng.choice(texts)))
            turn += rng.choice([1, 1, 1, 2])
    return found


def grouped(found):
    out = {}
    for conv, turn, role, text in found:
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    return out


def ordered(turns):
    """In order of turn; the order of rows of one turn is the operator's: by role, then the digest of role and text."""
    return sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()[:16]))


def test_repairs_by_exhaustive_search(spark, monkeypatch):
    found = made(5, 60, 3)
    want = {}
    for conv, turns in grouped(found).items():
        turns = ordered(turns)
        cost, audit, text = brute([t[2:] for t in turns])
        said, initials, numbers = faults([t[2:] for t in turns]), [t[2][:1] for t in turns], [t[1] for t in turns if t[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        want[conv] = (gaps, *(said.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(text))
    for block in (10, 1):
        monkeypatch.setattr(turn_repair, "BLOCK", block)
        turns = turn_repair.conversation_rows(rows(spark, found))
        got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair_digests(turns).collect()}
        assert got == want


def test_long_conversations_in_parts_and_the_repaired_rows(spark, monkeypatch):
    rng = random.Random(9)
    found = [(c, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"{k} so.", f"{k} so.", "cut", ""])) for c in (7, None) for k in range(400)] + [(8, 1, "user", "hi."), (8, 2, "assistant", "ho.")]
    whole = {r.conv_id: tuple(r) for r in turn_repair.repair_digests(turn_repair.conversation_rows(rows(spark, found))).collect()}
    monkeypatch.setattr(turn_repair, "BLOCK", 3)
    turns = turn_repair.conversation_rows(rows(spark, found))
    assert {r.conv_id: tuple(r) for r in turn_repair.repair_digests(turns).collect()} == whole
    texts = {}
    for r in turn_repair.repaired_rows(turns).orderBy("bucket", "place").collect():
        texts.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, said in texts.items():
        assert sha("\n".join(f"{role}:{text}" for role, text in said)) == whole[conv][-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in said))


def test_the_query_by_its_sql_on_awkward_rows(spark, tmp_path):
    found = list(dict.fromkeys((c, t, r, x) for c, t, r, x in made(3, 300, 6)))
    # one row a turn: the order within a turn is the operator's own
    found = list({(c, t): (c, t, r, x) for c, t, r, x in found}.values()) + [(None, 1, "user", "a."), (None, None, None, None), (None, 3, "assistant", "b.")]
    rows(spark, found).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_turn_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(queries.OP12_SQL).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_conversations_without_rows_left(spark):
    turns = turn_repair.conversation_rows(rows(spark, [(1, 0, "user", "x."), (2, None, "user", "y.")]), F.lit(False))
    assert sorted(map(tuple, turn_repair.repair_digests(turns).collect())) == [(c, 0, 0, 0, 0, 0, 0, "", sha("")) for c in (1, 2)]
    assert turn_repair.repair_digests(turn_repair.conversation_rows(rows(spark, [])), None).collect() == []


def test_trails_compare_like_strings(monkeypatch):
    for prime in (turn_repair._PRIME, 3):  # of three hashes many collide
        monkeypatch.setattr(turn_repair, "_PRIME", prime)
        rng = random.Random(prime)
        trails = [turn_repair.Trail()]
        for _ in range(300):
            trails.append(turn_repair.Trail(rng.choice(trails[-20:]), "".join(rng.choice("DIK") for _ in range(rng.randint(0, 3)))))
        for _ in range(3000):
            a, b = rng.choice(trails), rng.choice(trails)
            assert turn_repair.precedes(a, b) == (a.text() < b.text())
        assert all(t.length == len(t.text()) for t in trails)
