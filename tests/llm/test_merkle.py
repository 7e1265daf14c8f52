"""The Merkle manifest against a plain recomputation."""

import hashlib
import random

from pyspark.sql import functions as F

from quillspan.llm import merkle, queries

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, part string"
SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    fields = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def siblings_and_root(digests, at):
    out = []
    while len(digests) > 1:
        if (at ^ 1) < len(digests):
            out.append(digests[at ^ 1])
        digests, at = [h(*digests[i : i + 2]) for i in range(0, len(digests), 2)], at // 2
    return out, digests[0]


def brute(rows):
    """doc_id, leaf, subroot, root, proof of each row."""
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for lang in langs]
    subroots = [siblings_and_root([leaf_of(r) for r in t], 0)[1] for t in trees]
    out = []
    for k, tree in enumerate(trees):
        leaves = [leaf_of(r) for r in tree]
        above, root = siblings_and_root(subroots, k)
        for i, r in enumerate(tree):
            out.append((r["doc_id"], leaves[i], subroots[k], root, "".join(siblings_and_root(leaves, i)[0] + above)))
    return sorted(out, key=repr)


def rows(spark, count, langs, seed=1):
    rng = random.Random(seed)
    made = [(i, rng.choice(["web", None]), rng.choice(langs), rng.choice([None, 5, -1]), rng.choice([None, "", "é漢", f"text {i}", "x" * 200_000])) for i in rng.sample(range(10 * count), count)]
    made += [made[0]] * 3 + [(None, "web", langs[0], 1, "no id"), (None, None, langs[0], None, None), (made[0][0], "other", made[0][2], 1, "same id")]
    return spark.createDataFrame([(*m, "clash", 7, "clash") for m in made], COLUMNS)


def proved(docs):
    digest = merkle.row_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return merkle.manifest(docs, "doc_id", "lang", digest)


def test_proofs_by_brute_force(spark, monkeypatch):
    for span, count, langs in ((2, 60, ["en", "de", None, "", "é", "zz"]), (10, 40, ["en", None])):
        monkeypatch.setattr(merkle, "SPAN", span)
        docs = rows(spark, count, langs, span)
        got = proved(docs).prove().collect()
        assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=repr) == brute([r.asDict() for r in docs.collect()])
        assert all(r.verified and r.folded_root == r.root for r in got)


def test_proofs_of_some_leaves_and_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 3)
    docs = rows(spark, 70, ["en", "de", "fr"])
    want = [w for w in brute([r.asDict() for r in docs.collect()]) if w[0] is not None and w[0] % 5 == 0]
    got = proved(docs).prove(F.col("doc_id") % 5 == 0).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=repr) == want and all(r.verified for r in got)
    (alone,) = proved(docs.limit(1)).prove().collect()
    assert alone.proof == "" and alone.leaf == alone.subroot == alone.root == alone.folded_root


def test_the_fewest_missing_nodes(spark):
    assert merkle.missing_nodes([0, 1, 2, 3], 4) == [] and merkle.missing_nodes([0, 1], 4) == [(1, 1)]
    assert merkle.missing_nodes([4], 5) == [(2, 0)] and merkle.missing_nodes([0, 3], 5) == [(0, 1), (0, 2), (2, 1)]
    assert merkle.missing_nodes([0], 1) == []


def test_tampered_rows_are_found(spark, tmp_path):
    docs = rows(spark, 50, ["en", "de"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op11_merkle(spark, str(tmp_path)).collect():
        import zlib

        assert r.verified == (r.folded_root == r.root)
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7:
            assert r.verified
    changed = {r.doc_id for r in docs.where("n_chars IS NOT NULL AND crc32(CAST(doc_id AS string)) % 7 = 0").collect()}
    got = {r.doc_id for r in queries.op11_merkle(spark, str(tmp_path)).where("NOT verified").collect()}
    assert changed and got == changed


def test_a_changed_store_is_found(spark):
    found = proved(rows(spark, 20, ["en"]))
    low, high, nodes = found.levels[1]
    forged = nodes.withColumn("digest", F.when((F.col("level") == 1) & (F.col("idx") == 0), F.unhex(F.sha2(F.lit("x"), 256))).otherwise(F.col("digest")))
    some = merkle.Manifest(found.leaves, [found.levels[0], (low, high, forged)], found.top).prove(F.col("idx").isin(2, 3))
    assert [r.verified for r in some.collect()] == [False, False]


def test_an_empty_table(spark):
    assert proved(spark.createDataFrame([], COLUMNS)).prove().collect() == []
