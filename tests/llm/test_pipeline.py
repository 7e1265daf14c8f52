"""The corpus pipeline's stages, each on its own input."""

from collections import Counter

import corpus_pipeline as P
from test_llm_operators import LINE, LONG, brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], COLUMNS)


def test_stages_keep_their_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    clean = [(i, f"plain words about garden number {i} and the river of town") for i in range(30)]
    toxic = [(100 + i, f"you are an idiot and a pathetic loser, what a worthless moron {i}") for i in range(5)]
    kept = {r.doc_id for r in P.drop_toxic(spark, documents(spark, clean + toxic + [(7000, None), (None, "")]), sf).collect()}
    assert kept == {i for i, _ in clean} | {7000, None}


def test_repeated_lines_go(spark):
    rows = [(1, f"{LINE}\na"), (2, f"b\n{LINE}"), (3, LINE), (4, None), (None, "x")]
    got = {r.doc_id: (r.text, r.n_chars) for r in P.drop_repeated_lines(spark, documents(spark, rows), SF).collect()}
    assert got == {1: ("a", 1), 2: ("b", 1), 3: (LINE, len(LINE)), 4: ("", 0), None: ("x", 1)}


def test_one_of_each_group_stays(spark):
    rows = [(i, " ".join(f"w{k + i // 10 * 1000}" for k in range(100)) + f" e{i}") for i in range(40)] + [(90, None), (91, LONG)]
    want = brute_components(rows, 5, 80, 100)
    got = Counter(r.doc_id for r in P.drop_near_copies(spark, documents(spark, [*rows, (None, "no id")]), SF).collect())
    assert got == Counter([i for i, (_, c) in want.items() if c == i] + [None])


def test_run_packs_what_is_left(spark):
    rows = P.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    assert P.STAGES[-1][1](spark, documents(spark, []), SF).collect() == []
