"""The numbered operators against brute force, the libraries, and on awkward rows."""

import base64
import hashlib
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm import bpe, exact_dedup, line_dedup, ngram_join, packing, queries, spotsigs, token_counts, toxicity, url_filter, warc_zip
from quillspan.llm.mph import MinimalPerfectHash
from quillspan.llm.words import splitter

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("n_lines", T.IntegerType())])
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
LINE = "This very line is repeated in many documents"


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names results use."""
    rows = [(1, None), (2, ""), (3, LONG), (4, "Same Text"), (5, "same text"), (5, "same text"), (None, "same text"), (6, f"{LINE}\nfirst\n{LINE.upper()}  "), (7, f" {LINE}\n\nsecond"), (8, f"third\n{LINE}"), (9, "a b"), (10, "É a<|endoftext|>\tb  c ▁ 漢字 don't '")]
    rows += [(11, "a\r\n b\tc\t\t d   \n\n   e\r"), (12, "<|endoftext|>"), (13, "   \n  x <s></s> <unk> \n"), (14, "\ufeff\u00a0 e\u0301 \x00 z")]
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_perfect_hash_is_minimal_and_survives_a_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64))
    mph = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys).to_bytes())
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    assert len(MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys[:0]).to_bytes()).levels) == 0


def brute_lines(rows, min_docs=3, min_chars=20):
    space = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, text in rows:
        for key in {fold(x.strip(space)) for x in (text or "").split("\n")}:
            if len(key) >= min_chars:
                holders[key].add(-(10**18) if i is None else i)
    out = []
    for i, text in rows:
        own = -(10**18) if i is None else i
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (len(h := holders.get(fold(x.strip(space)), [])) >= min_docs and max(h) != own)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return Counter(out)


def test_line_dedup_by_brute_force(spark):
    lines = [(20, f"{LINE}\nof one document, in two rows"), (20, f"{LINE}\nof one document, in two rows"), (21, "of one document, in two rows"), (None, f"{LINE}\nlines without any id at all"), (None, "lines without any id at all"), (22, "lines without any id at all")]
    docs = awkward(spark).unionByName(spark.createDataFrame([(i, t, "clash", 7) for i, t in lines], DOCS))
    got = line_dedup.line_dedup(docs, carry=["id", "n_lines"])
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "id"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert line_dedup.line_dedup(empty(spark)).collect() == []


def test_line_dedup_over_many_shards_and_a_small_cache(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    monkeypatch.setattr(line_dedup, "CACHE_BYTES", 3_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(i, "\n".join(f"the line of number {k}, often" for k in range(i % 7, 300, 3))) for i in range(40)], "doc_id long, text string"))
    assert Counter(map(tuple, line_dedup.line_dedup(docs).collect())) == brute_lines([(r.doc_id, r.text) for r in docs.collect()])


def test_shard_tells_clashing_hashes_apart():
    h1, h2 = np.array([1, 1, 1, 2, 3]), np.array([10, 11, 12, 10, 13])
    shard = line_dedup.Shard(line_dedup.build_shard(h1, h2, np.arange(3, 8), np.arange(30, 35)))
    counts, keepers = shard.probe(np.array([1, 1, 1, 2, 3, 3, 4]), np.array([10, 11, 12, 10, 13, 10, 10]))
    assert counts.tolist() == [3, 4, 5, 6, 7, 0, 0] and keepers[:5].tolist() == [30, 31, 32, 33, 34]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = awkward(spark).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r.text)].append(r.doc_id)
    want = Counter()
    for r in rows:
        ids = [i for i in groups[fold(r.text)] if i is not None]
        best = (min if keep == "smallest" else max)(ids) if ids else None
        want[(r.doc_id, best, len(groups[fold(r.text)]), r.doc_id == best, sha(fold(r.text)))] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(awkward(spark), keep=keep).collect())) == want
    assert exact_dedup.exact_dedup(empty(spark)).collect() == []


def test_exact_dedup_keeps_texts_apart_whose_hashes_agree(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_hash", lambda data: bytes([len(data) % 3]) * 16)
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "ABC"), (4, "abcdef"), (5, "")], "doc_id long, text string"))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == {(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1), (5, 5, 1)}


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect())
    assert Counter(map(tuple, token_counts.token_counts(docs, path).collect())) == want
    assert token_counts.token_counts(empty(spark), path).collect() == []


def test_length_table_finds_what_it_holds_and_nothing_else(monkeypatch):
    tokens = [f" w{i}" for i in range(3000)] + ["é", "", "\n"]
    table = token_counts.LengthTable(tokens, list(range(len(tokens))))
    assert table.find([*tokens, "w1", "other"]) == {x: i for i, x in enumerate(tokens)}
    assert token_counts.LengthTable([], []).find(["a"]) == {} and table.find([]) == {}
    monkeypatch.setattr(token_counts.xxhash, "xxh3_64_intdigest", len)
    assert token_counts.LengthTable(["ab", "cd", "e"], [1, 2, 3]).find(["ab", "cd", "e", "x"]) == {"e": 3}


def test_frequent_summary_holds_every_frequent_token(spark):
    docs = spark.createDataFrame([(i, "the cat " * 20 + f"rare{i}") for i in range(300)], "doc_id long, text string")
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        found = token_counts.frequent_pre_tokens(docs, file.read(), most=8)
    assert {" the", " cat"} <= set(found) and len(found) <= 8


def test_bpe_equals_the_library_and_decodes_back(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    texts = [r.text or "" for r in docs.collect()]
    ids = [tuple(library.encode(t, add_special_tokens=False).ids) for t in texts]
    want = Counter((i, library.decode(list(i), skip_special_tokens=False)) for i in ids)
    for got in (bpe.bpe_decode(bpe.bpe_encode(docs, path), path), bpe.bpe_encode(docs, path, decoded=True)):
        assert Counter((tuple(r.ids), r.decoded) for r in got.collect()) == want
    for size in (200, 0):  # caches and slices of any size give the same
        monkeypatch.setattr(bpe, "CACHE_BYTES", size)
        monkeypatch.setattr(bpe, "SLICE", 5_000)
        own, found = bpe.ByteBpe(bpe.file_bytes(path)), []
        for _ in range(2):
            found = [tuple(np.frombuffer(x, "<u4").tolist()) for t in texts for x in own.encode([t])]
        assert found == ids
    assert bpe.bpe_encode(empty(spark), path).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [None, 999_999]), (3, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.bpe_decode(odd, path).orderBy("doc_id").collect()] == ["", "", ""]


def test_splitter_agrees_with_the_regex_module():
    import regex

    full, own = regex.compile(bpe.PATTERN).findall, splitter(bpe.PATTERN)
    for text in ("it's 12 o'clock\n\n  ok!", "Straße ²½ Ⅷ a_b", "x\x1c\x85y 　z", "'ll'LL", "¼ éa1", ""):
        assert own(text) == full(text)


def test_packing_is_gapless_tight_and_true(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).where("doc_id IS NOT NULL AND doc_id <> 5").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = packing.pack_documents(docs, path, with_ids=True).collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    held = defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.start == r.piece * 2048
        assert len(ids[r.doc_id]) > 2048 or r.length == len(ids[r.doc_id])
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= 1.01 * sum(r.length for r in got) / 2048 + 1
    assert packing.pack_documents(empty(spark), path).collect() == []


def test_packing_of_code_points_newer_than_these_tables(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = [0x1C89, *range(0xA7CB, 0xA7DD), 0x105C0, 0x105F3, 0x13460, 0x143FA, 0x16D40, 0x378, 0xE000, 0xFFFF, 0x10FFFF]
    texts = [f"ab{chr(c)}CD {chr(c)}{chr(c)} é{chr(c)}\u0301 Σ" for c in odd] + [None, "", "Repeated <|endoftext|>", "Repeated <|endoftext|>"]
    got = packing.token_pieces(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, piece string"), path, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_plan_is_best_fit_and_repeated_rows_get_their_own_slots(spark):
    plan = packing.plan_slots({6: 3, 4: 3, 3: 1, 2: 2}, 10)
    assert sum(b - a for _, a, b, _, _ in plan) == 9 and max(s + b - a for _, a, b, s, _ in plan) == 4
    items = spark.createDataFrame([(1, 5)] * 5 + [(2, 3)] * 3, "id int, length long")
    rows = packing.pack(items, capacity=10).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 8
    with pytest.raises(ValueError):
        packing.plan_slots({11: 1}, 10)


def test_spotsigs_by_brute_force(spark):
    docs = awkward(spark)
    anchors = set(spotsigs.ANCHORS)

    def signature_count(text):
        words = [w for w in re.split(r"[^\w.]+|_+", ". " + re.sub(r"[.!?;:,|\n\r]+", " . ", (text or "").lower())) if w]
        content = [(w, words[i - 1]) for i, w in enumerate(words) if w not in anchors]
        return len({(b, w, content[i + 1][0] if i + 1 < len(content) else None) for i, (w, b) in enumerate(content) if b in anchors})

    for r in docs.join(spotsigs.spot_fingerprints(docs.where("doc_id <> 5")), "doc_id").collect():
        assert len(r.signatures) == signature_count(r.text) and len(r.fingerprint) == 16 * len(r.signatures)
    near = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], []), ([1], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in near.select(spotsigs.likeness(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 1.0]
    assert [r[0] for r in near.select(spotsigs.likeness(F.col("a"), F.col("b"), 0.4)).collect()] == [0.5, 1.0, 0.0, 1.0]


def test_spotsigs_query_edits_and_tells_apart(spark):
    """Every value by brute force, from the signatures of whole texts."""
    got = {r.doc_id: r for r in queries.op6_spotsigs(spark, SF).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    texts = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 4
        texts |= {(i, "own"): text, (i, "edited"): text[: len(text) - n] + following[:n]}
    made = spark.createDataFrame([(i, kind, x) for (i, kind), x in texts.items()], "doc_id long, kind string, text string")
    sets = {(r.doc_id, r.kind): {x & (2**64 - 1) for x in r.signatures} for r in made.select("doc_id", "kind", spotsigs.signatures(F.col("text")).alias("signatures")).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, text), (j, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        r, own = got[i], sets[i, "own"]
        assert r.n_chars == len(text) and r.edited_sha256 == sha(texts[i, "edited"])
        for value, held in ((r.fingerprint, own), (r.edited_fingerprint, sets[i, "edited"])):
            assert sorted(int(value[k : k + 16], 16) for k in range(0, len(value), 16)) == sorted(held)
        assert r.near_edited == pytest.approx(jaccard(own, sets[i, "edited"])) and r.near_next == pytest.approx(jaccard(own, sets[j, "own"]))
    assert np.median([r.near_edited for r in got.values()]) > 0.45 > 0.1 > np.median([r.near_next for r in got.values()])


def test_spotsigs_rows_on_awkward_documents(spark):
    def pairs(docs):
        return spotsigs.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"], {"own": spotsigs.signatures(F.col("text"))})

    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in awkward(spark).collect()))
    want = Counter((None if i < 0 else i, sha(t[: len(t) - len(t) // 4] + f[: len(t) // 4])) for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True))
    assert Counter((r.doc_id, r.edited_sha256) for r in queries.edited_fingerprints(pairs(awkward(spark))).collect()) == want
    assert queries.edited_fingerprints(pairs(empty(spark))).collect() == []
    one = queries.edited_fingerprints(pairs(awkward(spark).where("doc_id = 9"))).collect()
    assert [(r.doc_id, r.near_next, r.near_group) for r in one] == [(9, 1.0, 9)]
    blank = queries.edited_fingerprints(pairs(awkward(spark).where("doc_id IS NULL"))).collect()
    assert [(r.doc_id, r.near_next, r.near_group) for r in blank] == [(None, 1.0, None)]


def brute_near(sets, least):
    """Pairs of ids whose sets are at least so similar, and the smallest id reachable by them."""
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    label, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return links, label


@pytest.mark.parametrize("least", [0.4, 0.55, 0.8])
def test_spotsigs_near_copies_of_a_table_by_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(spotsigs, "BLOCK", 16)  # lists of the group of near copies are dealt in parts
    monkeypatch.setattr(spotsigs, "TIERS", (4, 16, 64))
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**31), 2**31, 20)
    sets = {i: {int(x) for x in base if rng.random() < 0.9} | {int(x) for x in rng.integers(0, 1000, int(rng.integers(0, 9)))} for i in range(120)}
    sets |= {i: {int(x) for x in rng.integers(0, 60, int(rng.integers(1, 40)))} for i in range(120, 260)}
    sets |= {300: set(), 301: set(), 302: sets[200], 303: set(range(11)), 304: set(range(20))}
    rows = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, signatures array<long>").repartition(5)
    links, label = brute_near(sets, least)
    keyed = spotsigs.set_rows(rows)
    held = {r.row_no: r for r in keyed.collect()}
    got = [frozenset(frozenset(held[x].signatures) for x in (r.a, r.b)) for r in spotsigs.near_pairs(keyed, least).collect()]
    assert len(got) == len(set(got)) and set(got) == {frozenset((frozenset(sets[a]), frozenset(sets[b]))) for a, b in links if sets[a] != sets[b]}
    assert {held[r.row_no].id: r.near_group for r in spotsigs.near_groups(keyed, least).collect()} == label
    assert spotsigs.near_groups(spotsigs.set_rows(rows.limit(0)), least).collect() == []


def test_spotsigs_query_finds_near_copies_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: set(r.signatures) for r in spotsigs.spot_fingerprints(docs).collect()}
    assert {r.doc_id: r.near_group for r in queries.op6_spotsigs(spark, SF).collect()} == brute_near(sets, spotsigs.LEAST)[1]


def test_next_rows_wrap_around(spark):
    docs = spark.range(0, 700, 7).withColumn("value", F.col("id") * 2)
    rows = {r.id: r.following.value // 2 for r in spotsigs.with_next(docs, "id", ["value"]).collect()}
    ids = sorted(rows)
    assert len(ids) == 100 and [rows[i] for i in ids] == ids[1:] + ids[:1]
    named = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4)], "id string, value int")
    assert sorted((r.id or "", r.value, r.following.value) for r in spotsigs.with_next(named, "id", ["value"]).collect()) == [("", 3, 2), ("a", 2, 1), ("b", 1, 4), ("b", 4, 3)]


def test_url_rules(spark):
    urls = ["http://a.example.org/es/1", "http://EXAMPLE.org/en/15?x#y", "http://x.com/fr/", "http://x.com/de/9#t", "http://casino.net", "http://x.org", None, "no scheme", "ftp://notcom/fr/", "http://m.cheap-pills.net/a?b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_filter.host_rule(*r) for r in queries.PAGE_RULES]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2][2:] == ("com/fr/", "allow") and got[3][2:] == ("com/de/", "block") and got[4][2:] == (None, "block")
    assert got[5] == ("x.org", "", None, "allow") and got[6] == got[7] == ("", "", None, "allow") and got[8][2] is None and got[9][3] == "block"
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


def test_url_index_loses_no_default_rule(spark):
    """Every default rule against every url, one by one, on urls made of what the rules look for; long, repeated and clashing rows too."""
    parts = [*url_filter.SPAM_WORDS, *url_filter.AD_LABELS, *url_filter.DARK_ENDS, *url_filter.PRIVATE_DIRECTORIES, *url_filter.BINARY_ENDINGS, "12.3.4.5", "ok", "Ads", "CGI-BIN", "x.EXE", "adsx", "é", "ſpam", "CAſINO", "\u212aPILLS", "spam\u0130", "SPAM\u0307", "casıno", "\u212a.exe"]
    rng = np.random.default_rng(2)
    pick = lambda: parts[rng.integers(len(parts))]
    urls = [f"http://{pick()}.{pick()}/{pick()}/{pick()}" for _ in range(300)] + [f"http://a.net/{p}" for p in parts] + [f"http://{p}/" for p in parts] + ["http://b.net/" + "x/" * 200_000 + "a.exe", "http://b.net/a.exe\n"] + ["http://click.me.com/"] * 3
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")

    def judged(url):
        whole = "".join(url_filter.split_url(url))
        return "block" if any(re.search(r.pattern.replace(r"\z", r"\Z"), whole) for r in url_filter.DEFAULT_RULES) else "allow"

    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {i: judged(u) for i, u in enumerate(urls)}


def test_toxicity_learns_and_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    true = sum(r.predicted == 1 and r.toxic == 1 for r in scored)
    assert sum(r.predicted == 1 and r.toxic == 0 for r in scored) <= 2 and true >= 0.6 * sum(r.toxic for r in scored)


def test_toxicity_features_by_hand():
    classes = toxicity.TokenClasses(frozenset(["gloop", "snor*"]))
    found = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! a GLOOP, 1d10t and a snored xx-yy haaaa", classes), strict=True))
    assert found["seed_density"] == pytest.approx(100 * 2 / 10) and found["learned_density"] == pytest.approx(100 * 2 / 10)
    assert found["hits"] == pytest.approx(np.log1p(4)) and found["distinct_hits"] == 4
    assert found["near_second_person"] == pytest.approx(100 * 3 / 10) and found["shouting"] == pytest.approx(100 * 2 / 10)
    assert found["exclaiming"] == pytest.approx(10) and found["punctuation"] == pytest.approx(20) and found["repeating"] == 1
    assert found["disguised"] == pytest.approx(10) and found["words"] == pytest.approx(np.log1p(10))
    assert toxicity.features("", classes) == [0.0] * len(toxicity.FEATURES)


def test_toxicity_on_an_empty_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    assert model.score(docs.limit(0)).collect() == [] and model.score(docs.limit(3), carry=["score", "text"] if "score" in docs.columns else ["text"]).columns == ["doc_id", "score", "text"]


def test_toxicity_on_awkward_rows_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(awkward(spark), none).collect()} == {0.0}
    features = {r.doc_id: r.features for r in toxicity.feature_rows(awkward(spark), []).collect()}
    assert len(features[3]) == len(toxicity.FEATURES) and features[1] == features[2]
    classes = toxicity.TokenClasses(frozenset())
    assert classes["1d10t!"] & toxicity.SEED and classes["stuuupid"] & toxicity.SEED and not classes["gentle"] & toxicity.SEED


def brute_components(rows, words, numer, denom):
    sets = {}
    for i, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", fold(text)) if x]
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and denom * len(sets[a] & sets[b]) >= numer * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_ngram_components_of_repeated_ids(spark):
    text = lambda own, *odd: " ".join([f"{own}{k}" for k in range(80)] + list(odd))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (7, text("b", "x")), (9, text("c")), (9, text("d")), (9, text("d")), (11, text("d", "y")), (8, text("c", "z")), (20, text("e")), (20, None), (21, text("e")), (None, text("e"))]
    rows += [(30, text("f"))] * 40 + [(31, text("f", "q")), (30, text("g")), (29, text("g", "r"))]
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    own = {3: 3, 5: 3, 7: 3, 8: 8, 9: 8, 11: 8, 20: 20, 21: 20, 29: 29, 30: 29, 31: 29, None: None}
    assert got == Counter((i, own[i]) for i, _ in rows)


@pytest.mark.parametrize(("words", "numer"), [(3, 90), (5, 80)])
def test_ngram_components_by_brute_force(spark, words, numer):
    rng = np.random.default_rng(3)
    rows, base = [], [f"t{i}" for i in range(120)]
    for i in range(160):
        # copies of one text with up to eight words changed, so that chains of links arise, and some of their own
        own = list(base) if i % 4 else [f"u{i}_{k}" for k in range(int(rng.integers(1, 40)))]
        for at in rng.integers(0, len(own), int(rng.integers(0, 9))):
            own[at] = f"e{rng.integers(0, 30)}"
        rows.append((i, " ".join(own)))
    rows += [(500, None), (501, ""), (502, "One  two"), (503, "one TWO"), (504, LONG), (505, LONG + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, words=words, numer=numer).collect()}
    assert got == brute_components(rows, words, numer, 100)


def test_ngram_blocks_give_the_same(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(60)) + f" x{i % 50} y{i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    monkeypatch.setattr(ngram_join, "CHUNK", 2)
    monkeypatch.setattr(ngram_join, "HUB", 8)
    monkeypatch.setattr(ngram_join, "FILTER_NODES", 10)
    monkeypatch.setattr(ngram_join, "HOT_DF", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, words=3, numer=90).collect()}
    assert got == brute_components(rows, 3, 90, 100)


def test_ngram_groups_collapse_members_and_pairs_of_groups_are_few(spark):
    """60 sets in two groups that share their prefixes but for one member: one pair of groups stands for 900 pairs of sets."""
    rng = np.random.default_rng(4)
    prefix = np.sort(rng.integers(1, 2**40, 11))
    rows = []
    for i in range(60):
        head = prefix if i < 30 else np.concatenate(([0], prefix[1:]))
        own = np.concatenate((head, 2**40 + np.arange(88), [2**50 + i])).astype(np.uint64)
        bits = np.frombuffer(ngram_join.sketch(own, ngram_join.SKETCH_BITS), np.int64).tolist()
        rows.append((i, 100, bytes([i // 30]) * 16, head.astype(np.int64).tobytes(), *bits))
    classes = spark.createDataFrame(rows, "node long, n long, group_key binary, prefix binary, " + ", ".join(f"s{k} long" for k in range(8)))
    groups, members = ngram_join.grouped(classes)
    assert sorted((r.gid, r["size"], r.last) for r in groups.collect()) == [(0, 30, 29), (30, 30, 59)] and members.where("gid = 0").count() == 30
    pairs = ngram_join._candidates(ngram_join._postings(groups), groups, None, 90, 100, True, 1, 4).select("a", "b").distinct()
    assert pairs.count() == 1
    own = members.withColumn("component", F.col("node"))
    few = ngram_join._expanded(pairs, own, 90, 100, False, 1).collect()
    assert 59 <= len(few) <= 2 * 60 * ngram_join.BEST and {x for r in few for x in r} == set(range(60))
    assert ngram_join._expanded(pairs, own, 90, 100, True, 3).count() == 60 * 59 // 2
    assert ngram_join._expanded(pairs, own.withColumn("component", F.lit(0)), 90, 100, True, 3).count() == 0


def test_ngram_on_awkward_rows(spark):
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.ngram_components(awkward(spark)).collect())
    assert got[(None, None)] == 1 and got[(5, 4)] == 2 and got[(1, 1)] == got[(2, 2)] == 1
    assert ngram_join.ngram_components(empty(spark)).collect() == []


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_archives(spark, zip64):
    import io
    import zipfile

    rows = [(3, "http://a/", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b/ c", None), (4, "x", ""), (5, "y", "z" * 300_000), (None, "n", "only"), (6, "w", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    archives = warc_zip.write_archives(pages, folder, zip64=zip64)
    got = {r.id: r for r in warc_zip.read_records(warc_zip.archive_index(spark, archives)).collect()}
    assert len(got) == 7
    for i, _, html in rows:
        payload = (html or "").encode()
        assert got[i].payload_bytes == len(payload) and got[i].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert {i: r.refers_to for i, r in got.items()} == {1: None, 2: None, 3: 1, 4: 2, 5: None, 6: None, None: 6}
    assert bytes(got[5].payload) == b"z" * 300_000 and got[3].payload is None and got[3].record_type == "revisit"
    for r in archives.collect():
        store, path = pafs.FileSystem.from_uri(r.path)
        with store.open_input_file(path) as file:
            assert zipfile.ZipFile(io.BytesIO(file.read())).testzip() is None
    assert warc_zip.warc_round_trip(pages.limit(0)).collect() == []
    few = warc_zip.write_archives(pages, folder, min_revisit_bytes=5)
    kinds = {r.id: r.record_type for r in warc_zip.read_records(warc_zip.archive_index(spark, few)).collect()}
    assert kinds[4] == kinds[6] == "response" and kinds[3] == "revisit"
