"""Text functions, store and chunking on small literal tables."""

import tempfile

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import chunking as C
from quillspan.sources import store as S


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.select(expression).first()[0]


def test_names_and_labels(spark):
    assert one(spark, T.canon("x"), x=" Graph \t Theory ") == "graph theory"
    assert one(spark, T.make_key("topic", "x"), x="Graph  theory") == "topic:591566947860"
    assert one(spark, T.make_key("topic", "x"), x="  ") is None
    assert one(spark, T.norm_label("x"), x=" Leads-To! ") == "leads_to" and one(spark, T.norm_label("x"), x="?") == "related_to"


def test_routing(spark):
    rows = {"": "none", "Why does it rain": "graph", "What is the effect on trees": "graph", "what is rain": "dense", "Hello there": "none", "rain snow": "none", "rain snow hail storms": None}
    frame = spark.createDataFrame(list(rows.items()), "q string, want string")
    assert all(r.got == r.want for r in frame.withColumn("got", T.route_heuristic("q")).collect())
    assert one(spark, T.route("q"), q="rain snow hail storms") == "dense"
    modes = {'"graph".': "graph", "it is none": "none", "dense or graph": "graph", "zzz": "dense"}
    assert [one(spark, T.parse_mode("m"), m=m) for m in modes] == list(modes.values())


def test_model_output(spark):
    raws = {'```json\n[{"a": 1}, 2, {"b": 2}]\n```': 2, '{"topics": [{"a": 1}]}': 1, '{"a": 1}': 1, "nonsense": 0, "[]": 0, "3": 0}
    frame = spark.createDataFrame(list(raws.items()), "raw string, n int")
    assert all(r.got == r.n for r in frame.withColumn("got", F.size(T.parse_items("raw"))).collect())
    truths = {'"false"': True, '""': False, "0": False, "2.5": True, "null": False, "true": True, "[]": False, "[0]": True, "{}": False}
    frame = spark.createDataFrame(list(truths.items()), "raw string, want boolean").withColumn("got", T.truthy(F.parse_json("raw")))
    assert all(r.got == r.want for r in frame.collect())


def test_times_and_terms(spark):
    assert [one(spark, T.to_seconds("t"), t=t) for t in ("1:05", "1:00:01", "x:1", "7")] == [65, 3601, None, None]
    assert one(spark, T.clock(F.lit(125.9))) == "2:05"
    assert one(spark, T.clean_terms("t"), t=[" A", "a", "", "B "]) == ["A", "B"]
    assert one(spark, T.illustration("k", "h"), k="poem", h="x") is None and one(spark, T.illustration("k", "h"), k=" Code", h=" x ") == ("code", "x")


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", "s1", "old", 1), ("b", "s2", "old", 2)], "chunk_id string, source_id string, text string, seq long")
    new = spark.createDataFrame([("b", "s2", "first", 3), ("b", "s2", "last", 4), ("c", "s2", "new", 5)], old.schema)
    got = {r.chunk_id: r.text for r in S.upsert(old, new).collect()}
    assert got == {"a": "old", "b": "last", "c": "new"}
    kept, removed = S.delete_source(old, spark.createDataFrame([("s1",), ("zz",)], "source_id string"))
    assert [r.chunk_id for r in kept.collect()] == ["b"] and {r.source_id: r.removed for r in removed.collect()} == {"s1": 1, "zz": 0}
    assert S.clear(old).count() == 0


def test_round_trips_and_discovery(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    nodes = spark.createDataFrame([("k", "topic")], "key string, node_type string")
    edges = spark.createDataFrame([("k", "k", "RELATED_TO"), ("k", "k", "RELATED_TO")], "src string, dst string, relation string")
    S.save_graph(nodes, edges, folder + "/g")
    assert [x.count() for x in S.load_graph(spark, folder + "/g")] == [1, 2]
    vectors = spark.createDataFrame([(1, [0.5, 0.5])], "id long, embedding array<float>")
    S.save_vectors(vectors, folder + "/v")
    assert S.load_vectors(spark, folder + "/v").collect() == vectors.collect()
    for name in ("a.PDF", "b.mp4", "c.txt"):
        with open(f"{folder}/{name}", "w") as file:
            file.write("x")
    found = S.discover(spark, folder)
    assert [r.ext for r in found.where("ext IN ('pdf', 'mp4')").collect()] == ["pdf", "mp4"]


def test_sections(spark):
    rows = [("s", 0, 1, 10.0, "before"), ("s", 1, 1, 20.0, "Empty"), ("s", 2, 1, 20.0, "Title"), ("s", 3, 2, 10.0, "a"), ("s", 4, 3, 10.0, "b"), ("s", 5, 3, 20.0, "Last")]
    lines = spark.createDataFrame(rows, "source_id string, line_no int, page_number int, font_size double, text string")
    got = [tuple(r) for r in C.sectionize(lines).orderBy("sec").collect()]
    assert got == [("s", 0, None, "before", 1, 1), ("s", 2, "Title", "a\nb", 1, 3)]


def test_splitting():
    assert C.cut_text("A" * 150, 100) == ["A" * 100, "A" * 50]
    assert C.cut_text("First sentence. Second sentence. Third sentence.", 30) == ["First sentence.", "Second sentence.", "Third sentence."]
    paragraphs = "\n\n".join(c * 40 for c in "abcde")
    assert C.packed_parts(paragraphs, 100) == ["\n\n".join(("a" * 40, "b" * 40)), "\n\n".join(("c" * 40, "d" * 40)), "e" * 40]
    assert C.packed_parts("short", 100) == ["short"]
    windows = C.overlapping("Sentence one. " * 200, 1200, 100)
    assert all(len(w) <= 1200 for w in windows) and len(windows) > 2


def test_windows_and_keyframes(spark):
    segments = spark.createDataFrame([("s", 0, 0.0, 30.0, "a"), ("s", 1, 60.0, 90.0, "b"), ("s", 2, 125.0, 130.0, "c")], "source_id string, seq long, start double, end double, text string")
    got = [(r.chunk_id, r.start_time, r.end_time, r.text) for r in C.window_chunks(segments).orderBy("start_time").collect()]
    assert got == [("s_chunk_0", 0.0, 30.0, "a"), ("s_chunk_1", 60.0, 90.0, "b"), ("s_chunk_2", 120.0, 130.0, "c")]
    frames = spark.createDataFrame([("s", 60.0, "x"), ("s", 100.0, "quiet"), ("s", 120.0, " ")], "source_id string, ts double, caption string")
    got = [(r.start_time, r.end_time, r.text) for r in C.keyframe_chunks(segments, frames).orderBy("start_time").collect()]
    assert got == [(0.0, 30.0, "a"), (60.0, 90.0, "[Visual: x] b"), (100.0, 100.0, "[Visual: quiet]"), (120.0, 130.0, "c")]


def test_change_points(spark):
    rows = [("v", i, 1.0, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx long, fps double, feature array<float>")
    assert [r.frame_idx for r in C.change_points(frames).collect()] == [3]
