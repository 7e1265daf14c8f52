"""Texts, timed segments and frames into chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import strip
from quillspan.operators.prefix import running, up_to


def sectionize(lines: DataFrame, min_heading_size: float = 14.0) -> DataFrame:
    """Sections of lines (source_id, line_no, page_number, font_size, text): source_id, sec, title, text, page_start, page_end.

    A line of min_heading_size or more begins a section and is its title. Sections without other lines vanish; sec
    counts headings, 0 before the first.
    """
    by = Window.partitionBy("source_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("font_size") >= min_heading_size
    marked = lines.withColumn("heading", heading).withColumn("sec", F.sum(heading.cast("int")).over(by))
    body = F.sort_array(F.collect_list(F.when(~F.col("heading"), F.struct("line_no", "text"))))
    grouped = marked.groupBy("source_id", "sec").agg(
        F.max(F.when(F.col("heading"), F.col("text"))).alias("title"),
        body.alias("body"),
        F.min_by("page_number", "line_no").alias("page_start"),
        F.max_by("page_number", F.when(~F.col("heading"), F.col("line_no"))).alias("page_end"),
    )
    return grouped.where(F.size("body") > 0).select("source_id", "sec", "title", F.array_join(F.transform("body", lambda x: x["text"]), "\n").alias("text"), "page_start", "page_end")


def cut_text(text: str, limit: int) -> list[str]:
    """Parts of at most `limit` characters, each cut behind the last sentence end that lies within it, else hard."""
    parts = []
    while len(text) > limit:
        dot = text.rfind(". ", 0, limit)
        at = dot + 1 if dot >= 0 else limit
        parts.append(text[:at].strip())
        text = text[at:].strip()
    return [*parts, text] if text else parts


def hard_split(texts: DataFrame, max_chars: int = 2000) -> DataFrame:
    """(id, part, text) of texts (id, text): cut_text's parts, counted from 0. Null texts give no rows."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = [(i, k, x) for i, t in zip(pdf["id"], pdf["text"], strict=True) if t is not None for k, x in enumerate(cut_text(t, max_chars))]
            yield pd.DataFrame(rows, columns=["id", "part", "text"]).astype({"id": pdf["id"].dtype, "part": "int32"})

    return texts.select("id", "text").mapInPandas(run, f"id {kind}, part int, text string")


def packed_parts(text: str, limit: int) -> list[str]:
    """A section's parts: paragraphs in order, as many together as stay within the limit without counting separators."""
    if len(text) <= limit:
        return [text]
    paragraphs = [p.strip() for p in text.split("\n\n") if p.strip()] or [text]
    out: list[list[str]] = []
    size = 0
    for part in (x for p in paragraphs for x in (cut_text(p, limit) if len(p) > limit else [p])):
        if out and size + len(part) <= limit:
            out[-1].append(part)
            size += len(part)
        else:
            out.append([part])
            size = len(part)
    return ["\n\n".join(x) for x in out]


def split_sections(sections: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Sections longer than max_chars in parts: all columns, text replaced, part from 0 added. Null texts give no rows."""
    names = [c for c in sections.columns if c != "part"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sections.select(*names).schema.fields) + ", part int"

    def run(frames):
        for pdf in frames:
            pdf = pdf[pdf["text"].notna()]
            parts = [packed_parts(t, max_chars) for t in pdf["text"]]
            out = pdf.loc[pdf.index.repeat([len(p) for p in parts])].reset_index(drop=True)
            out["text"] = [x for p in parts for x in p]
            out["part"] = [k for p in parts for k in range(len(p))]
            yield out.astype({"part": "int32"})

    return sections.select(*names).mapInPandas(run, schema)


def section_chunks(parts: DataFrame, page_images: DataFrame | None = None) -> DataFrame:
    """Chunks of parts: chunk_id counts a source's parts from 0; image_paths holds those of pages from page_start to page_end.

    Page images (source_id, page_number, path) are found page by page in an equal join.
    """
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("sec", "part")) - 1
    chunks = parts.withColumn("seq", rank).withColumn("chunk_id", F.concat("source_id", F.lit("_chunk_"), F.col("seq").cast("string"))).withColumn("char_count", F.length("text"))
    if page_images is None:
        return chunks
    pages = chunks.select("chunk_id", "source_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    found = pages.join(page_images, ["source_id", "page_number"]).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "path"))).alias("found"))
    return chunks.join(found, "chunk_id", "left").withColumn("image_paths", F.transform("found", lambda x: x["path"])).drop("found")


def window_chunks(segments: DataFrame, window_sec: float = 60.0) -> DataFrame:
    """Chunks of segments (source_id, seq, start, end, text) by windows of their starts; windows without segments give none."""
    slot = F.floor(F.col("start") / window_sec).cast("long")
    grouped = segments.withColumn("slot", slot).groupBy("source_id", "slot").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("body"), F.max_by("end", "seq").alias("end_time"))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("slot")) - 1
    return grouped.select(
        F.concat(F.col("source_id").cast("string"), F.lit("_chunk_"), rank.cast("string")).alias("chunk_id"),
        "source_id",
        F.array_join(F.transform("body", lambda x: x["text"]), " ").alias("text"),
        (F.col("slot") * F.lit(float(window_sec))).alias("start_time"),
        "end_time",
    )


def keyframe_chunks(segments: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Chunks between keyframes (source_id, ts, caption): what is said from one to the next, and its caption.

    Boundaries are 0 and each ts. A segment belongs to the last boundary at or before its start, found as of: segments
    and boundaries are put in one order and the last boundary is carried on. An interval with a caption and nothing
    said ends where it begins; one with neither gives no chunk. The interval from 0 has no caption.
    """
    sources = segments.select("source_id").union(keyframes.select("source_id")).distinct()
    marks = keyframes.select("source_id", F.col("ts").cast("double").alias("at"), F.col("caption")).unionByName(sources.select("source_id", F.lit(0.0).alias("at"), F.lit(None).cast("string").alias("caption")))
    marks = marks.groupBy("source_id", "at").agg(F.max("caption").alias("caption"))
    both = marks.select("source_id", "at", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("seq"), "caption", F.col("at").alias("mark"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("text")).unionByName(
        segments.select("source_id", F.col("start").cast("double").alias("at"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("double").alias("mark"), F.col("end").cast("double").alias("end"), "text")
    )
    so_far = Window.partitionBy("source_id").orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("mark", F.last("mark", ignorenulls=True).over(so_far))
    grouped = placed.groupBy("source_id", F.col("mark").alias("start_time")).agg(
        F.max("caption").alias("caption"), F.sort_array(F.collect_list(F.when(F.col("kind") == 1, F.struct("seq", "text")))).alias("said"), F.max_by("end", F.when(F.col("kind") == 1, F.col("seq"))).alias("last_end")
    )
    said = F.array_join(F.transform("said", lambda x: x["text"]), " ")
    caption = F.nullif(strip(F.coalesce("caption", F.lit(""))), F.lit(""))
    text = F.concat_ws(" ", F.when(caption.isNotNull(), F.concat(F.lit("[Visual: "), caption, F.lit("]"))), F.nullif(said, F.lit("")))
    kept = grouped.select("source_id", "start_time", F.coalesce("last_end", "start_time").alias("end_time"), text.alias("text")).where("text <> ''")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("start_time")) - 1
    return kept.withColumn("chunk_id", F.concat(F.col("source_id").cast("string"), F.lit("_chunk_"), rank.cast("string"))).select("chunk_id", "source_id", "text", "start_time", "end_time")


def cosine(a: Column, b: Column) -> Column:
    """Inner product in double precision; cosine for unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, v: s + v)


def change_points(frames: DataFrame, threshold: float = 0.85, sample_fps: int = 1) -> DataFrame:
    """Of frames (video_id, frame_idx, fps, feature), every (fps / sample_fps)-th, those less like the one before than threshold."""
    step = F.greatest(F.lit(1), F.floor(F.col("fps") / sample_fps).cast("long"))
    sampled = frames.where(F.col("frame_idx") % step == 0)
    before = F.lag("feature").over(Window.partitionBy("video_id").orderBy("frame_idx"))
    scored = sampled.withColumn("before", before).where("before IS NOT NULL").withColumn("similarity", cosine(F.col("before"), F.col("feature")))
    return scored.where(F.col("similarity") < threshold).select("video_id", "frame_idx", (F.col("frame_idx") / F.col("fps")).alias("ts"), "similarity")


def overlapping(text: str, limit: int, overlap: int) -> list[str]:
    """Windows of at most `limit` characters that share about `overlap`; they end behind a sentence or line where one ends inside."""
    if len(text) <= limit:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + limit
        if end < len(text):
            mark = max(text.rfind(x, start, end) for x in (". ", ".\n", "\n"))
            end = mark + 1 if mark > start else end
        out.append(text[start:end].strip())
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return [x for x in out if x]


def overlap_windows(texts: DataFrame, max_chars: int = 1200, overlap: int = 100) -> DataFrame:
    """(id, win_no, win_text) of texts (id, text)."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = [(i, k, w) for i, t in zip(pdf["id"], pdf["text"], strict=True) if t is not None for k, w in enumerate(overlapping(t, max_chars, overlap))]
            yield pd.DataFrame(rows, columns=["id", "win_no", "win_text"]).astype({"id": pdf["id"].dtype, "win_no": "int32"})

    return texts.select("id", "text").mapInPandas(run, f"id {kind}, win_no int, win_text string")


def doc_preview(chunks: DataFrame, by: str = "source_id", max_chars: int = 3000, files: DataFrame | None = None) -> DataFrame:
    """The first max_chars characters of each group's chunks that aren't blank, a blank line between them.

    With files (`by`, name) a line of their names, in order, stands in front and counts; groups of files without text have that line alone.
    Chunks beyond those that fill the preview are dropped before they are gathered, so a group of any size is safe.
    """
    kept = chunks.where(strip("text") != "")
    # the chunks before which there is room, told from lengths alone
    length = F.length("text") + 2
    summed = running(kept.select(by, "seq", length.cast("long").alias("_length")), by, ["seq"], F.col("_length"))
    cut = summed.where(F.col("total") - F.col("_length") < max_chars).groupBy(F.col(by).alias("_group")).agg(F.max(F.struct("seq")).alias("_last"))
    needed = up_to(kept, cut, by, ["seq"])
    needed = needed.withColumn("text", F.substring("text", 1, max_chars))
    body = F.sort_array(F.collect_list(F.struct("seq", "text")))
    bodies = needed.groupBy(by).agg(body.alias("body")).select(by, F.array_join(F.transform("body", lambda x: x["text"]), "\n\n").alias("text"))
    if files is None:
        return bodies.select(by, F.substring("text", 1, max_chars).alias("preview"))
    heads = files.groupBy(by).agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))
    # Fixed value: the words before the names.
    head = F.concat(F.lit("Source files: "), F.coalesce("names", F.lit("")), F.lit("\n\n"))
    return heads.join(bodies, by, "full_outer").select(by, F.substring(F.concat(head, F.coalesce("text", F.lit(""))), 1, max_chars).alias("preview"))
