"""Keyed storage of chunks, graphs and vectors as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import strip
from quillspan.sources.versions import Versions

# File name endings and the kinds of source they stand for.
VIDEO = ("mp4", "mkv", "mov", "avi")
AUDIO = ("mp3", "wav", "m4a", "ogg", "flac", "aac", "wma")
IMAGE = ("jpg", "jpeg", "png", "webp")


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = (*VIDEO, *AUDIO, *IMAGE, "pdf")) -> DataFrame:
    """Files below a folder by their endings in any case: path, length, ext, in order of path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("ext").isin(*extensions)).orderBy("path")


def classify_modality(files: DataFrame, slide_names: DataFrame | None = None, path_col: str = "path") -> DataFrame:
    """`files` with modality; a PDF is a slide deck if its file name is in `slide_names` (name). Other endings go."""
    ext = F.lower(F.regexp_extract(path_col, r"\.([^./]+)$", 1))
    kind = F.when(ext.isin(*VIDEO), "video").when(ext.isin(*AUDIO), "audio").when(ext.isin(*IMAGE), "image").when(ext == "pdf", "pdf")
    out = files.withColumn("modality", kind).where("modality IS NOT NULL")
    if slide_names is None:
        return out
    names = slide_names.select(F.col("name").alias("_name")).distinct().withColumn("_slide", F.lit(True))
    joined = out.withColumn("_name", F.regexp_extract(path_col, r"([^/]+)$", 1)).join(names, "_name", "left")
    return joined.withColumn("modality", F.when((F.col("modality") == "pdf") & F.col("_slide"), "slide").otherwise(F.col("modality"))).drop("_name", "_slide")


def read_chunks(spark: SparkSession, path: str, source_ids: list[str] | None = None) -> DataFrame:
    """All chunks of a stored table, or those of some sources, which Parquet's statistics help to find."""
    chunks = spark.read.parquet(path)
    return chunks if source_ids is None else chunks.where(F.col("source_id").isin(*source_ids))


def lookup(chunks: DataFrame, ids: DataFrame, on: str = "chunk_id") -> DataFrame:
    """`ids` with their chunks in one join; ids that are not there are skipped."""
    return ids.join(chunks, on)


def missing(chunks: DataFrame, ids: DataFrame, on: str = "chunk_id") -> DataFrame:
    """Ids that no chunk has."""
    return ids.join(chunks, on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", seq: str = "seq") -> DataFrame:
    """`old` with the rows of `new` in place of those with equal keys; of new rows with equal keys the largest seq wins."""
    best = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.col(seq)).alias("row")).select("row.*")
    return old.join(best, key, "left_anti").unionByName(best.select(*old.columns))


def delete_source(chunks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, chunks removed of each source in `sources`, 0 included)."""
    kept = chunks.join(sources, "source_id", "left_anti")
    gone = chunks.join(sources, "source_id", "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("removed"))
    return kept, sources.distinct().join(gone, "source_id", "left").select("source_id", F.coalesce("removed", F.lit(0)).alias("removed"))


def clear(table: DataFrame) -> DataFrame:
    """The table without its rows."""
    return table.limit(0)


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table."""
    counts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def graph_versions(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, buckets: int = 16) -> Versions:
    """Versions of a graph whose tables have the columns of `nodes` (key) and `edges` (src)."""
    shape = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return Versions(spark, path, {"nodes": ("key", shape(nodes)), "edges": ("src", shape(edges))}, buckets)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as the next version below `path`, in one commit; they may have been read from the version before."""
    graph_versions(nodes.sparkSession, path, nodes, edges).replace(nodes=nodes, edges=edges)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the latest version; what is saved later doesn't change them."""
    saved = Versions(spark, path, {}, 16).pin()
    return saved.table("nodes"), saved.table("edges")


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (id, embedding) as the next version below `path`."""
    rows = vectors.select("id", "embedding")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    Versions(vectors.sparkSession, path, {"vectors": ("id", schema)}, 16).replace(vectors=rows)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return Versions(spark, path, {}, 16).pin().table("vectors")


# What an exported node has beyond key, name, kind and summary, where the graph has it.
NODE_DETAILS = ("source_ids", "origin", "created_at", "updated_at", "scope", "illustration", "illustration_path", "content_type", "raw_excerpt", "key_terms", "parents")


def export_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for display: no chunk references, only edges between nodes shown, label and confidence of semantic edges only.

    Nodes keep those of NODE_DETAILS that they have, edges their source_chunk_ids; lists that are null are empty.
    """
    filled = lambda df, c: F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in ("source_ids", "source_chunk_ids") else F.col(c)
    shown = nodes.where("node_type IS NULL OR node_type <> 'chunk_ref'").select(
        "key", F.coalesce("name", "key").alias("name"), F.coalesce("node_type", F.lit("content")).alias("node_type"), F.coalesce("summary", F.lit("")).alias("summary"), *(filled(nodes, c) for c in NODE_DETAILS if c in nodes.columns)
    )
    keys = shown.select("key")
    kept = edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
    related = F.col("relation") == "RELATED_TO"
    more = [filled(edges, "source_chunk_ids")] if "source_chunk_ids" in edges.columns else []
    return shown, kept.select("src", "dst", "relation", F.when(related, F.col("label")).alias("label"), F.when(related, F.col("confidence")).alias("confidence"), *more)


def write_export(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The export as JSON lines below `path`, in folders nodes and edges; fields that are null are left out, as readers expect of details a node doesn't have."""
    for name, rows in zip(("nodes", "edges"), export_graph(nodes, edges), strict=True):
        rows.write.json(f"{path}/{name}", ignoreNullFields=True)


def image_chunks(images: DataFrame) -> DataFrame:
    """A chunk an image (source_id, name, caption, width, height): its caption, else its name in brackets."""
    text = F.coalesce(F.nullif(strip("caption"), F.lit("")), F.concat(F.lit("[Image: "), F.col("name"), F.lit("]")))
    return images.select(F.concat("source_id", F.lit("_image_0")).alias("chunk_id"), "source_id", F.lit("image").alias("modality"), text.alias("text"), "width", "height")


def slide_chunks(pages: DataFrame) -> DataFrame:
    """A chunk a slide (source_id, page_number, text, caption) that has text or caption; its title is the first line that isn't blank."""
    caption, body = strip(F.coalesce("caption", F.lit(""))), strip(F.coalesce("text", F.lit("")))
    seen = F.when(caption != "", F.concat(F.lit("[Visual: "), caption, F.lit("]")))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: strip(x) != "")
    return pages.select(
        F.concat("source_id", F.lit("_slide_"), F.col("page_number").cast("string")).alias("chunk_id"),
        "source_id",
        F.lit("slide").alias("modality"),
        F.concat_ws(" ", seen, F.nullif(body, F.lit(""))).alias("text"),
        "page_number",
        strip(F.get(lines, F.lit(0))).alias("slide_title"),
    ).where("text <> ''")
