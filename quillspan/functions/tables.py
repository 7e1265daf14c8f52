"""Table functions for SQL: texts to parts by lateral joins, whatever the number of parts.

    register_table_functions(spark)
    spark.sql("SELECT d.doc_id, p.* FROM documents d, LATERAL overlap_windows(d.text, 1200, 100) p")

Rows travel to Python and back a hundred at a time: an Arrow batch would hold ten thousand whole texts and all of their parts. Null texts give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillspan.operators.chunking import cut_text, overlapping, packed_parts


class HardSplit:
    """(part, piece) of a text: parts of at most `limit` characters, cut behind sentence ends where there are any."""

    def eval(self, text: str, limit: int) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(cut_text(text, limit))


class SectionParts:
    """(part, piece) of a section: paragraphs in order, as many together as stay within the limit."""

    def eval(self, text: str, limit: int) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(packed_parts(text, limit))


class OverlapWindows:
    """(win_no, win_text) of a text: windows of at most `limit` characters that share about `overlap`."""

    def eval(self, text: str, limit: int, overlap: int) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(overlapping(text, limit, overlap))


FUNCTIONS = {
    "hard_split": (HardSplit, "part int, piece string"),
    "section_parts": (SectionParts, "part int, piece string"),
    "overlap_windows": (OverlapWindows, "win_no int, win_text string"),
}


def register_table_functions(spark: SparkSession) -> None:
    """Make FUNCTIONS known to a session's SQL by their names."""
    for name, (kind, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind, returnType=schema, useArrow=False))
