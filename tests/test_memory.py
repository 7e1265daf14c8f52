"""What a Python worker holds at once doesn't grow with the table."""

from pyspark.util import PythonEvalType

from quillspan.functions import tables
from quillspan.operators import similarity as V


def test_table_functions_take_few_rows_at_a_time(spark, monkeypatch):
    made, udtf = [], tables.udtf
    monkeypatch.setattr(tables, "udtf", lambda *a, **k: (made.append(udtf(*a, **k)), made[-1])[1])
    tables.register_table_functions(spark)
    # an Arrow batch has ten thousand rows, whatever their texts' length
    assert len(made) == len(tables.FUNCTIONS) and {f.evalType for f in made} == {PythonEvalType.SQL_TABLE_UDF}


def test_blocks_of_queries_and_parts_of_vectors_are_small_and_few():
    held = (V.QUERY_BLOCK + V.PART_VECTORS) * 64 * 8
    queries = vectors = 60_000
    copied = queries * -(-vectors // V.PART_VECTORS) + vectors * -(-queries // V.QUERY_BLOCK)
    assert held <= 16 << 20 and copied <= 1_000_000
