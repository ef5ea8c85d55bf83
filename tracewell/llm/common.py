"""What the operators of this subpackage share."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tracewell.storage import cut

SPACES = "\\x20\\x09-\\x0D"  # the white space that separates words
TEXT_BYTES_PER_GROUP = 8 << 20  # of text, for groups that one task holds in memory


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table; a null text is empty, other columns are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def groups_for(docs: DataFrame, text_col: str = "text") -> int:
    """How many groups to deal the work on a table's texts to, from the size of the texts."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(8, -(-size // TEXT_BYTES_PER_GROUP))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def adding(schema: StructType, compute, rows: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that adds the last columns of ``schema``, which ``compute(batch)`` gives as lists, on slices of ``rows`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                added = [pa.array(c, field.type) for c, field in zip(compute(part), list(target)[part.num_columns:])]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=target.names)

    return run


def with_columns(docs: DataFrame, fields: list[StructField], compute, rows: int = 512) -> DataFrame:
    """Adds columns that ``compute(batch)`` gives as lists, on slices of ``rows`` rows, without moving a row."""
    schema = StructType(docs.schema.fields + fields)
    return docs.mapInArrow(adding(schema, compute, rows), schema)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (node, root), root the smallest node of each.

    Alternates large-star and small-star steps: every step keeps at most as many
    edges as it was given, hubs are summed per task first, and each round is
    written to the checkpoint folder. Ends when a round changes nothing.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.filter("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
