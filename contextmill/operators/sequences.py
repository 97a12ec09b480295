"""Ordered work over sentence vectors, split so that no document is one task.

Rows are cut into blocks of a fixed width of positions; a document with any share
of the rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.functions.vectors import matrix
from contextmill.operators.chunking import SEMANTIC_THRESHOLD, SEMANTIC_WINDOW, trailing_similarity
from contextmill.session import materialise

BLOCK = 16384


def _block(position: str, width: int) -> Column:
    """The first position of the block a row lies in; the width is a power of two."""
    return F.col(position).cast("long").bitwiseAND(F.lit(-width).cast("long"))


def _before(blocks: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Running total of the earlier blocks; one row per block."""
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def numbered(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Number the rows of each group from 0 by a column of any ordered type.

    Rows are sorted by group and order over all partitions and written; a row's place there,
    less its group's first place, is its number. Partition sizes and first places are
    aggregates, so no task holds a group. Equal order values are numbered as they come.
    """
    ranged = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    placed = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = dict(placed.groupBy(part.alias("part")).count().collect())  # one row per partition
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    first = F.from_json(F.lit(str(before)), "array<bigint>")
    placed = placed.withColumn("__at", F.element_at(first, (part + 1).cast("int")) + within)
    groups = placed.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("__at").alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return placed.join(groups, same).select(*df.columns, (F.col("__at") - F.col("__first")).alias(out))


def sentence_similarity(
    sentences: DataFrame, dim: int, window: int = SEMANTIC_WINDOW, width: int = BLOCK
) -> DataFrame:
    """Similarity of each sentence to the mean of the ``window`` before it.

    ``sentences(doc_id, position, vector)`` with positions 0, 1, 2 ... per document.
    The last rows of a block are copied to the next block, so a block needs no
    other task. The first sentence of a document has no similarity.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    block = _block("position", width)
    near_end = F.col("position") - block >= width - window
    placed = sentences.select(
        "doc_id",
        "position",
        "vector",
        F.explode(F.when(near_end, F.array(block, block + width)).otherwise(F.array(block))).alias("block"),
    )
    ordered = placed.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "position")
    # Keys declared present keep the optimizer from adding NULL checks that would make
    # two uses of the result differ, and their shuffle with them.
    keys = [T.StructField(c, ordered.schema[c].dataType, False) for c in ("doc_id", "position")]
    out = T.StructType([*keys, T.StructField("sim", T.DoubleType())])
    run = _block_similarity(dim, window, width, to_arrow_schema(out))
    return ordered.select("doc_id", "position", "block", "vector").mapInArrow(run, out)


def _block_similarity(dim: int, window: int, width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            table = table.combine_chunks()
            docs, position, block = (table.column(i).to_numpy() for i in range(3))
            rows = matrix(table.column(3).combine_chunks(), dim)
            change = np.r_[True, (docs[1:] != docs[:-1]) | (block[1:] != block[:-1])]
            sims, has = trailing_similarity(rows, np.cumsum(change), window)
            own = position - position % width == block
            own[: 0 if held is None else held.num_rows] = False
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs[own], type=schema.field(0).type),
                    pa.array(position[own], type=schema.field(1).type),
                    pa.array(sims[own], mask=~has[own]),
                ],
                schema=schema,
            )
            held = table.slice(max(0, table.num_rows - window)).to_batches()[0]

    return run


def semantic_segments(
    similarity: DataFrame, threshold: float = SEMANTIC_THRESHOLD, width: int = BLOCK
) -> DataFrame:
    """Number the runs of similar sentences: a similarity under the threshold cuts.

    Gives ``(doc_id, position, segment)``. Cuts are counted within a block first and
    the blocks' totals summed up, so a document is numbered by many tasks. Both steps
    read one shuffle. Neighbouring runs only: groups that do not touch are never
    merged.
    """
    cut = F.when(F.col("sim").isNull() | (F.col("sim") < threshold), 1).otherwise(0)
    running = (
        Window.partitionBy("doc_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = similarity.select(
        "doc_id", "position", _block("position", width).alias("block"), cut.alias("cut")
    ).select("doc_id", "position", "block", F.sum("cut").over(running).alias("cuts_so_far"))
    blocks = counted.groupBy("doc_id", "block").agg(F.max("cuts_so_far").alias("cuts"))
    offsets = _before(blocks, ["doc_id"], "cuts", "offset").drop("cuts")
    segment = (F.col("cuts_so_far") + F.col("offset") - 1).cast("long")
    return counted.join(offsets, ["doc_id", "block"]).select("doc_id", "position", segment.alias("segment"))


def segment_bounds(segments: DataFrame) -> DataFrame:
    """First and last sentence of every segment, pre-aggregated per task."""
    return segments.groupBy("doc_id", "segment").agg(
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
        F.count(F.lit(1)).alias("sentences"),
    )
