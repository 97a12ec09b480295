"""How five document filters interact, in every order they can be applied.

A document either passes or fails each filter, so a part of the corpus is a 2x2x2x2x2 tensor of
counts. Every question about an order of filters is a contraction of that tensor: along each axis
a step takes those that pass, those that fail, or all. Texts are looked at once; what is shuffled is
a digest and a few flags per document, then counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.llm.words import blank_separated, slices, tidy

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")


@dataclass(frozen=True)
class Limits:
    """When filters A to D fail a text."""

    least_words: int = 200
    distinct_percent: int = 50
    capitals_percent: int = 3
    signs: bytes = b"#$%&*|"


def text_failures(docs: DataFrame, text: str, limits: Limits = Limits()) -> DataFrame:
    """``docs`` without its text, and ``state``: bit i is set where filter i of A to D fails.

    Texts are looked at whole, a slice of rows at a time; one very long text is a slice of its own
    and takes about 30 times its bytes. NULL counts as empty: it fails A alone.
    """
    kept = [f for f in docs.schema.fields if f.name != text]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = blank_separated()
        sign = np.zeros(256, bool)
        sign[list(limits.signs)] = True
        for batch in batches:
            for part in slices(batch, text):
                words = splitter.split(part.column(text))

                def per_text(marks: np.ndarray) -> np.ndarray:
                    sums = np.concatenate(([0], np.cumsum(marks)))
                    return sums[words.begin[1:] - 1] - sums[words.begin[:-1]]

                data = words.data
                points, capitals = per_text((data & 0xC0) != 0x80), per_text((data >= 65) & (data <= 90))
                fails = np.stack((
                    words.counts < limits.least_words,
                    _repetitive(words, limits.distinct_percent),
                    100 * capitals > limits.capitals_percent * points,
                    per_text(sign[data]) > 0,
                ))
                columns = [part.column(f.name) for f in kept]
                state = (fails << np.arange(4)[:, None]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(state, pa.int32())], [*(f.name for f in kept), "state"])

    return docs.mapInArrow(tidy(look), T.StructType([*kept, T.StructField("state", T.IntegerType())]))


def _repetitive(words, percent: int) -> np.ndarray:
    """Whether under ``percent`` of a text's words are distinct.

    Equal hashes can only hide distinct words, so texts that seem repetitive are counted
    again by the words themselves.
    """
    of = np.repeat(np.arange(len(words.counts)), words.counts)
    order = np.lexsort((words.hashes(), of))
    hashes = words.hashes()[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of, fresh, len(words.counts)).astype(np.int64)
    low = 100 * distinct < percent * words.counts
    for t in np.flatnonzero(low).tolist():
        text = words.data[words.begin[t] : words.begin[t + 1] - 1].tobytes()
        low[t] = 100 * len(set(text.split())) < percent * int(words.counts[t])
    return low


def filter_states(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", limits: Limits = Limits(),
) -> DataFrame:
    """(part, state, n, good, toxic): documents by what they fail; bit 4 of ``state`` is filter E.

    E fails documents whose text a smaller id has, anywhere in the table. Rows of one id do not fail
    each other, and a NULL id is neither smaller nor larger than any. A document is good or toxic
    if any label of its id says so. A NULL part is the empty string. Copies are counted in the tasks
    before their text's digest is shuffled, so a text that very many documents share is not one
    task's work.
    """
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    held = docs.select(
        F.col(key).alias("__id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"), whole.alias("__text"),
    )
    flagged = text_failures(held, "__text", limits).join(marks, "__id", "left")
    flagged = flagged.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    alike = ["digest", "part", "state", "good", "toxic"]
    by_id = flagged.groupBy(*alike, "__id").agg(F.count(F.lit(1)).alias("n"))
    # Of equal texts, in one part and with equal labels: how many have the smallest id, no id, any id.
    groups = by_id.groupBy(*alike).agg(
        F.min(F.when(F.col("__id").isNotNull(), F.struct("__id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("__id").isNull(), F.col("n"))), F.lit(0)).alias("anonymous"),
        F.sum("n").alias("n"),
    )
    # A text has as many groups as there are parts, at most four times.
    least = F.min("first.__id").over(Window.partitionBy("digest"))
    first = F.when(F.col("first.__id") == F.col("least"), F.col("first.n")).otherwise(0)
    stays = F.coalesce(first, F.lit(0)) + F.col("anonymous")
    both = F.array(
        F.struct("state", stays.alias("n")), F.struct((F.col("state") + 16).alias("state"), (F.col("n") - stays).alias("n")))
    split = groups.withColumn("least", least).select("part", "good", "toxic", F.inline(both))

    def where(flag: Column) -> Column:
        return F.sum(F.when(flag, F.col("n")).otherwise(0))

    return split.groupBy("part", "state").agg(
        F.sum("n").alias("n"), where(F.col("good")).alias("good"), where(F.col("toxic")).alias("toxic_n"),
    ).withColumnRenamed("toxic_n", "toxic")


def selections(k: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of ``k`` filters, and what each of their steps takes along each axis.

    An array (orders * k, k, 2): the last axis says whether those that pass and those that fail count.
    """
    passing, failing, anyone = np.eye(2, dtype=np.int64)[0], np.eye(2, dtype=np.int64)[1], np.ones(2, np.int64)
    orders = list(permutations(range(k)))
    take = {name: np.tile(anyone, (len(orders) * k, k, 1)) for name in ("kept", "removed", "failed", "only")}
    for i, order in enumerate(orders):
        for step, own in enumerate(order):
            row, before = i * k + step, list(order[:step])
            take["kept"][row, [*before, own]] = passing
            take["removed"][row, before] = passing
            take["only"][row] = passing
            for name in ("removed", "failed", "only"):
                take[name][row, own] = failing
    return orders, take


def contract(tensor: np.ndarray, take: np.ndarray) -> np.ndarray:
    """(rows, measures): the counts that each selection takes of a tensor (2, ..., 2, measures)."""
    axes = "abcdefgh"[: take.shape[1]]
    parts = [take[:, i] for i in range(take.shape[1])]
    rule = f"{axes}z,{','.join('r' + a for a in axes)}->rz"
    return np.einsum(rule, tensor, *parts, optimize=True)


def interactions(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """Of every order and step, by a tensor of (all, good, toxic) documents.

    ``shapley`` sums what the step's filter removes over all orders.
    """
    k = tensor.ndim - 1
    orders, take = selections(k)
    removed, failed = contract(tensor, take["removed"]), contract(tensor, take["failed"])
    own = np.array([f for order in orders for f in order])
    return {
        "kept": contract(tensor, take["kept"])[:, 0],
        "removed": removed[:, 0],
        "redundant": failed[:, 0] - removed[:, 0],
        "unique_fails": contract(tensor, take["only"])[:, 0],
        "good_lost": removed[:, 1],
        "toxic_lost": removed[:, 2],
        "shapley": np.array([removed[own == f, 0].sum() for f in range(k)])[own],
    }


def audit(states: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, zeros included, from ``filter_states``.

    A part has at most one row per state, so its tensor is small whatever the corpus.
    No rows, no parts: an empty table gives an empty result.
    """
    k = len(filters)
    numbers = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def expand(table: pa.Table) -> pa.Table:
        tensor = np.zeros((2**k, len(MEASURES)), np.int64)
        tensor[np.asarray(table.column("state"))] = np.stack([np.asarray(table.column(m)) for m in MEASURES], axis=1)
        # Bit i of the state is axis i.
        tensor = tensor.reshape(*(2,) * k, len(MEASURES)).transpose(*range(k - 1, -1, -1), k)
        found = interactions(tensor)
        names = ["".join(filters[f] for f in order) for order in permutations(range(k))]
        rows = factorial(k) * k
        columns = {
            "part": pa.array([table.column("part")[0].as_py()] * rows, pa.string()),
            "filter_order": pa.array([n for n in names for _ in range(k)], pa.string()),
            "step": pa.array(np.tile(np.arange(1, k + 1), len(names)), pa.int32()),
            **{n: pa.array(found[n], pa.int64()) for n in numbers},
        }
        return pa.Table.from_pydict(columns)

    kind = "part string, filter_order string, step int, " + ", ".join(f"{n} bigint" for n in numbers)
    return states.groupBy("part").applyInArrow(expand, kind)


def filter_interactions(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", limits: Limits = Limits(),
) -> DataFrame:
    """The audit of five filters over whole texts: see ``filter_states`` and ``audit``."""
    return audit(filter_states(docs, labels, key, text, part, limits))
