"""Exact cosine search for many questions at once, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.functions.text import preview
from contextmill.functions.vectors import matrix, norms, row_cosine
from contextmill.operators.relevance import filter_by_relevance, judge
from contextmill.session import bounded_batches, materialise, temporary
from contextmill.sources.collections import among

OVERFETCH = 3
# Bytes of vectors, as doubles, in one packed row of questions or of the corpus. Questions that are few for the tasks are
# packed in smaller rows, see ``_block_bytes``.
QUESTION_BYTES, TILE_BYTES = 4 << 20, 8 << 20
# Blocks of questions that one task holds with their best hits so far.
TASK_BLOCKS = 4

# Chunks and questions of one product, whose results stay in a core's cache, and vector elements re-scored at a time.
_STEP = 512
_EXACT_ELEMENTS = 1 << 21
_BLOCK_HITS = 1 << 18
# Chunks of a first tile that a question's first floor is taken from.
_SAMPLE = 2048


def _packed(rows: DataFrame, name: str, dim: int, size: int, by_pivot: bool = False) -> DataFrame:
    """Runs of rows as one row each: ``{name}_ids``, see ``_ids``, and ``{name}_vectors``, at most ``size`` bytes.

    Elements keep their type if that is float, else they are doubles. ``{name}_run`` tells the runs apart; ``{name}_ball`` holds their direction and the largest
    angle of a member to it, see ``_ball``; ``{name}_pivots`` and ``{name}_floors`` are the third and fourth column.
    With ``by_pivot`` the third column and the fifth, the run's ``{name}_group``, are the same within a run, and a run's
    rows stand in the order of how many elements of a vector are not zero.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([
        T.StructField(f"{name}_ids", T.BinaryType()),
        T.StructField(f"{name}_vectors", T.BinaryType()),
        T.StructField(f"{name}_run", T.StringType()),
        T.StructField(f"{name}_ball", T.BinaryType()),
        T.StructField(f"{name}_pivots", T.ArrayType(T.IntegerType())),
        T.StructField(f"{name}_floors", T.ArrayType(T.DoubleType())),
        T.StructField(f"{name}_group", T.StringType()),
    ])
    arrow = to_arrow_schema(out)
    most = max(1, size // (8 * max(1, dim)))
    kind = _element(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = (f"{TaskContext.get().partitionId()}-{n}" for n in count())

        def run(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, vectors, pivots, floors, groups = (c.combine_chunks() for c in table.columns)
            values = np.ascontiguousarray(matrix(vectors, dim), np.float64)
            if by_pivot:
                order = np.argsort(np.count_nonzero(values, axis=1), kind="stable")
                values, ids = values[order], ids.take(pa.array(order))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), c) for c in (pivots, floors)]
            columns = [pa.array([_packed_ids(ids)], pa.binary()), pa.array([values.astype(kind).tobytes()], pa.binary()), pa.array([next(names)]),
                       pa.array([_ball(values).tobytes()], pa.binary()), *(x.cast(arrow.field(i).type) for x, i in ((lists[0], 4), (lists[1], 5))),
                       groups[:1].cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        def pieces() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not by_pivot:
                    yield batch
                    continue
                pivot = np.asarray(batch.column("pivot").fill_null(-1))
                group = np.asarray(batch.column("group").dictionary_encode().indices.fill_null(-1))
                edges = [0, *(np.flatnonzero(np.diff(pivot) | np.diff(group)) + 1).tolist(), len(pivot)]
                for x, y in zip(edges[:-1], edges[1:]):
                    yield batch.slice(x, y - x)

        last = None
        for batch in pieces():
            if by_pivot and batch.num_rows:
                own = batch.column("pivot")[0].as_py(), batch.column("group")[0].as_py()
                if held and own != last:
                    yield run(held)
                    held = []
                last = own
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) == most:
                    yield run(held)
                    held = []
        if held:
            yield run(held)

    return rows.mapInArrow(pack, out)


def _packed_ids(ids: pa.Array) -> bytes:
    """Ids as one binary value, which Spark copies as it is, where it would go through a list element by element."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([pa.field("id", ids.type)])) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
    return out.getvalue().to_pybytes()


def _ids(packed: pa.BinaryScalar, kind: pa.DataType) -> pa.Array:
    # A copy of the value, so that ids do not hold the batch they came in.
    return pa.ipc.open_stream(pa.py_buffer(packed.as_py())).read_all().column(0).combine_chunks().cast(kind)


def _element(rows: DataFrame) -> str:
    """The type of a vector's elements as they are packed."""
    return "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


#: What rounding may add to an angle, generously: arccos loses half the digits near one.
_ANGLE_SLACK = 1e-6


def _ball(rows: np.ndarray) -> np.ndarray:
    """The mean direction of some vectors, then the largest angle of one to it, then whether one is zero."""
    size = norms(rows)[:, None]
    unit = np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
    middle = unit.sum(axis=0)
    length = np.sqrt((middle * middle).sum())
    if length < 1e-9:
        return np.concatenate((middle, [np.pi, float((size == 0).any())]))
    middle /= length
    some = unit[size[:, 0] > 0]
    angle = np.arccos(np.clip((some @ middle).min(), -1, 1)) if len(some) else 0.0
    return np.concatenate((middle, [angle, float((size == 0).any())]))


def _most_similar(ball: np.ndarray, unit: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """The largest similarity that each question can have to a member of the ball, by the triangle inequality."""
    middle, angle, has_zero = ball[:-2], ball[-2], ball[-1]
    apart = np.arccos(np.clip(unit @ middle, -1, 1)) - angle - _ANGLE_SLACK
    most = np.where(apart > 0, np.cos(np.maximum(apart, 0)), 1.0)
    if has_zero:
        most = np.maximum(most, 0)
    return np.where(zero, 1.0, most)


def _units(rows: np.ndarray) -> np.ndarray:
    size = norms(rows.astype(np.float64, copy=False))[:, None]
    if rows.dtype == np.float32 and len(rows) and 1e-30 < size.min() and size.max() < 1e30:
        return rows / size.astype(np.float32)
    return np.divide(rows, size, out=np.zeros(rows.shape), where=size > 0).astype(np.float32)


class _Tile:
    """Some chunks of one group, and how many elements of each vector are not zero."""

    def __init__(self, row: Callable, dim: int, kind: str, ids: pa.DataType):
        self.run, self.ids = row("chunk_run").as_py(), _ids(row("chunk_ids"), ids)
        self.raw = np.frombuffer(row("chunk_vectors").as_py(), kind).reshape(-1, dim)
        self.unit = _units(self.raw)
        self.support = np.count_nonzero(self.raw, axis=1)
        self.ball = np.frombuffer(row("chunk_ball").as_py(), np.float64)
        pivots = row("chunk_pivots").values
        self.pivot = pivots[0].as_py() if len(pivots) else None


class _Best:
    """A block of questions with the k best hits so far of each, ties by chunk id, NULL first.

    ``reach[s]`` is the largest similarity that each question can have to a vector with s elements that are not
    zero: by the inequality of Cauchy and Schwarz over these elements, the length of its own s largest ones.
    """

    def __init__(self, row: Callable, dim: int, kind: str, ids: pa.DataType, k: int, margin: float):
        self.ids = _ids(row("query_ids"), ids)
        self.raw = np.frombuffer(row("query_vectors").as_py(), kind).reshape(-1, dim)
        wide = self.raw.astype(np.float64)
        size = norms(wide)[:, None]
        exact = np.divide(wide, size, out=np.zeros_like(wide), where=size > 0)
        self.exact, self.unit, self.zero = exact, exact.astype(np.float32), size[:, 0] == 0
        largest = np.sort(exact * exact, axis=1)[:, ::-1]
        self.reach = np.concatenate((np.zeros((1, len(exact))), np.sqrt(np.cumsum(largest, axis=1)).T)).astype(np.float32)
        self.pivots = row("query_pivots").values
        self.floor = np.asarray(row("query_floors").values.fill_null(-np.inf), np.float64) - margin
        self.k, self.margin = k, margin
        self.top = np.full((len(exact), k), -np.inf)
        self.held: list[pa.Table] = []
        self.n = 0

    def add(self, question: np.ndarray, sim: np.ndarray, ids: pa.Array) -> None:
        if not len(question):
            return
        self.held.append(pa.table([pa.array(question, pa.int32()), pa.array(sim), ids], names=["question", "sim", "id"]))
        self.n += len(question)
        self._raise(question, sim)
        if self.n > 2 * self.k * len(self.ids):
            self.trim()

    def _raise(self, question: np.ndarray, sim: np.ndarray) -> None:
        """Floors are the k-th best similarities so far, less the margin."""
        order, place = _places(question, sim)
        order, place = order[place < self.k], place[place < self.k]
        which, row = np.unique(question[order], return_inverse=True)
        new = np.full((len(which), self.k), -np.inf)
        new[row, place] = sim[order]
        both = np.concatenate((self.top[which], new), axis=1)
        both.partition(self.k, axis=1)
        self.top[which] = both[:, self.k :]
        self.floor[which] = np.maximum(self.floor[which], both[:, self.k] - self.margin)

    def trim(self) -> None:
        if not self.held:
            return
        rows = pa.concat_tables(self.held).combine_chunks()
        order = [("question", "ascending"), ("sim", "descending"), ("id", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
        question = np.asarray(rows["question"])
        place = np.arange(len(question)) - np.searchsorted(question, question, "left")
        self.held = [rows.filter(pa.array(place < self.k))]
        self.n = self.held[0].num_rows


def _places(question: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by question and descending similarity, and the place from 0 of each in its question's list."""
    order = np.lexsort((-sim, question))
    sorted_by = question[order]
    return order, np.arange(len(order)) - np.searchsorted(sorted_by, sorted_by, "left")


def _best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], best: _Best, margin: np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of a tile's pairs that can be among its k best of their question, whose floor is raised."""
    question, row, sim = (np.concatenate(x) for x in zip(*found))
    order, place = _places(question, sim)
    question, row, sim = question[order], row[order], sim[order]
    last = np.full(len(best.floor), -np.inf)
    last[question[place == best.k - 1]] = sim[place == best.k - 1]
    last -= 2 * margin
    np.maximum(best.floor, last, out=best.floor)
    kept = sim >= last[question]
    return question[kept], row[kept], sim[kept]


def _candidates(tile: _Tile, best: _Best, near: np.ndarray, margin: np.float32) -> tuple[np.ndarray, np.ndarray, int]:
    """Question and row of all pairs that can be among the k best, and hardly any others; how many were looked at.

    Products are made of few chunks and questions at a time, so that they are still in the cache when they are
    compared, first by the largest of each question. Questions that cannot reach their floor with as many
    elements as these chunks have are left out.
    """
    k, n = best.k, len(tile.unit)
    fresh = near[np.isneginf(best.floor[near])]
    sample = tile.unit[:: max(1, n // max(_SAMPLE, 4 * k))]
    if len(fresh) and len(sample) > k:
        for start in range(0, len(fresh), _STEP):
            some = fresh[start : start + _STEP]
            sims = best.unit[some] @ sample.T
            at = sims.shape[1] - k
            best.floor[some] = np.partition(sims, at, axis=1)[:, at] - 2 * margin
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count, most, able, looked = 0, -1, near, 0
    for start in range(0, n, _STEP):
        rows = tile.unit[start : start + _STEP]
        support = int(tile.support[start : start + _STEP].max())
        if count > 4 * k * len(near):
            found = [_best_of(found, best, margin)]
            count, most = 0, -1
        if support != most:
            most = support
            able = near[best.reach[most, near] >= best.floor[near] - margin]
            units, floors = best.unit[able], (best.floor[able] - margin).astype(np.float32)
        looked += len(rows) * len(able)
        for first in range(0, len(able), _STEP):
            sims = rows @ units[first : first + _STEP].T
            floor = floors[first : first + _STEP]
            some = np.flatnonzero(sims.max(axis=0) >= floor)
            if not len(some):
                continue
            if 4 * len(some) < len(floor):
                sims, floor = sims[:, some], floor[some]
            else:
                some = np.arange(len(floor))
            at = np.flatnonzero(sims >= floor)
            row, column = np.divmod(at, len(some))
            found.append((able[first + some[column]], row + start, sims.ravel()[at]))
            count += len(at)
    if not found:
        return near[:0], near[:0], looked
    return *_best_of(found, best, margin)[:2], looked


def _search(k: int, dim: int, schema: pa.Schema, elements: tuple[str, str], own: bool = False, seen=None):
    """Top k of a task's tiles for each question of its blocks.

    Questions whose floor no member of a tile can reach skip it, and single-precision products find the candidates
    of the others. The margin covers the largest possible
    rounding error, so no true member is lost; of a tile's candidates those that can be among its own k best are
    scored again in double precision, independent of batch and tile sizes. A task holds each question's k best so far and sends them on at its end;
    nothing below the k-th can be among them. A block may bring such
    floors with it. With ``own`` only tiles of a question's own pivot are looked at. ``elements`` are the types that
    chunks and questions are packed in. ``seen`` counts pairs
    of question and vector, and those that were skipped.
    """
    margin = np.float32(2 * (dim + 8) * 2.0**-24 + 2e-9)
    exact = max(1, _EXACT_ELEMENTS // max(1, dim))
    query_id, chunk_id = schema.field(0).type, schema.field(1).type

    def run(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[str, str | None], _Best] = {}
        tile = None
        for batch in pairs:
            for i in range(batch.num_rows):
                def row(name: str):
                    return batch.column(name)[i]

                # A task meets its blocks one after the other with each tile.
                if tile is None or tile.run != row("chunk_run").as_py():
                    tile = _Tile(row, dim, elements[0], chunk_id)
                block = row("query_run").as_py(), row("chunk_group").as_py()
                if block not in blocks:
                    blocks[block] = _Best(row, dim, elements[1], query_id, k, margin)
                best = blocks[block]
                possible = _most_similar(tile.ball, best.exact, best.zero) >= best.floor - margin
                if own:
                    possible &= np.asarray(best.pivots) == tile.pivot
                near = np.flatnonzero(possible)
                question, at, looked = _candidates(tile, best, near, margin)
                if seen is not None:
                    seen[0].add(len(tile.raw) * len(possible))
                    seen[1].add(len(tile.raw) * len(possible) - looked)
                for s in range(0, len(at), exact):
                    r, q = at[s : s + exact], question[s : s + exact]
                    sim = row_cosine(tile.raw[r], best.raw[q])
                    kept = sim >= best.floor[q]
                    best.add(q[kept], sim[kept], tile.ids.take(pa.array(r[kept])))
        for (_, group), best in blocks.items():
            best.trim()
            for rows in best.held:
                yield pa.RecordBatch.from_arrays(
                    [best.ids.take(rows["question"].combine_chunks()), rows["id"].combine_chunks(), rows["sim"].combine_chunks(),
                     pa.array([group] * rows.num_rows, pa.string())], schema=schema)

    return run


#: Vectors of a corpus that it is ordered by, and by which a search finds a question's neighbours first.
PIVOTS = 1024


def order_by_pivots(corpus: DataFrame, dim: int, path: str, pivots: int = PIVOTS) -> None:
    """Write ``corpus(chunk_id, embedding, ...)`` so that neighbours stand together, for searches that skip tiles.

    Every vector goes to the nearest of ``pivots`` vectors of the corpus, chosen by a hash of their ids; the table
    is sorted by pivot over all tasks, a pivot with very many vectors over several. ``path`` then has the points
    and, beside them, the pivots. Any layout gives the same hits; this one lets ``knn`` skip tiles.
    """
    spark = corpus.sparkSession
    chosen = corpus.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots)
    chosen = materialise(chosen, "pivots")
    placed = corpus.withColumn("pivot", _nearest(chosen, dim)(F.col("embedding")))
    placed = placed.repartitionByRange("pivot", F.xxhash64("chunk_id"))
    placed.sortWithinPartitions("pivot").write.parquet(f"{path}/points")
    chosen.write.parquet(f"{path}/pivots")


def _nearest(pivots: DataFrame, dim: int):
    """The number of the pivot that a vector is nearest to; of a bounded table of pivots."""
    table = pivots.select("embedding", "chunk_id").orderBy("chunk_id").limit(16 * PIVOTS).toArrow()
    rows = matrix(table.column("embedding").combine_chunks(), dim) if table.num_rows else np.zeros((1, dim))
    held = pivots.sparkSession.sparkContext.broadcast(_units(np.asarray(rows, np.float64)))

    @F.arrow_udf(T.IntegerType())
    def nearest(vectors: pa.Array) -> pa.Array:
        unit = _units(np.asarray(matrix(vectors, dim), np.float64))
        return pa.array((unit @ held.value.T).argmax(axis=1).astype(np.int32))

    return nearest


def read_ordered(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The points of ``order_by_pivots``, and its pivots."""
    return spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/pivots")


def knn(questions: DataFrame, corpus: DataFrame, k: int, dim: int,
        question_bytes: int = QUESTION_BYTES, tile_bytes: int = TILE_BYTES, pivots: DataFrame | None = None, seen=None,
        group: str | None = None) -> DataFrame:
    """The k most similar chunks of every question, best first, ties by chunk id.

    ``questions(query_id, embedding)`` and ``corpus(chunk_id, embedding)`` give
    ``(query_id, chunk_id, sim, rank)``, written once. Tasks pack questions into blocks of
    checked size and the corpus into tiles, and write both. A task of the search has some blocks
    and passes the tiles by them, so that it sends on k hits of a question and no more: what is shuffled grows
    with the questions alone. Where blocks are fewer than tasks, the tiles are divided, too. Of one block the tiles
    are not written. The corpus is read once and never shuffled, and neither
    questions nor vectors go through the driver unless Spark finds the one block small enough to
    broadcast. Repeated ids are rows of their own.

    A tile that lies too far from a question to hold one of its k best is skipped, which is exact: similarities
    are angles, and angles obey the triangle inequality. It pays for a corpus that is ordered so that
    neighbours share tiles (``order_by_pivots``), given with its ``pivots``: then a first pass
    looks into the tiles of each question's own pivot, reading those alone, and its k-th hits are floors for all tasks of the
    second. Without, work is the product of questions and corpus.

    With a ``group`` column of the corpus, such as the chunker, every group is searched on its own, in the same pass:
    k hits of each question and group, with that column. Floors of a task are kept per group.
    """
    bounded_batches(questions.sparkSession)
    nothing = (F.lit(None).cast("int").alias("pivot"), F.lit(None).cast("double").alias("floor"), F.lit(None).cast("string").alias("group"))
    questions = questions.select("query_id", "embedding")
    if group is not None and pivots is not None:
        raise ValueError("pivots are those of one collection")
    if pivots is None:
        named = nothing[2] if group is None else F.col(group).cast("string").alias("group")
        with temporary(questions.sparkSession):
            found = _hits(questions.select("*", *nothing), corpus.select("chunk_id", "embedding", *nothing[:2], named), k, dim,
                          question_bytes, tile_bytes, False, seen)
            ranked = materialise(_ranked(found, k), "hits", outlive=True)
        return ranked.drop("group") if group is None else ranked.withColumnRenamed("group", group)
    with temporary(questions.sparkSession):
        near = questions.withColumn("pivot", _nearest(pivots, dim)(F.col("embedding")))
        near = materialise(near.withColumns({"floor": nothing[1], "group": nothing[2]}), "questions-by-pivot")
        points = corpus.select("chunk_id", "embedding", "pivot", *nothing[1:])
        wanted = [r.pivot for r in near.select("pivot").distinct().collect()]  # at most as many as pivots
        first = _ranked(_hits(near, points.filter(F.col("pivot").isin(wanted)), k, dim, question_bytes, tile_bytes, True, None), k)
        floors = first.groupBy("query_id").agg(F.min("sim").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        floors = materialise(floors.select("query_id", "floor"), "floors")
        known = near.drop("floor").join(floors, "query_id", "left").select("query_id", "embedding", "pivot", "floor", "group")
        found = _ranked(_hits(known, points, k, dim, question_bytes, tile_bytes, False, seen), k)
        return materialise(found.drop("group"), "hits", outlive=True)


#: Rows of megabytes are written a few to a row group, which Spark reads as a whole.
_FEW_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}


def _hits(questions: DataFrame, corpus: DataFrame, k: int, dim: int, question_bytes: int, tile_bytes: int, own: bool, seen) -> DataFrame:
    """(query_id, chunk_id, sim, group): what tasks find of (id, embedding, pivot, floor, group)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType(
        [questions.schema["query_id"], corpus.schema["chunk_id"], T.StructField("sim", T.DoubleType()), T.StructField("group", T.StringType())]
    )
    spark = questions.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    wanted = _blocks(questions.count(), max(1, question_bytes // (8 * max(1, dim))), k, tasks)
    dealt = questions.repartition(wanted) if wanted > 1 else questions
    blocks = _packed(dealt, "query", dim, question_bytes).drop("query_ball", "query_group")
    blocks = materialise(blocks, "question-blocks", **_FEW_ROWS)
    tiles = _packed(corpus, "chunk", dim, tile_bytes, True).drop("chunk_floors")
    n = blocks.count()
    if n <= 1:
        pairs = tiles.crossJoin(blocks.coalesce(1))
    else:
        parts = min(n, max(tasks, -(-n // TASK_BLOCKS)))
        tiles = materialise(tiles, "tiles", **_FEW_ROWS).coalesce(max(1, tasks // parts))
        # By range, which gives every task as many; dealt out in turn, some would have several and others none.
        pairs = tiles.crossJoin(blocks.repartitionByRange(parts, "query_run").hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(_search(k, dim, to_arrow_schema(out), (_element(corpus), _element(questions)), own, seen), out)


def _blocks(n: int, most: int, k: int, tasks: int) -> int:
    """How many blocks ``n`` questions are dealt out to, so that all tasks have as many and tiles meet few, large ones.

    A block has at most ``most`` questions, a quarter of that where their hits would be more than ``_BLOCK_HITS``. Questions
    that are fewer than a quarter for every task are dealt out in quarters. A tenth is left for uneven dealing.
    """
    quarter = max(1, most // 4)
    room = min(most, max(quarter, _BLOCK_HITS // k)) * 9 // 10 or 1
    if n <= tasks * quarter:
        return -(-n // quarter)
    parts = max(tasks, -(-n // (room * TASK_BLOCKS)))
    return parts * -(-n // (room * parts))


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    """The first k of each question and group; a task sends at most k of each, so that their rows are few."""
    by_query = Window.partitionBy("query_id", "group").orderBy(F.desc("sim"), "chunk_id")
    return partial.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)


def merge_hits(stored: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k best of two lists of hits of each question, as ``knn`` over both corpora would give them.

    ``(query_id, chunk_id, sim, rank)`` of points that are in one corpus only. A question's list has at most k rows
    on either side, so the merge is a window over 2k.
    """
    columns = ["query_id", "chunk_id", "sim"]
    both = stored.select(*columns).unionByName(found.select(*columns))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id"))
    return both.withColumn("rank", place).filter(F.col("rank") <= k)


class StoredHits:
    """The k best hits of a set of questions, kept in a folder and brought up to date by what is appended.

    Every generation is a table of its own, and the newest complete one counts, so an update that fails leaves
    the one before. Only new points are searched: those of an upload, each to be given once.
    """

    def __init__(self, path: str, k: int, dim: int):
        self.path, self.k, self.dim = path.rstrip("/"), k, dim

    def _generations(self, spark) -> list[int]:
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = jvm.Path(self.path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [f.getPath() for f in files.listStatus(folder)]
        return sorted(int(p.getName()) for p in names if p.getName().isdigit() and files.exists(jvm.Path(p, "_SUCCESS")))

    def read(self, spark) -> DataFrame | None:
        made = self._generations(spark)
        return spark.read.parquet(f"{self.path}/{made[-1]:08}") if made else None

    def add(self, questions: DataFrame, points: DataFrame) -> DataFrame:
        """Search ``points`` alone, merge with what is kept, and keep that."""
        spark = questions.sparkSession
        found, stored = knn(questions, points, self.k, self.dim), self.read(spark)
        made = self._generations(spark)
        path = f"{self.path}/{made[-1] + 1 if made else 0:08}"
        (found if stored is None else merge_hits(stored, found, self.k)).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def attach(hits: DataFrame, payload: DataFrame) -> DataFrame:
    """Add payload columns, such as the text, to ranked hits by ``chunk_id``.

    The payload is cut down to the winners where it is read if Spark finds their ids small
    enough to broadcast, which it knows since hits are a written table; larger ones meet the
    payload in a shuffle.
    """
    wanted = hits.select("chunk_id").distinct()
    return hits.join(payload.join(wanted, "chunk_id", "left_semi"), "chunk_id", "left")


def attach_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """As ``attach``, for texts that are much larger than ``hits``, a written table.

    A Bloom filter of the winners' ids goes over the texts where they are read, so that hardly any others
    are shuffled.
    """
    return attach(hits, among(texts, hits, ["chunk_id"]))


def _neighbours(questions: DataFrame, corpus: DataFrame, k: int, dim: int, group: str | None) -> DataFrame:
    """Hits of ``knn``; with a group their ``query_id`` is the pair of question and group."""
    if group is None:
        return knn(questions, corpus, k, dim)
    return knn(questions, corpus, k, dim, group=group).withColumn("query_id", F.struct("query_id", group)).drop(group)


def _scores(questions: DataFrame, corpus: DataFrame, dim: int, score: Callable[[DataFrame], DataFrame], k: int, group: str | None) -> DataFrame:
    """The over-fetched hits with their scores, written once; the hits before them are not kept."""
    with temporary(questions.sparkSession):
        return materialise(score(_neighbours(questions, corpus, OVERFETCH * k, dim, group)), "scores", outlive=True)


def retrieve(
    questions: DataFrame,
    corpus: DataFrame,
    dim: int,
    k: int = 5,
    use_filtering: bool = False,
    score: Callable[[DataFrame], DataFrame] | None = None,
    group: str | None = None,
) -> DataFrame:
    """Retrieval for all questions: top k, or a 3k over-fetch cut by relevance.

    ``score`` takes the ranked hits and adds ``final_score``; it is needed when
    filtering. Returns the hits with ``position``, 1 for the first result. With a ``group`` column of the
    corpus each group is a collection of its own, and ``query_id`` the pair of question and group.
    """
    if not use_filtering:
        return _neighbours(questions, corpus, k, dim, group).withColumn("position", F.col("rank"))
    if score is None:
        raise ValueError("filtering needs a score function")
    scored = _scores(questions, corpus, dim, score, k, group)
    return filter_by_relevance(scored, min_chunks=k).filter(F.col("position") <= k)


def retrieve_both(
    questions: DataFrame, corpus: DataFrame, dim: int, score: Callable[[DataFrame], DataFrame], k: int = 5, group: str | None = None,
) -> DataFrame:
    """Baseline and filtered results out of one search, told apart by ``mode``.

    The first k of 3k neighbours are the k neighbours, so one search serves both.
    """
    judged = judge(_scores(questions, corpus, dim, score, k, group), min_chunks=k)
    places = F.array(
        F.struct(F.lit("baseline").alias("mode"), F.col("rank").alias("position")),
        F.struct(F.lit("filtered").alias("mode"), F.col("position")),
    )
    return (
        judged.withColumn("result", F.explode(places))
        .drop("position")
        .select("*", "result.mode", "result.position")
        .drop("result")
        .filter(F.col("position") <= k)
    )


def hit_preview(hits: DataFrame) -> DataFrame:
    """Rank, score to four places and the first 150 characters on one line."""
    return hits.select(
        "query_id",
        "rank",
        "chunk_id",
        F.round("sim", 4).alias("score"),
        preview(F.col("text"), 150).alias("preview"),
    )


def compare_retrieval(baseline: DataFrame, filtered: DataFrame) -> DataFrame:
    """Which chunks both retrievals keep, with the position in each."""
    keys = ["query_id", "chunk_id"]
    left = baseline.select(*keys, F.col("position").alias("baseline_position"))
    right = filtered.select(*keys, F.col("position").alias("filtered_position"))
    kept = (
        F.when(F.col("baseline_position").isNull(), "filtered")
        .when(F.col("filtered_position").isNull(), "baseline")
        .otherwise("both")
    )
    return left.join(right, keys, "full").withColumn("kept_by", kept)
