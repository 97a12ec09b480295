"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

Documents with the same n-gram set are copies and go on as one representative. Band hashes of
the representatives are shuffled; buckets that hold the same members in several bands are
looked at once. The members of a bucket are cut into blocks of bounded rows and bytes, and every
pair of blocks is one task's work: it compares full n-gram sets there and hands on, for each
member, how many texts it is similar to and one edge to its group. The number of rows that leave
a bucket therefore grows with its members, not with their pairs, and no pair is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.llm.words import Words, alphanumeric, mix, slices, tidy
from contextmill.session import materialise

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.998
#: Hash functions at most.
HASHES = 128
#: Members and bytes of text of one block of a bucket.
BLOCK_ROWS, BLOCK_BYTES = 128, 8 << 20
_COLUMNS = 4096


def bands_for(similarity: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds pairs at the threshold with the recall."""
    best = None
    for rows in range(1, hashes + 1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                best = bands, rows
                break
    if best is None:
        raise ValueError(f"no banding of {hashes} hashes has recall {recall}")
    return best


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of words, the first one of each text and the end).

    A text of fewer words is one run as a whole; one without words has none.
    """
    hashes = words.hashes()
    at = words.fits(size)
    long = words.windows(hashes, size)[at]
    counts = np.maximum(words.counts - size + 1, 0)
    short = (words.counts > 0) & (words.counts < size)
    if short.any():
        whole = np.zeros(len(words.counts), np.uint64)
        for n in range(1, size):
            own = np.flatnonzero(words.counts == n)
            if len(own):
                whole[own] = words.windows(hashes, n)[words.first[own]]
        begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
        long = np.insert(long, begin[short], whole[short])
        counts = counts + short
    return long, np.concatenate(([0], np.cumsum(counts)))


def distinct_sets(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats, and where they begin."""
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[fresh], np.searchsorted(of[fresh], np.arange(len(begin)))


def minhashes(values: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """n x texts least values under n hash functions; texts without values get the largest."""
    out = np.full((n, len(begin) - 1), np.iinfo(np.uint32).max, np.uint32)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (values >> np.uint64(32)).astype(np.uint32)
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    for i in range(n):
        mixed = low * seeds[2 * i] + high * seeds[2 * i + 1]
        mixed ^= mixed >> np.uint32(15)
        mixed *= seeds[2 * i]
        out[i, full] = np.minimum.reduceat(mixed, begin[full])
    return out


def signatures(docs: DataFrame, size: int, bands: int, rows: int, wordless_apart: bool = False) -> DataFrame:
    """(doc_id, row, bytes, set_id, wordless, bands): per row its n-gram set's digest and band hashes.

    With ``wordless_apart`` the digest of a text without words is that of the text, without the
    white space around it and with one space for each run inside.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = alphanumeric()
        for batch in batches:
            for part in slices(batch, "text"):
                words = splitter.split(part.column("text"))
                values, begin = distinct_sets(*shingles(words, size))
                least = minhashes(values, begin, bands * rows).astype(np.uint64)
                keys = np.empty((part.num_rows, bands), np.int64)
                for b in range(bands):
                    key = np.full(part.num_rows, b + 1, np.uint64)
                    for r in range(rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[b * rows + r])
                    keys[:, b] = key.astype(np.int64)
                data = values.tobytes()
                sets = [
                    hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest()
                    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())
                ]
                if wordless_apart:
                    for t in np.flatnonzero(words.counts == 0).tolist():
                        plain = b" ".join((part.column("text")[t].as_py() or "").encode().split())
                        sets[t] = hashlib.blake2b(plain, digest_size=16, person=b"wordless").digest()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("row"),
                        pa.array(np.diff(words.begin) - 1, pa.int64()),
                        pa.array(sets, pa.binary()), pa.array(words.counts == 0),
                        pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * bands, pa.array(keys.ravel())),
                    ],
                    ["doc_id", "row", "bytes", "set_id", "wordless", "bands"],
                )

    return docs.select("doc_id", "row", "text").mapInArrow(
        tidy(sign), "doc_id bigint, row bigint, bytes bigint, set_id binary, wordless boolean, bands array<bigint>")


def _compare(size: int, similarity: float):
    """Function on one pair of blocks of a bucket: edges and link counts of its members."""

    splitter = alphanumeric()  # its tables grow once in a task

    def links(table: pa.Table) -> pa.Table:
        side, rep = (np.asarray(table.column(c), np.int64) for c in ("side", "rep"))
        copies = np.asarray(table.column("copies"), np.int64)
        bands = np.stack([np.asarray(x.values) for x in table.column("bands")])
        band, j = table.column("band")[0].as_py(), int(table.column("j")[0].as_py())
        words = splitter.split(table.column("text").combine_chunks())
        values, begin = distinct_sets(*shingles(words, size))
        sizes = np.diff(begin)
        # Only n-grams of two members or more can be common; they are compared some at a time.
        _, place, n = np.unique(values, return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(sizes)), sizes)
        shared = n[place] > 1
        column = (np.cumsum(n > 1) - 1)[place[shared]]
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[shared][order]
        common = np.zeros((len(sizes), len(sizes)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
            a, b = np.searchsorted(column, [low, low + _COLUMNS])
            has = np.zeros((len(sizes), _COLUMNS), np.float32)
            has[of[a:b], column[a:b] - low] = 1
            common += has @ has.T
        common = common.astype(np.float64)
        similar = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        # Each pair once: in the first band that joins the two, and across sides if there are two.
        for earlier in range(band):
            similar &= bands[:, None, earlier] != bands[None, :, earlier]
        if j != int(table.column("i")[0].as_py()):
            similar &= side[:, None] != side[None, :]
        np.fill_diagonal(similar, False)
        linked = similar.any(axis=1)
        return pa.table({
            "rep": pa.array(rep[linked], pa.int64()),
            "to": pa.array(_roots(similar, rep)[linked], pa.int64()),
            "texts": pa.array(similar.sum(axis=1)[linked], pa.int64()),
            "rows": pa.array((similar * copies[None, :]).sum(axis=1)[linked], pa.int64()),
        })

    return links


def _roots(similar: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The least representative that each member reaches."""
    root = rep.copy()
    while True:
        low = np.minimum(np.where(similar, root[None, :], np.iinfo(np.int64).max).min(axis=1), root)
        if (low == root).all():
            return root
        root = low


def similar_texts(
    signed: DataFrame, docs: DataFrame, size: int, similarity: float, block_rows: int, block_bytes: int
) -> DataFrame:
    """(rep, to, texts, rows) per representative and pair of blocks in which it has links.

    ``signed`` has rep, copies, bytes, bands; ``docs`` has row, text.
    """
    banded = signed.select("rep", "copies", "bytes", F.posexplode("bands").alias("band", "key"))
    seen = F.xxhash64("rep")
    members = F.struct(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(seen).alias("x"),
                       F.sum(F.shiftrightunsigned(seen, 34)).alias("s"), F.min("rep").alias("m"))
    buckets = banded.groupBy("band", "key").agg(members.alias("members")).filter("members.n > 1")
    # Buckets with the same members are one; the first band stays, where each of its pairs counts.
    once = buckets.groupBy("members").agg(F.min(F.struct("band", "key")).alias("b"))
    blocks = F.ceil(F.greatest(F.col("members.n") / block_rows, F.col("members.bytes") / block_bytes)).cast("int")
    chosen = once.select("b.band", "b.key", blocks.alias("blocks"))
    cut = banded.select("rep", "band", "key").join(chosen, ["band", "key"])
    mine = cut.withColumn("mine", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("blocks")).cast("int"))
    spread = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = materialise(spread.select(
        "rep", "band", "key",
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
    ), "buckets")
    wanted = signed.join(placed.select("rep").distinct(), "rep", "left_semi").select("rep", "copies", "bands")
    texts = docs.select(F.col("row").alias("rep"), "text").join(wanted, "rep")
    work = placed.join(texts, "rep")
    return work.groupBy("band", "key", "i", "j").applyInArrow(
        _compare(size, similarity), "rep bigint, to bigint, texts bigint, rows bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node it reaches.

    Each round points nodes to the least root around them and then shortcuts twice; a round is
    written before the next, so lineage stays short and lost executors only re-read a table.
    """
    edges = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = materialise(nodes.select("node", F.col("node").alias("root")), "components")
    while True:
        # Both ends of each edge learn the lesser of their roots, and so do the roots themselves.
        left = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        both = left.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").filter("ra != rb")
        hooks = both.groupBy(F.greatest("ra", "rb").alias("node")).agg(F.min(F.least("ra", "rb")).alias("low"))
        hooks = materialise(hooks, "components")
        if not hooks.limit(1).count():
            return roots
        while True:  # chains of hooked roots
            up = hooks.select(F.col("node").alias("low"), F.col("low").alias("higher"))
            next_hooks = materialise(hooks.join(up, "low", "left").select(
                "node", F.coalesce("higher", "low").alias("low"), F.col("higher").isNotNull().alias("moved")), "components")
            moved = next_hooks.filter("moved").limit(1).count()
            hooks = next_hooks.drop("moved")
            if not moved:
                break
        roots = materialise(roots.join(hooks.withColumnRenamed("node", "root"), "root", "left").select(
            "node", F.coalesce("low", "root").alias("root")), "components")


def ngram_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, similarity: float = SIMILARITY,
    recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, wordless_apart: bool = False,
) -> DataFrame:
    """One row per document row: doc_id, class_id, copy_id, n_copies, n_links, n_linked_texts, row.

    ``copy_id`` is the least id of the rows with the same n-gram set, ``n_copies`` their number;
    ``n_linked_texts`` counts other n-gram sets of Jaccard similarity ``similarity`` or more,
    ``n_links`` all other rows linked, copies included; ``class_id`` is the least id reached over
    links. Words are runs of letters and digits, A-Z as a-z. NULL, empty and wordless texts have
    the same (empty) set, so they are copies of each other and linked to nothing else; with
    ``wordless_apart`` only those whose texts are equal up to white space are copies. A text
    of fewer words than an n-gram is one n-gram. Rows may repeat; a NULL id is larger than any
    other. ``docs`` must yield its rows in the same partitions each time, as a written table
    does. Other columns are not read. A text is read as a whole: one very long text is a slice of its own and takes
    some 30 times its bytes in its task.
    """
    bands, rows = bands_for(similarity, recall)
    source = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    signed = materialise(signatures(source, size, bands, rows, wordless_apart), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    sets = materialise(
        signed.groupBy("set_id").agg(first.alias("first"), F.count("*").alias("copies"))
        .select("set_id", F.col("first.row").alias("rep"), F.col("first.doc_id").alias("copy_id"), "copies"), "sets")
    reps = materialise(signed.filter("not wordless").drop("set_id", "doc_id", "wordless").withColumnRenamed("row", "rep").join(
        sets.select("rep", "copies"), "rep"), "representatives")
    links = materialise(
        similar_texts(reps, source.select("row", "text"), size, similarity, block_rows, block_bytes), "links")
    counts = links.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("others"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    # The least document id of a component, not the least row.
    known = sets.select("rep", "copy_id")
    low = roots.join(known, roots.node == known.rep).groupBy("root").agg(
        F.min(F.struct(F.col("copy_id").isNull(), "copy_id", "node")).alias("low"))
    classes = roots.join(low, "root").select(F.col("node").alias("rep"), F.col("low.copy_id").alias("class_id"), F.col("low.node").alias("class_row"))
    about = materialise(
        sets.join(classes, "rep", "left").join(counts, "rep", "left").select(
            "set_id", "copy_id", "copies", "texts", "others", "rep",
            F.when(F.col("class_row").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_row", "rep").alias("class_row")), "classes")
    return signed.select("doc_id", "row", "set_id").join(about, "set_id").select(
        "doc_id", "class_id", "copy_id", F.col("copies").alias("n_copies"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts"),
        (F.col("row") == F.col("class_row")).alias("first_of_class"),
        "row",
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, the one with the least id; all columns as they were.

    Wordless texts are one class; with ``wordless_apart`` those that differ are all kept.
    """
    mark = "__contextmill_row"
    gone = materialise(ngram_join(docs, key, text, **options).filter("not first_of_class").select(F.col("row").alias(mark)), "near")
    return docs.withColumn(mark, F.monotonically_increasing_id()).join(gone, mark, "left_anti").drop(mark)
