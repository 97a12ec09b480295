"""Phrases of two and three words that occur together more often than their parts alone would.

Counting follows the plan of a suffix tree built by vertical partitions. Every word position is a suffix, cut
off after three words. Prefixes, at first single words, are put into groups whose occurrences
fit a memory budget; a prefix beyond the budget is extended by its next word, and so on. Every group's
subtree is built alone, in the order of its sorted suffixes, and the counts of all phrases are
the totals of its leaves. What a task reads twice it sends once, with a count.

Words are known by 64-bit keys that depend on the language, too. Two words with one key would be
found in the table of all words; the keys are then made anew from another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contextmill.llm.pretokens import gather
from contextmill.llm.words import Splitter, commonest, give_back, mix, slices, tidy
from contextmill.session import materialise

#: Occurrences in a group: its subtree takes some 100 MB.
GROUP_WORDS = 1 << 20
#: The commonest words have short codes in what is shuffled; all others are listed.
CODES = 1 << 16
#: A language's phrases are ranked in this many parts first.
SALTS = 16
#: Elements looked at together; their distinct ones are numbered in 21 bits.
_BITS, _HELD = 21, 3 << 18
_MOST = (1 << _BITS) - 8

_PIECE_BREAKS = b".,;:!?\n\v\f\r"
#: No language.
UNDETERMINED = "und"


def _seed(lang: str, turn: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{turn}:{lang}".encode(), digest_size=8).digest(), "little")


class Text:
    """The words of some texts, in order, as keys; ``seq`` has a 0 behind each piece."""

    def __init__(self, splitter: Splitter, langs: list[str], texts: pa.Array, turn: int):
        self.words = words = splitter.split(texts)
        names, of = np.unique(np.array(langs, object), return_inverse=True)
        self.names = names
        self.lang = np.repeat(of, words.counts)
        seeds = np.array([_seed(n, turn) for n in names], np.uint64)
        keys = mix(words.hashes() ^ seeds[self.lang]).astype(np.int64)
        keys[keys == 0] = 1
        self.keys = keys
        breaks = np.zeros(256, bool)
        breaks[list(_PIECE_BREAKS)] = True
        n = len(keys)
        last = np.ones(n, bool)
        if n:
            so_far = np.concatenate(([0], np.cumsum(breaks[words.data])))
            last[:-1] = so_far[words.starts[1:]] > so_far[words.ends[:-1]]
            ends = words.first[1:] - 1
            last[ends[words.counts > 0]] = True
        self.seq = np.zeros(n + int(last.sum()), np.int64)
        self.seq[np.arange(n) + np.concatenate(([0], np.cumsum(last)))[:n]] = keys

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at these places, in lower case."""
        lengths = self.words.ends[at] - self.words.starts[at]
        flat = gather(self.words.data, self.words.starts[at], lengths).tobytes().translate(self.words.splitter.lower)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(flat))


def _texts(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[Text]:
    splitter = Splitter(b" \t" + _PIECE_BREAKS, fold=True)
    for batch in batches:
        for part in slices(batch, "text"):
            yield Text(splitter, part.column("lang").to_pylist(), part.column("text"), turn)


def _blocks(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, suffixes, counts) of runs of text: distinct suffixes of three places in ``keys``.

    A suffix is one number with a field of 21 bits for each word, 0 after its end, else one more than the
    place of the key. As keys are sorted, so are suffixes by the keys of their words.
    """

    def block(seq: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, at = np.unique(seq, return_inverse=True)
        place = np.arange(1, len(keys) + 1)
        if (zero := np.searchsorted(keys, 0)) < len(keys) and keys[zero] == 0:
            keys = np.delete(keys, zero)
            place[zero:] -= 1
            place[zero] = 0
        one = np.append(place[at], [0, 0])
        two = one[1 : n + 1]
        three = np.where(two > 0, one[2 : n + 2], 0)
        packed = (one[:n] << (2 * _BITS)) | (two << _BITS) | three
        found, counts = np.unique(packed[one[:n] > 0], return_counts=True)
        return keys, found, counts

    def cut(held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        seq = np.concatenate(held)
        for a in range(0, len(seq), _MOST):
            yield block(seq[a : a + _MOST + 2], min(_MOST, len(seq) - a))

    held: list[np.ndarray] = []
    for text in _texts(batches, turn):
        held.append(text.seq)
        if sum(map(len, held)) >= _HELD:
            yield from cut(held)
            held = []
            give_back()
    if held:
        yield from cut(held)


def word_table(docs: DataFrame, turn: int = 0) -> DataFrame:
    """(key, lang, word, n, clash): every word of every language, ``clash`` if a key has two of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Text] = []

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([t.keys for t in held])
            begin = np.concatenate(([0], np.cumsum([len(t.keys) for t in held])))
            found, at, n = np.unique(keys, return_index=True, return_counts=True)
            order = np.argsort(at, kind="stable")
            found, at, n = found[order], at[order], n[order]
            edges = np.searchsorted(at, begin)
            words, langs = [], []
            for t, a, b, first in zip(held, edges[:-1], edges[1:], begin):
                words.append(t.strings(at[a:b] - first))
                langs.append(pa.array(t.names, pa.string()).take(pa.array(t.lang[at[a:b] - first])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found), pa.concat_arrays(langs), pa.concat_arrays(words), pa.array(n)], ["key", "lang", "word", "n"])

        for text in _texts(batches, turn):
            held.append(text)
            if sum(len(t.keys) for t in held) >= _HELD:
                yield flush()
                give_back()
        if held:
            yield flush()

    counted = docs.mapInArrow(tidy(count), "key bigint, lang string, word string, n bigint")
    name = F.struct("lang", "word")
    grouped = counted.groupBy("key").agg(F.min(name).alias("name"), F.max(name).alias("other"), F.sum("n").alias("n"))
    return grouped.select("key", "name.lang", "name.word", "n", (F.col("name") != F.col("other")).alias("clash"))


def cut_groups(prefixes: DataFrame, budget: int) -> np.ndarray:
    """The first key of every group of (key, n), in order: neighbours until the budget is full.

    Keys are sorted over the cluster and every part of them is cut where it is; the driver gets eight
    bytes per group.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = -1
        for batch in batches:
            keys, n = np.asarray(batch.column("key")), np.asarray(batch.column("n"))
            total, at, firsts = np.cumsum(n), 0, []
            while at < len(n):
                before = total[at - 1] if at else 0
                if room < n[at]:
                    firsts.append(at)
                    room = budget
                end = max(at + 1, int(np.searchsorted(total, before + room, "right")))
                room -= int(total[end - 1] - before)
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(keys[firsts], pa.int64())], ["key"])

    ordered = prefixes.select("key", "n").repartitionByRange("key").sortWithinPartitions("key")
    found = ordered.mapInArrow(cut, "key bigint").toArrow().column("key")
    return np.sort(np.asarray(found, np.int64))


def _pair_key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(two.astype(np.uint64))).astype(np.int64)


class Partition:
    """Which group each suffix belongs to: by one word, by two where one is beyond the budget, or by all."""

    def __init__(self, firsts: np.ndarray, hot: np.ndarray):
        self.firsts, self.hot = firsts, np.sort(hot)
        self.pair_firsts = np.zeros(0, np.int64)
        self.hot_pairs: np.ndarray = np.zeros(0, np.int64)  # keys of pairs
        self.last_groups = 0

    @property
    def by_pair(self) -> int:
        """The first group of longer prefixes."""
        return len(self.firsts) + 1

    @property
    def by_all(self) -> int:
        return self.by_pair + len(self.pair_firsts) + 1

    def groups(self, keys: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        """Of suffixes as places in ``keys`` (-1 for no word); -1 where counts are known without them."""
        own = np.searchsorted(self.firsts, keys, "right")
        group = own[one].astype(np.int64)
        hot = np.flatnonzero(np.isin(keys, self.hot)[one])
        if len(hot):
            a, b, c = one[hot], two[hot], three[hot]
            pair = _pair_key(keys[a], np.where(b >= 0, keys[b], 0))
            to = self.by_pair + np.searchsorted(self.pair_firsts, pair, "right")
            whole = np.isin(pair, self.hot_pairs)
            if self.last_groups:
                third = _pair_key(pair, np.where(c >= 0, keys[c], 0)).astype(np.uint64)
                to = np.where(whole, self.by_all + (third % np.uint64(self.last_groups)).astype(np.int64), to)
            group[hot] = np.where((b < 0) | (whole & (c < 0)), -1, to)
        return group


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << _BITS) - 1
    return tuple(((packed >> (shift * _BITS)) & mask) - 1 for shift in (2, 1, 0))


def _hot_pairs(docs: DataFrame, hot: np.ndarray, turn: int) -> DataFrame:
    """(one, two, n): how often each word follows each of the ``hot`` ones."""
    held = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, packed, n in _blocks(batches, turn):
            one, two, _ = _unpack(packed)
            some = np.flatnonzero(np.isin(keys, held.value)[one] & (two >= 0))
            pairs, first, back = np.unique(packed[some] >> _BITS, return_index=True, return_inverse=True)
            total = np.bincount(back, n[some], len(pairs)).astype(np.int64)
            some = some[first]
            yield pa.RecordBatch.from_arrays([pa.array(keys[one[some]]), pa.array(keys[two[some]]), pa.array(total)], ["one", "two", "n"])

    counted = docs.mapInArrow(tidy(count), "one bigint, two bigint, n bigint")
    return counted.groupBy("one", "two").agg(F.sum("n").alias("n"))


def grouped_suffixes(docs: DataFrame, partition: Partition, common: np.ndarray, turn: int) -> DataFrame:
    """A row per run of text and group: its distinct suffixes and their counts, words as codes.

    A code above 0 is the rank of a ``common`` word, 0 is no word, and one below 0 is a place in ``words``.
    """
    context = docs.sparkSession.sparkContext
    held, short = context.broadcast(partition), context.broadcast(common)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, order = held.value, np.argsort(short.value)
        ranked = short.value[order]
        for keys, packed, n in _blocks(batches, turn):
            columns = np.stack(_unpack(packed))
            group = part.groups(keys, *columns)
            sorted_by = np.argsort(group, kind="stable")
            sorted_by = sorted_by[np.searchsorted(group[sorted_by], 0) :]
            group, columns, n = group[sorted_by], columns[:, sorted_by], n[sorted_by]
            if not len(group):
                continue
            code = np.zeros(len(keys) + 1, np.int64)  # the last one is for no word
            if len(ranked):
                at = np.minimum(np.searchsorted(ranked, keys), len(ranked) - 1)
                code[:-1] = np.where(ranked[at] == keys, order[at] + 1, -1)
            else:
                code[:-1] = -1
            coded = code[columns]
            edges = np.flatnonzero(np.diff(group, prepend=-1))
            run = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(group))))
            row, place = np.nonzero(coded < 0)
            listed, back = np.unique(run[place] * len(keys) + columns[row, place], return_inverse=True)
            begin = np.searchsorted(listed, np.arange(len(edges) + 1) * len(keys))
            coded[row, place] = -1 - (back - begin[run[place]])
            offsets = pa.array(np.append(edges, len(group)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in (*coded, n)]
            words = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(keys[listed % len(keys)]))
            yield pa.RecordBatch.from_arrays([pa.array(group[edges]), *lists, words], ["group", "one", "two", "three", "n", "words"])

    kind = "group bigint, one array<int>, two array<int>, three array<int>, n array<int>, words array<bigint>"
    return docs.mapInArrow(tidy(collect), kind)


def subtree(one: np.ndarray, two: np.ndarray, three: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The subtree of suffixes, key by key (0 after the end), as (first suffix, total) of each node by depth.

    Suffixes are sorted in place; a node begins where a suffix parts from the one before it, and its total is
    that of its leaves.
    """
    order = np.lexsort((three, two, one))
    for column in (one, two, three, n):
        column[:] = column[order]
    fresh = np.zeros(len(one), bool)
    nodes = []
    for column in (one, two, three):
        fresh[:1] = True
        fresh[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(fresh)
        total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        real = column[first] != 0
        nodes.append((first[real], total[real]))
    return nodes


def phrase_counts(docs: DataFrame, words: DataFrame, least: int, budget: int = GROUP_WORDS, turn: int = 0) -> DataFrame:
    """(one, two, three, n): every phrase of two or three words, by keys, with ``n`` of ``least`` or more.

    ``three`` is 0 in phrases of two.
    """
    common = np.array([r.key for r in commonest(words, "key", CODES).orderBy(F.desc("n"), "key").select("key").collect()], np.int64)
    hot = [r.key for r in words.filter(F.col("n") > budget).select("key").collect()]  # at most total / budget
    partition = Partition(cut_groups(words.filter(F.col("n") <= budget), budget), np.array(hot, np.int64))
    known = None
    if hot:
        known = materialise(_hot_pairs(docs, partition.hot, turn), "pairs")
        beyond = known.filter(F.col("n") > budget).toPandas()  # at most total / budget
        partition.hot_pairs = np.sort(_pair_key(beyond["one"].to_numpy(), beyond["two"].to_numpy()))
        partition.last_groups = -(-int(beyond["n"].sum()) // budget)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pair = _pair_key(np.asarray(b.column("one")), np.asarray(b.column("two")))
                yield pa.RecordBatch.from_arrays([pa.array(pair), b.column("n")], ["key", "n"])

        partition.pair_firsts = cut_groups(known.filter(F.col("n") <= budget).mapInArrow(keyed, "key bigint, n bigint"), budget)
    names = docs.sparkSession.sparkContext.broadcast(common)
    by_pair, by_all = partition.by_pair, partition.by_all

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = {c: table.column(c).combine_chunks() for c in ("one", "two", "three", "n", "words")}
        listed = np.asarray(lists["words"].flatten(), np.int64)
        begin = np.concatenate(([0], np.cumsum(np.asarray(lists["words"].value_lengths(), np.int64))))
        row = np.repeat(np.arange(table.num_rows), np.asarray(lists["n"].value_lengths()))
        # Codes to keys: common words by rank, no word, words of the row.
        every = np.concatenate((listed, [0], names.value))

        def keys(column: str) -> np.ndarray:
            code = np.asarray(lists[column].flatten(), np.int64)
            return every[np.where(code < 0, begin[row] - 1 - code, len(listed) + code)]

        columns = [keys(c) for c in ("one", "two", "three")]
        n = np.asarray(lists["n"].flatten(), np.int64).copy()
        nodes = subtree(*columns, n)
        group = table.column("group")[0].as_py()
        # Pairs with a hot first word are counted already.
        depths = (2, 3) if group < by_pair else (3,)
        parts = []
        for depth in depths:
            first, total = nodes[depth - 1]
            first, total = first[total >= least], total[total >= least]
            third = columns[2][first] if depth == 3 else np.zeros(len(first), np.int64)
            parts.append((columns[0][first], columns[1][first], third, total))
        out = [np.concatenate(x) for x in zip(*parts)]
        return pa.Table.from_arrays([pa.array(x) for x in out], ["one", "two", "three", "n"])

    kind = "one bigint, two bigint, three bigint, n bigint"
    suffixes = grouped_suffixes(docs, partition, common, turn)
    counts = suffixes.groupBy("group").applyInArrow(build, kind)
    if known is not None:
        counts = counts.unionByName(known.filter(F.col("n") >= least).withColumn("three", F.lit(0).cast("long")))
    return counts


def collocations(
    docs: DataFrame, least: int = 10, scale: int = 1_000_000, cover_percent: int = 50, top: int = 2000,
    text: str = "text", lang: str = "lang", budget: int = GROUP_WORDS, make_words: Callable[[DataFrame, int], DataFrame] = word_table,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language.

    A-Z count as a-z; pieces end at ``.,;:!?`` and line ends, words are what blanks and tabs part. A
    phrase occurs ``a`` times; its weakest cut has parts that occur ``l`` and ``r`` times; ``score`` is
    ``scale * a * a // (l * r)``, exact. Phrases that a longer candidate covers by ``cover_percent`` are
    left out. NULL languages are ``und``, NULL texts have no words. Rows are counted as often as they
    are repeated; an empty table has no phrases. A very long text is scanned as one slice, some
    30 times its bytes, and its words are counted in runs.
    """
    held = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col(text).alias("text"))
    for turn in range(8):
        words = materialise(make_words(held, turn), "words")
        if words.filter("clash").isEmpty():
            break
    else:
        raise ValueError("words share keys under every seed")
    counts = materialise(phrase_counts(held, words, least, budget, turn), "phrases")
    single = words.filter(F.col("n") >= least).select("key", "n")
    pairs = counts.filter("three = 0").select("one", "two", F.col("n").alias("a"))
    triples = counts.filter("three <> 0").withColumnRenamed("n", "a")

    def of(key: str, name: str) -> DataFrame:
        return single.select(F.col("key").alias(key), F.col("n").alias(name))

    def of_pair(one: str, two: str, name: str) -> DataFrame:
        return pairs.select(F.col("one").alias(one), F.col("two").alias(two), F.col("a").alias(name))

    def score(left: str, right: str):
        exact = lambda c: F.col(c).cast("decimal(15,0)")
        return F.call_function("div", F.lit(scale).cast("decimal(7,0)") * exact("a") * exact("a"), exact(left) * exact(right))

    around = triples.select(F.inline(F.array(
        F.struct("one", "two", "a"), F.struct(F.col("two").alias("one"), F.col("three").alias("two"), "a"))))
    around = around.groupBy("one", "two").agg(F.max("a").alias("longer"))
    apart = pairs.join(around, ["one", "two"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
    apart = apart.join(of("one", "l"), "one").join(of("two", "r"), "two").select(
        "one", "two", F.lit(0).cast("long").alias("three"), "a", "l", "r", score("l", "r").alias("score"))
    longer = (
        triples.join(of_pair("one", "two", "l2"), ["one", "two"]).join(of_pair("two", "three", "r1"), ["two", "three"])
        .join(of("one", "l1"), "one").join(of("three", "r2"), "three")
        .withColumn("first", score("l1", "r1")).withColumn("second", score("l2", "r2"))
    )
    second = F.col("second") < F.col("first")
    longer = longer.select(
        "one", "two", "three", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("first", "second").alias("score"))
    name = words.select(F.col("key").alias("one"), "lang", F.col("word").alias("w1"))
    scored = apart.unionByName(longer).join(name, "one")
    # Words are only fetched for phrases that can be among the best: ties with the last one stay.
    near, by_score = scored.withColumn("salt", F.pmod(F.xxhash64("one", "two", "three"), F.lit(SALTS))), [F.desc("score"), F.desc("a")]
    for parts in (["lang", "salt"], ["lang"]):
        best = Window.partitionBy(*parts).orderBy(*by_score)
        near = near.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top)
    for column, word in (("two", "w2"), ("three", "w3")):
        near = near.join(words.select(F.col("key").alias(column), F.col("word").alias(word)), column, "left")
    phrase = F.concat_ws(" ", "w1", "w2", "w3")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*by_score, "phrase"))
    ranked = near.withColumn("phrase", phrase).withColumn("rank", place)
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
