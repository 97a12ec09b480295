"""Byte-level BPE: ranked merges as a fold of Spark's higher-order functions.

The ranks are literals of the plan: which id two neighbouring ids make, by a hash without collisions. Merging
a word is ``aggregate`` over its bytes: each step joins the pair of lowest rank, the leftmost of
equals. Words repeat, so the commonest distinct words are merged once and their ids broadcast, as many as a
fixed bound allows; every other word is merged by the same fold in the row of its document. Decoding
puts the bytes of the pieces one after the other.

A piece of a word is one number in the fold: the id that it makes with the next piece, its first byte, and its id.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.llm.pretokens import Pretokens, character_classes, gather, hash_bases
from contextmill.llm.words import commonest, give_back, slices, small_batches, tidy
from contextmill.session import materialise

#: Distinct words whose ids are broadcast, about and at most: some 20 MB.
MEMO_WORDS = 1 << 19
#: Characters of a word that the fold takes; its steps grow with the square of the length. Longer
#: words, which are hardly words, are merged with a heap in the task that reads them.
FOLD_CHARS = 64
#: Distinct words of slices that are counted together.
_HELD = 1 << 20
#: Bytes of text looked at together, so that their arrays stay in the processor's cache.
_COUNT_BYTES, _LOOK_UP_BYTES = 1 << 18, 1 << 17
#: Documents put together at a time.
_ROWS = 250


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a rank file on the driver: base64 bytes and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


class PairRanks:
    """Which id two neighbouring ids make: ``slots`` found by a hash and what ``moved`` adds for its bucket.

    A slot holds the pair in its upper bits and the id in its lower ones.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bits = max(17, (max(ranks.values(), default=0) + 1).bit_length())
        if self.bits > 20:
            raise ValueError("ids of more than 20 bits")
        made = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    made[(left << self.bits) | right] = rank
        self.size = 1 << max(4, len(made).bit_length())
        self.buckets = max(4, self.size >> 2)
        keys = np.fromiter(made, np.int64, len(made))
        ids = np.fromiter(made.values(), np.int64, len(made))
        turn = 0
        while not self._place(keys, ids, turn):
            turn += 1
            self.size <<= turn % 3 == 0
        #: Words that are pieces as a whole, but that merging does not lead to.
        self.apart = {w: r for w, r in ranks.items() if len(w) > 1 and merge_long(w, ranks) != [r]}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        # Made once: each is some 1.5 MB of plan on the driver.
        self.literals = tuple(_literal(n, k) for n, k in ((self.slots, "bigint"), (self.moved, "int"), (self.single, "bigint")))

    def _place(self, keys: np.ndarray, ids: np.ndarray, turn: int) -> bool:
        spare = 62 - 2 * self.bits
        self.by_slot, self.by_bucket = ((x >> (64 - spare)) + 2 * turn | 1 for x in (0x85EBCA77C2B2AE63, 0x9E3779B97F4A7C15))
        slot, bucket = (keys * self.by_slot >> 17) & (self.size - 1), (keys * self.by_bucket >> 13) & (self.buckets - 1)
        # Nothing has this pair: no id is as large as its right side.
        nothing = ((1 << self.bits) - 1) << self.bits
        self.slots = np.full(self.size + 1024, nothing, np.int64)
        self.moved = np.zeros(self.buckets, np.int64)
        free = np.ones(len(self.slots), bool)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.argsort(-np.diff(edges), kind="stable").tolist():
            own = order[edges[b] : edges[b + 1]]
            if not len(own):
                break
            at = slot[own]
            if len(np.unique(at)) < len(at):
                return False
            for move in range(1024):
                if free[at + move].all():
                    break
            else:
                return False
            self.slots[at + move], free[at + move], self.moved[b] = (keys[own] << self.bits) | ids[own], False, move
        return True


def _literal(numbers, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps([int(n) for n in numbers])), f"array<{kind}>")


def merged_ids(word: Column, ranks: dict[bytes, int] | PairRanks) -> Column:
    """The ids of a word (a string column): array<int>. An empty or NULL word has none."""
    pairs = ranks if isinstance(ranks, PairRanks) else PairRanks(ranks)

    def let(value: Column, body) -> Column:
        """``body`` of a value that is worked out once."""
        return F.transform(F.array(value), body)[0]

    slots, moved, single = pairs.literals
    return let(slots, lambda s: let(moved, lambda m: let(single, lambda one: _fold(word, pairs, s, m, one, let))))


def _fold(word: Column, pairs: PairRanks, slots: Column, moved: Column, single: Column, let) -> Column:
    none = F.lit(1 << pairs.bits).cast("bigint")  # no id
    id_of = lambda piece: piece.bitwiseAND((1 << pairs.bits) - 1)
    place = ((1 << 40) - 1) ^ ((1 << pairs.bits) - 1)  # the first byte, above the id

    def together(left: Column, right: Column) -> Column:
        """The id that two ids make. A slot of another pair differs above the id, so ``none`` is less."""
        pair = F.shiftleft(left, pairs.bits).bitwiseOR(right)
        bucket = F.shiftright(pair * pairs.by_bucket, 13).bitwiseAND(pairs.buckets - 1)
        slot = F.shiftright(pair * pairs.by_slot, 17).bitwiseAND(pairs.size - 1) + moved[bucket]
        return F.least(slots[slot].bitwiseXOR(F.shiftleft(pair, pairs.bits)), none)

    def join(state: Column, at: Column, best: Column) -> Column:
        """Pieces ``at`` and ``at`` + 1 become one; what it makes with its neighbours is new."""
        new, rest = F.shiftright(best, 40), F.slice(state, at + 2, F.size(state))
        after = F.get(state, at + 1)
        makes = F.when(after.isNull(), none).otherwise(together(new, id_of(after)))
        merged = F.shiftleft(makes, 40).bitwiseOR(best.bitwiseAND(place)).bitwiseOR(new)

        def with_left(left: Column) -> Column:
            own = left.bitwiseAND((1 << 40) - 1)
            changed = F.shiftleft(together(id_of(left), new), 40).bitwiseOR(own)
            return F.concat(F.slice(state, 1, at - 2), F.array(changed, merged), rest)

        return F.when(at > 1, let(F.get(state, at - 2), with_left)).otherwise(F.concat(F.array(merged), rest))

    def step(state: Column, _: Column) -> Column:
        return let(F.array_min(state), lambda best: F.when(F.shiftright(best, 40) >= none, state).otherwise(
            let(F.array_position(state, best).cast("int"), lambda at: join(state, at, best))))

    def merge(ids: Column) -> Column:
        n = F.size(ids)
        following = F.concat(F.slice(ids, 2, n), F.array(F.lit(-1).cast("bigint")))
        makes = F.zip_with(ids, following, lambda a, b: F.when(b < 0, none).otherwise(together(a, b)))
        start = F.zip_with(makes, F.transform(ids, lambda a, i: F.shiftleft(i.cast("bigint"), 20).bitwiseOR(a)),
                           lambda m, piece: F.shiftleft(m, 40).bitwiseOR(piece))
        done = F.aggregate(F.sequence(F.lit(2), n), start, step)
        return F.when(n < 2, ids).otherwise(F.transform(done, id_of))

    text = F.decode(F.encode(F.coalesce(word, F.lit("")), "UTF-8"), "ISO-8859-1")
    bytes_of = F.split(text, "")
    ids = let(F.transform(bytes_of, lambda c: single[F.ascii(c)]), merge).cast("array<int>")
    if pairs.apart:
        whole = F.create_map(*[F.lit(x) for w, r in pairs.apart.items() for x in (w.decode("latin-1"), r)])
        ids = F.when(F.map_contains_key(whole, text), F.array(F.try_element_at(whole, text))).otherwise(ids)
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(ids)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a word of any length, lowest rank first and leftmost among equals."""
    ends = list(range(1, len(word) + 1))  # of the piece that begins here
    before = list(range(-1, len(word) - 1))
    heap = [(ranks[word[i : i + 2]], i, i + 1, i + 2) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    live = [True] * len(word) + [False]
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if not (live[a] and ends[a] == b and b < len(word) and live[b] and ends[b] == c):
            continue
        ends[a], live[b] = c, False
        if c < len(word):
            before[c] = a
            if (rank := ranks.get(word[a : ends[c]])) is not None:
                heapq.heappush(heap, (rank, a, c, ends[c]))
        if (left := before[a]) >= 0 and (rank := ranks.get(word[left:c])) is not None:
            heapq.heappush(heap, (rank, left, a, c))
    return [ranks[word[i : ends[i]]] for i in range(len(word)) if live[i]]


def word_counts(docs: DataFrame, classes) -> DataFrame:
    """(word, n): how often each word occurs, but for those beyond ``FOLD_CHARS``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, table = hash_bases(), classes.value
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # hashes, counts, words

        def flush() -> pa.RecordBatch:
            hashes, counts = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            words = pa.concat_arrays([x[2] for x in held])
            held.clear()
            _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
            total = np.bincount(back, counts).astype(np.int64)
            return pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(total)], ["word", "n"])

        for batch in batches:
            for part in slices(batch, "text", _COUNT_BYTES):
                cut = Pretokens([t or "" for t in part.column("text").to_pylist()], table, spaced=True)
                known, at, n = np.unique(cut.hash(bases[0]), return_index=True, return_counts=True)
                short = cut.ends[at] - cut.starts[at] <= FOLD_CHARS
                held.append((known[short], n[short], cut.strings(at[short])))
                if sum(len(x[0]) for x in held) >= _HELD:
                    yield flush()
                    give_back()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(tidy(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Memo:
    """Ids of distinct words, found by two hashes."""

    def __init__(self, one: np.ndarray, two: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        order = np.argsort(one)
        begin = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
        self.one, self.two, self.lengths = one[order], two[order], lengths[order].astype(np.int32)
        # One number more, so that there is something to point at in an empty memo.
        self.ids = np.append(gather(ids, begin, self.lengths), np.int32(0))
        self.begin = np.concatenate(([0], np.cumsum(self.lengths, dtype=np.int64)))[:-1].astype(np.int32)
        # Where the words of each beginning of the hash are; a few at most share one.
        self.shift = np.uint64(64 - max(1, int(len(one)).bit_length()))
        edges = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        self.first = np.searchsorted(self.one >> self.shift, edges).astype(np.int32)
        self.most = int(np.diff(self.first).max())

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for unknown ones."""
        at = self.first[(one >> self.shift).astype(np.int64)].astype(np.int64)
        found = np.full(len(one), -1)
        left = np.arange(len(one))
        for _ in range(self.most if len(self.one) else 0):
            spot = np.minimum(at[left], len(self.one) - 1)
            hit = (self.one[spot] == one[left]) & (self.two[spot] == two[left])
            found[left[hit]] = spot[hit]
            at[left] += 1
            left = left[~hit & (self.one[spot] < one[left])]
        return found


def build_memo(docs: DataFrame, ranks: PairRanks, classes, most: int = MEMO_WORDS) -> Memo:
    """The ids of the commonest words that occur twice or more, at most about ``most``."""
    words = materialise(word_counts(docs, classes).filter("n > 1"), "words")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, table = hash_bases(), classes.value
        for batch in batches:
            cut = Pretokens(batch.column("word").to_pylist(), table, spaced=True)
            # A word is one pre-token as a whole: spans are those of the texts.
            cut.starts, cut.ends = cut.begin[:-1], cut.begin[1:] - 1
            one, two = (pa.array(x.astype(np.int64)) for x in cut.hashes(*bases))
            yield pa.RecordBatch.from_arrays([one, two, batch.column("ids")], ["one", "two", "ids"])

    chosen = (commonest(words, "word", most) if most else words.filter("false")).select("word", merged_ids(F.col("word"), ranks).alias("ids"))
    found = chosen.mapInArrow(tidy(hashed), "one bigint, two bigint, ids array<int>").toArrow().combine_chunks()
    one, two = (np.asarray(found.column(c), np.int64).astype(np.uint64) for c in ("one", "two"))
    ids = found.column("ids")
    flat = np.concatenate([np.asarray(c.flatten(), np.int32) for c in ids.chunks] or [np.zeros(0, np.int32)])
    return Memo(one, two, np.asarray(pc.list_value_length(ids), np.int64), flat)


class Pieces:
    """The bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        pieces = [b""] * len(self.size)
        for word, rank in ranks.items():
            pieces[rank], self.size[rank] = word, len(word)
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.begin = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.begin[ids], self.size[ids]).tobytes()


def encode(
    docs: DataFrame, ranks: dict[bytes, int], text: str = "text", memo_words: int = MEMO_WORDS, decoded: bool = False,
) -> DataFrame:
    """``docs`` with n_tokens and ids: little-endian unsigned 32-bit numbers in one binary.

    ``decoded`` adds what ``decode`` makes of the ids, in the same pass, and leaves out the text.

    Ids are those of the rank file, without special tokens. NULL and empty texts have no ids.
    Columns of ``docs`` named like the two new ones are replaced. A text is read as a whole: one very long
    text takes some 40 times its bytes in its task. The session's Arrow batches become smaller, see
    ``words.small_batches``.
    """
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    classes, pairs = context.broadcast(character_classes()), PairRanks(ranks)
    memo = context.broadcast(build_memo(docs.select(F.col(text).alias("text")), pairs, classes, memo_words))
    held = context.broadcast(ranks)
    give_back()  # the driver's own copies
    replaced = ("n_tokens", "ids", "decoded") if decoded else ("n_tokens", "ids")
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in replaced])
    left = [f for f in kept.schema.fields if not (decoded and f.name == text)]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, table, known, ranks = hash_bases(), classes.value, memo.value, held.value
        for batch in batches:
            for part in slices(batch, text, _LOOK_UP_BYTES):
                cut = Pretokens([t or "" for t in part.column(text).to_pylist()], table, spaced=True)
                number = known.find(*cut.hashes(*bases))
                rare = np.flatnonzero(number < 0)
                lengths = np.ones(len(cut), np.int64)
                begin = np.zeros(len(cut), np.int64)
                there = number >= 0
                lengths[there], begin[there] = known.lengths[number[there]], known.begin[number[there]]
                # Unknown words stand as -1, -2, ... into their document's list.
                lists: list[list[str]] = [[] for _ in range(part.num_rows)]
                stand_in = []
                of = np.searchsorted(cut.first, rare, "right") - 1
                seen: dict[str, int] = {}
                last, longs = -1, {}
                for i, t in zip(rare.tolist(), of.tolist()):
                    if t != last:
                        last, seen = t, {}
                    word = cut.word(i)
                    if word not in seen:
                        seen[word] = len(lists[t])
                        if len(word) > FOLD_CHARS:
                            longs[(t, seen[word])] = merge_long(word.encode(), ranks)
                            word = ""
                        lists[t].append(word)
                    stand_in.append(-1 - seen[cut.word(i)])
                flat = gather(known.ids, begin, lengths)
                ends = np.concatenate(([0], np.cumsum(lengths)))
                flat[ends[rare]] = np.array(stand_in, np.int32)
                ends = ends[cut.first]
                ids = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                merged: list[list[dict]] = [[] for _ in lists]
                for (t, j), found in longs.items():
                    merged[t].append({"at": j, "ids": np.array(found, np.int32).tobytes()})
                columns = {name: part.column(name) for name in part.schema.names}
                columns["__ids"] = pa.array(ids, pa.binary())
                columns["__rare"] = pa.array(lists, pa.list_(pa.string()))
                columns["__long"] = pa.array(merged, pa.list_(pa.struct([("at", pa.int32()), ("ids", pa.binary())])))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = T.StructType([
        *kept.schema.fields, T.StructField("__ids", T.BinaryType()), T.StructField("__rare", T.ArrayType(T.StringType())),
        T.StructField("__long", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("ids", T.BinaryType())]))),
    ])
    found = kept.mapInArrow(tidy(look_up), kind).withColumn("__merged", F.transform("__rare", lambda w: merged_ids(w, pairs)))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value) if decoded else None
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            out, counts, bytes_of = [], [], []
            merged = batch.column("__merged")
            inner = merged.flatten()
            values = np.asarray(inner.flatten(), np.int32)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(inner), 0), np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            lists = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(merged), np.int64))))
            longs = batch.column("__long").to_pylist()
            for t, raw in enumerate(batch.column("__ids").to_pylist()):
                ids = np.frombuffer(raw, np.int32)
                if lists[t] < lists[t + 1]:
                    pool, begin = values, starts[lists[t] : lists[t + 1]].copy()
                    size = sizes[lists[t] : lists[t + 1]].copy()
                    for x in longs[t]:
                        own = np.frombuffer(x["ids"], np.int32)
                        begin[x["at"]], size[x["at"]] = len(pool), len(own)
                        pool = np.concatenate((pool, own))
                    stands = np.flatnonzero(ids < 0)
                    which = -1 - ids[stands]
                    lengths = np.ones(len(ids), np.int64)
                    lengths[stands] = size[which]
                    at = np.arange(len(ids)) + len(pool)
                    at[stands] = begin[which]
                    ids = gather(np.concatenate((pool, ids)), at, lengths)
                out.append(ids.astype("<u4").tobytes())
                counts.append(len(ids))
                if pieces:
                    bytes_of.append(pieces.join(ids))
            columns = {f.name: batch.column(f.name) for f in left}
            columns["n_tokens"] = pa.array(counts, pa.int64())
            columns["ids"] = pa.array(out, pa.binary())
            if pieces:
                columns["decoded"] = pa.array(bytes_of, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    made += [T.StructField("decoded", T.BinaryType())] * decoded
    return found.select(*[f"`{f.name}`" for f in left], "__ids", "__rare", "__long", "__merged").mapInArrow(
        tidy(assemble), T.StructType([*left, *made]))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the bytes of the pieces of ``ids``, one after the other.

    NULL and empty ids give no bytes.
    """
    held = df.sparkSession.sparkContext.broadcast(ranks)
    kept = df.select(*[f"`{c}`" for c in df.columns if c != "decoded"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value)
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            out = [pieces.join(np.frombuffer(raw or b"", "<u4")) for raw in batch.column(ids).to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["decoded"] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return kept.mapInArrow(tidy(put_together), T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """``docs`` with every text encoded and decoded again; all columns as they were.

    NULL stays NULL.
    """
    own = [c for c in docs.columns if c in ("n_tokens", "ids", "decoded")]
    carried = docs.withColumnsRenamed({c: f"__own_{c}" for c in own})
    back = decode(encode(carried, ranks, text), ranks)
    whole = F.when(F.col(text).isNotNull(), F.decode("decoded", "UTF-8"))
    back = back.withColumn(text, whole).drop("n_tokens", "ids", "decoded")
    return back.withColumnsRenamed({f"__own_{c}": c for c in own}).select(*[f"`{c}`" for c in docs.columns])
