"""Token ids in binary files: one zstandard frame per document under a shared dictionary.

The dictionary is trained on the serialised ids of a bounded sample and lies beside the files. A
file holds its dictionary's hash, the frames, and an index of ids and offsets at its end, so
that one short document is read without its neighbours. Documents are in ascending order of their
ids over all files.
"""

from __future__ import annotations

import hashlib
import struct
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contextmill.llm.pretokens import Pretokens, character_classes, gather, hash_bases
from contextmill.llm.shared_files import dealt, make_folder, of_files, read_file, write_file
from contextmill.llm.words import slices, tidy
from contextmill.session import materialise, work_folder

MAGIC = b"CMTOKEN1"
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 12 << 20
#: Documents that the dictionary is trained on, about; bytes of each, and of the dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 1 << 15, 64 << 10
#: Distinct words whose ids a worker remembers.
KNOWN_WORDS = 1 << 20
_NULL_ID = -(1 << 63)


#: What a tokenizer file says that normalises and splits as ``Pretokens`` does (fixed values).
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_REPLACED = {"pattern": {"Regex": r"\s+"}, "content": " "}
_SPLIT = {"pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"add_prefix_space": False, "use_regex": False}


def splits_into_words(model: str) -> bool:
    """Whether a tokenizer's settings are those that ids of words can be put together for."""
    settings = json.loads(model)
    before, cut = (settings.get(part) or {} for part in ("normalizer", "pre_tokenizer"))
    steps, cuts = before.get("normalizers") or [], cut.get("pretokenizers") or []

    def agree(step: dict, wanted: dict) -> bool:
        return all(step.get(k) == v for k, v in wanted.items())

    return (
        [x.get("type") for x in steps] == _NORMALISERS and agree(steps[1], _REPLACED)
        and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and agree(cuts[0], _SPLIT) and agree(cuts[1], _BYTES)
        and settings["model"].get("end_of_word_suffix") == "</w>" and not settings["model"].get("dropout")
    )


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, asked once for each distinct word.

    For tokenizers that normalise with NFC, white space and lower case and then split into words,
    contractions, single numbers and other characters: there a text's ids are those of its
    words. Of a tokenizer with other settings every text goes to the library whole. Texts with code points that Python's own tables don't know, whose classes may differ
    between versions of Unicode, go to the library whole. With ``added`` an added token's string in a
    text is that token, as by the library's default, and texts that hold one go to the library whole,
    too; without, it is ordinary text. Broadcast, it is one object per worker process, which
    remembers words from task to task, up to a fixed number.
    """

    def __init__(self, model: str, classes: np.ndarray, added: bool = False):
        self.model, self.classes, self.added = model, classes, added
        self.library = None

    def __getstate__(self):
        return {"model": self.model, "classes": self.classes, "added": self.added, "library": None}

    def _start(self) -> None:
        self.library = Tokenizer.from_str(self.model)
        self.by_words = splits_into_words(self.model)
        if not self.by_words:
            return
        tokens = self.library.get_added_tokens_decoder().values() if self.added else []
        self.strings = [t.content for t in tokens]
        self.normalised = [t.content.lower() for t in tokens if t.normalized]
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ends a word
        for token, number in vocabulary.items():
            self.last[number] = token.endswith("</w>")
        self.bases = hash_bases()
        self.unknown = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.check, self.begin, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words that are one pre-token each."""
        self.library.encode_special_tokens = True  # no word of a text without such strings is one
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, np.int32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not split into the words expected")
        return ids, np.diff(ends, prepend=0)

    def _whole(self, text: str) -> np.ndarray:
        self.library.encode_special_tokens = not self.added
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _odd(self, text: str) -> bool:
        """Whether a text must go to the library whole."""
        if any(s in text for s in self.strings) or self.normalised and any(s in text.lower() for s in self.normalised):
            return True
        return bool(self.unknown[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.library is None:
            self._start()
        if not self.by_words:
            return [self._whole(t) for t in texts]
        if self._odd("\n".join(texts)) and (whole := {i for i, t in enumerate(texts) if self._odd(t)}):
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in whole]))
            return [self._whole(t) if i in whole else next(rest) for i, t in enumerate(texts)]
        # Lower case goes character by character in the library, also for a final sigma.
        plain = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        cut = Pretokens(plain, self.classes, spaced=False)
        if not len(cut):
            return [np.zeros(0, np.int32) for _ in texts]
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        one, two = cut.hashes(*self.bases)
        distinct, at, back = np.unique(one, return_index=True, return_inverse=True)
        number = np.fromiter((self.known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            ids, n = self._ask([cut.word(i) for i in at[new].tolist()])
            number[new] = len(self.check) + np.arange(len(new))
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(n) - n))
            self.length = np.concatenate((self.length, n))
            self.ids = np.concatenate((self.ids, ids))
            self.check = np.concatenate((self.check, two[at[new]]))
            self.known.update(zip(distinct[new].tolist(), number[new].tolist()))
        number = number[back]
        if (self.check[number] != two).any():  # two words share a hash
            return [self._whole(t) for t in texts]
        lengths = self.length[number]
        flat = gather(self.ids, self.begin[number], lengths)
        ends = np.concatenate(([0], np.cumsum(lengths)))[cut.first]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the samples; of too few, their bytes as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _compression(dictionary: bytes):
    """Keyword for a compressor or decompressor; an empty dictionary is none."""
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if len(dictionary) >= 8 else {}


def pack_file(dictionary: bytes, width: int, keys: list[int], frames: list[bytes], counts: list[int]) -> list[bytes]:
    """The pieces of a file: header, frames, index (ids, offsets, token counts), footer."""
    header = MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<I", width)
    offsets = np.cumsum([len(header), *map(len, frames)], dtype="<u8")
    index = np.array(keys, "<i8").tobytes() + offsets.tobytes() + np.array(counts, "<i8").tobytes()
    return [header, *frames, index, struct.pack("<QQ", int(offsets[-1]), len(keys)) + MAGIC]


class TokenFile:
    """A file's index, and access to its documents."""

    def __init__(self, content: bytes, dictionary: bytes):
        self.content = memoryview(content)
        if content[:8] != MAGIC or content[-8:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        if content[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        (self.width,) = struct.unpack("<I", content[40:44])
        at, n = struct.unpack("<QQ", content[-24:-8])
        self.keys = np.frombuffer(content, "<i8", n, at)
        self.offsets = np.frombuffer(content, "<u8", n + 1, at + 8 * n)
        self.counts = np.frombuffer(content, "<i8", n, at + 16 * n + 8)
        self.unpack = zstandard.ZstdDecompressor(**_compression(dictionary))

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document; reads its frame alone."""
        frame = self.content[int(self.offsets[i]) : int(self.offsets[i + 1])]
        raw = self.unpack.decompress(frame, max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def find(self, key: int) -> np.ndarray | None:
        i = int(np.searchsorted(self.keys, key))
        return self.ids(i) if i < len(self.keys) and self.keys[i] == key else None


def _sample(docs: DataFrame, held, end_id: int, width: int) -> list[bytes]:
    """First SAMPLE_BYTES of the ids of about SAMPLE_DOCS rows, chosen by a hash of id and row number."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())  # an id may be on very many rows
    some = numbered.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "row"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [np.append(x, end_id).astype(f"<u{width}").tobytes()[:SAMPLE_BYTES]
                        for x in held.value.encode([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

    return sorted(bytes(r.ids) for r in some.select("text").mapInArrow(tidy(serialise), "ids binary").collect())


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write token files into ``folder``; the manifest: file, partition, part, docs, tokens.

    Each document's ids are the library's of its whole text with ``add_special_tokens=False``, then
    ``end_id``: none are put in, but an added token's string in a text is that token. NULL and empty texts have the end id alone. Documents are in ascending order of ``key`` (64-bit),
    NULL first; repeated keys are ordered by a hash of the text. The range shuffle splits on a
    row number last, so equal rows may be many. An empty table writes the dictionary alone.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    folder = make_folder(spark, folder)
    with open(tokenizer_path, encoding="utf-8") as model:
        library = WordTokenizer(model.read(), character_classes(), added=True)
    held = context.broadcast(library)
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    dictionary = train_dictionary(_sample(source, held, end_id, width))
    write_file(folder, "dictionary", "zdict", [MAGIC, dictionary])
    shared = context.broadcast(dictionary)
    order = ["doc_id", "hash", "row"]
    ranged = source.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, part_no = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3, **_compression(shared.value))
        keys, frames, counts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = write_file(folder, f"part-{partition:06d}-{part_no:04d}", "tokens", pack_file(shared.value, width, keys, frames, counts))
            return pa.RecordBatch.from_pylist(
                [{"file": name, "partition": partition, "part": part_no, "docs": len(keys), "tokens": sum(counts)}],
                schema=pa.schema([("file", pa.string()), ("partition", pa.int32()), ("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for part in slices(batch, "text"):
                encoded = held.value.encode([t or "" for t in part.column("text").to_pylist()])
                for k, ids in zip(part.column("doc_id").to_pylist(), encoded):
                    ids = np.append(ids, end_id)
                    frame = pack.compress(ids.astype(f"<u{width}").tobytes())
                    keys.append(_NULL_ID if k is None else k)
                    frames.append(frame)
                    counts.append(len(ids))
                    size += len(frame)
                if size > FILE_BYTES:
                    yield flush()
                    keys, frames, counts, size, part_no = [], [], [], 0, part_no + 1
        if keys:
            yield flush()

    return materialise(ranged.mapInArrow(tidy(write), "file string, partition int, part int, docs bigint, tokens bigint"), "manifest")


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files that the manifest names.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian unsigned 32-bit
    numbers. A file with another dictionary's hash is an error.
    """
    spark = manifest.sparkSession
    folder = make_folder(spark, folder)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zdict").load(folder).first()
    dictionary = spark.sparkContext.broadcast(bytes(found["content"])[len(MAGIC):])
    totals = dict(manifest.groupBy("partition").agg(F.sum("tokens")).collect())  # a row per partition
    before, total = [], 0
    for p in range(max(totals, default=-1) + 1):
        before.append(total)
        total += totals.get(p, 0)
    inside = Window.partitionBy("partition").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.from_json(F.lit(str(before)), "array<bigint>")
    based = manifest.select("file", (
        F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.element_at(first, F.col("partition") + 1)).alias("base"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                file = TokenFile(read_file(folder, name), dictionary.value)
                starts = base + np.cumsum(file.counts) - file.counts
                for at in range(0, len(file.keys), 500):
                    rows = range(at, min(at + 500, len(file.keys)))
                    keys = [None if file.keys[i] == _NULL_ID else int(file.keys[i]) for i in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, pa.int64()), pa.array(starts[rows.start : rows.stop], pa.int64()),
                            pa.array(file.counts[rows.start : rows.stop], pa.int64()),
                            pa.array([file.ids(i).tobytes() for i in rows], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"])

    return of_files(dealt(materialise(based, "files")).mapInArrow(tidy(unpack), "doc_id bigint, start bigint, n_tokens bigint, ids binary"))


def new_folder(docs: DataFrame) -> str:
    """A fresh folder for token files in the shared work folder."""
    return work_folder(docs.sparkSession, "tokens")
