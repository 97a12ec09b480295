"""Where models plug in, the prompts they get, and offline stand-ins.

A model is a function from a Column to a Column: a Pandas UDF over a service, or a
plain column expression. Only the prompt or text column goes to Python; all other
columns of the row stay in the JVM.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.functions.text import BEYOND_LATIN, word_tokens

Model = Callable[[Column], Column]


def in_window(items: Iterable, connect: Callable[[], Callable], window: int = 1, attempts: int = 1, wait: float = 0.5,
              sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """(item, result) in the order of ``items``, with at most ``window`` calls at a time.

    ``connect`` runs once per thread of the window and gives the function that is called. A call that fails is
    made again, ``attempts`` times in all, after ``wait`` seconds that double each time; a last failure gives
    None. Items are only taken as far as the window reaches, so any number may follow.
    """
    own = threading.local()

    def call(item):
        pause = wait
        for left in range(attempts - 1, -1, -1):
            try:
                if not hasattr(own, "client"):
                    own.client = connect()
                return own.client(item)
            except Exception:
                if left:
                    sleep(pause)
                    pause *= 2
        return None

    if window <= 1:
        for item in items:
            yield item, call(item)
        return
    with ThreadPoolExecutor(window) as threads:
        running: deque = deque()
        try:
            for item in items:
                running.append((item, threads.submit(call, item)))
                if len(running) == window:
                    first, result = running.popleft()
                    yield first, result.result()
            while running:
                first, result = running.popleft()
                yield first, result.result()
        finally:
            for _, result in running:
                result.cancel()


def chat_model(connect: Callable[[], Callable[[str], str]], window: int = 1, attempts: int = 1, wait: float = 0.5) -> Model:
    """A prompt-to-reply model. A failed call gives NULL.

    ``connect`` runs once per task and thread and returns the function that answers a prompt. Each task has
    up to ``window`` calls under way and repeats failed ones, see ``in_window``; replies keep their rows.
    """

    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            made = in_window(prompts, connect, window, attempts, wait)
            yield pd.Series([reply for _, reply in made], dtype=object)

    def one_client(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = connect()
        for prompts in batches:
            made = in_window(prompts, lambda: client, 1, attempts, wait)
            yield pd.Series([reply for _, reply in made], dtype=object)

    return F.pandas_udf(replies if window > 1 else one_client, T.StringType()).asNondeterministic()


def embedding_model(connect: Callable[[], Callable[[list[str]], list]], batch: int | None = None, window: int = 1,
                    attempts: int = 1, wait: float = 0.5) -> Model:
    """A text-to-vector model, called once per ``batch`` of texts (or per Arrow batch), ``window`` calls at a time.

    Texts without a vector would leave a hole in a collection, so the job fails with the last attempt.
    """

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            every = texts.tolist()
            size = batch or max(1, len(every))
            parts = [every[i : i + size] for i in range(0, len(every), size)]
            out: list = []
            for part, made in in_window(parts, connect, window, attempts, wait):
                if made is None or len(made) != len(part):
                    raise RuntimeError(f"no vectors for {len(part)} texts")
                out.extend(made)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(vectors, T.ArrayType(T.FloatType())).asNondeterministic()


def with_reply(rows: DataFrame, ask, prompt: Column, name: str) -> DataFrame:
    """``rows`` with the reply to ``prompt``, by a model (a column function) or a reply store."""
    from contextmill.operators.replies import ReplyStore

    return ask.ask(rows, prompt, name) if isinstance(ask, ReplyStore) else rows.withColumn(name, ask(prompt))


#: Words that are hashed at a time, whose blocks stay in a core's cache.
_HASHED = 1 << 14
_MD5_SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint32)
_MD5_TURNS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32), 4, axis=0).ravel()


def md5_numbers(words: pa.Array) -> np.ndarray:
    """The number of the first eight hexadecimal digits of each word's MD5; of binary values.

    Values of one block of MD5, up to 55 bytes, are hashed many at once, longer ones one by one.
    """
    out = np.zeros(len(words), np.uint32)
    sizes = np.asarray(pc.binary_length(words), np.int64)
    long = np.flatnonzero(sizes > 55)
    for i, word in zip(long, words.take(pa.array(long)).to_pylist()):
        out[i] = int.from_bytes(md5(word).digest()[:4], "big")
    short = np.flatnonzero(sizes <= 55)
    for first in range(0, len(short), _HASHED):
        some = short[first : first + _HASHED]
        out[some] = _md5_of_blocks(pa.concat_arrays([words.take(pa.array(some))]), sizes[some])
    return out


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of some binary values begins and the last one ends, from 0, and their bytes."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    held = values.buffers()[2]
    raw = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    return ends - ends[0], raw[ends[0] : ends[-1]]


def _md5_of_blocks(words: pa.Array, sizes: np.ndarray) -> np.ndarray:
    block = np.zeros((len(words), 64), np.uint8)
    ends, joined = _bytes_of(words)
    begins = np.arange(len(words)) * 64
    block.ravel()[np.repeat(begins - ends[:-1], sizes) + np.arange(len(joined))] = joined
    block.ravel()[begins + sizes] = 0x80
    block[:, 56:58] = (8 * sizes).astype("<u2").view(np.uint8).reshape(-1, 2)
    message = np.ascontiguousarray(block.view("<u4").T.astype(np.uint32))
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(words), x) for x in start)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            mixed, at = d ^ (b & (c ^ d)), i
        elif kind == 1:
            mixed, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif kind == 2:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += message[at]
        mixed += _MD5_SINES[i]
        turned = mixed << _MD5_TURNS[i]
        turned |= mixed >> np.uint32(32 - _MD5_TURNS[i])
        turned += b
        a, b, c, d = d, turned, b, c
    return (a + start[0]).byteswap()


def _latin_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are letters or digits by themselves, the lower case of each, and which are after a byte C2 or C3."""
    alone, lower, after = np.zeros(256, bool), np.arange(256, dtype=np.uint8), np.zeros((256, 256), bool)
    for first, last in ("az", "AZ", "09"):
        alone[ord(first) : ord(last) + 1] = True
    lower[ord("A") : ord("Z") + 1] += 32
    after[0xC2, [0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]] = True
    after[0xC3, 0x80:0xC0] = True
    after[0xC3, [0x97, 0xB7]] = False
    return alone, lower, after


_ALONE, _LOWER, _AFTER = _latin_tables()


def latin_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``word_tokens`` as bytes, and how many each text has; of texts without characters beyond U+00FF.

    Which of these are letters and digits, and their lower case, does not depend on a version of Unicode. All texts
    of a batch are cut at once.
    """
    if not len(texts):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    ends, raw = _bytes_of(texts.cast(pa.binary()))
    low, word = _LOWER[raw], _ALONE[raw]
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xC3))
    second = raw[lead + 1]
    word[lead] = word[lead + 1] = _AFTER[raw[lead], second]
    upper = (raw[lead] == 0xC3) & (second <= 0x9E) & (second != 0x97)
    low[lead[upper] + 1] += 32
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < len(raw)]
    begins[first] = word[first]
    starts = np.flatnonzero(begins)
    kept = low[word]
    # Bytes of words before each word; a word's bytes stand together.
    before = np.cumsum(word, dtype=np.int32)[starts] - 1
    offsets = np.append(before, len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return words, np.diff(np.searchsorted(starts, ends))


def hashed_embedder(dim: int) -> Model:
    """Offline embedder: how often each hash bucket of the text's words occurs.

    A word's bucket is the number of the first eight digits of its MD5, modulo ``dim``. It is worked out
    once per distinct word of a batch. Texts are cut into words where that is done; those with
    characters beyond U+00FF come as their words instead.
    """

    def histograms(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, words in batches:
            n = len(texts)
            cut, counts = latin_words(texts)
            row = np.repeat(np.arange(n), counts)
            if len(given := words.flatten()):
                row = np.concatenate((row, np.repeat(np.arange(n), np.asarray(words.value_lengths()))))
                cut = pa.concat_arrays([cut, given.cast(pa.binary())])
            coded = cut.dictionary_encode()
            buckets = (md5_numbers(coded.dictionary) % dim).astype(np.int64)
            cells = row * dim + buckets[np.asarray(coded.indices)]
            counts = np.bincount(cells, minlength=n * dim).astype(np.float32)
            offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
            yield pa.ListArray.from_arrays(offsets, pa.array(counts))

    made = F.arrow_udf(histograms, T.ArrayType(T.FloatType()))

    def embed(text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        beyond = text.rlike(BEYOND_LATIN)
        # Empty, not NULL: a list column takes time with the square of the NULLs in a batch.
        none = F.array().cast("array<string>")
        return made(F.when(beyond, "").otherwise(text), F.when(beyond, word_tokens(text)).otherwise(none))

    return embed


def base_prompt(chunk: Column, question: Column) -> Column:
    return F.concat(
        F.lit("How relevant is this passage to the question?\n\nPassage: "), chunk,
        F.lit("\n\nQuestion: "), question,
        F.lit("\n\nReply with one number from 0 (irrelevant) to 1 (fully relevant) and nothing else."),
    )


def reflect_prompt(chunk: Column, question: Column, base: Column) -> Column:
    return F.concat(
        F.lit("You rated this passage "), base.cast("string"),
        F.lit(" for relevance to the question. Reconsider and correct the rating if needed.\n\nPassage: "),
        chunk, F.lit("\n\nQuestion: "), question,
        F.lit("\n\nReply with the final number from 0 to 1 and nothing else."),
    )


def critic_prompt(chunk: Column, question: Column, reflect: Column) -> Column:
    return F.concat(
        F.lit("A reviewer rated this passage "), reflect.cast("string"),
        F.lit(". Judge strictly whether it really helps to answer the question.\n\nPassage: "),
        chunk, F.lit("\n\nQuestion: "), question,
        F.lit("\n\nReply with your own number from 0 to 1 and nothing else."),
    )


# Fixed value: the answer instruction that carries the contexts alone.
CONTEXTS_ONLY = "Responde usando solo este contexto:\n"


def answer_prompt(contexts: Column, question: Column | None) -> Column:
    """Prompt over an array of context texts; without a question, the list of contexts alone.

    The list is written as JSON, which keeps the contexts apart.
    """
    if question is None:
        return F.concat(F.lit(CONTEXTS_ONLY), F.to_json(contexts))
    packed = F.array_join(contexts, "\n\n")
    return F.concat(F.lit("Answer from this context only.\n\nContext:\n"), packed,
                    F.lit("\n\nQuestion: "), question)
