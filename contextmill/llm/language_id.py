"""The language of texts by a bidirectional gated recurrent network over their bytes.

The network reads runs of bytes forwards and backwards and gives every position probabilities of all languages; a
document's are the means over its letters. It is trained here, by backpropagation through time, on a
bounded sample of rows with a known language. Tasks then read every byte of every text, many
runs at a time. Gates and states are squashed by ``x / (1 + |x|)``, several times
cheaper than an exponential and of the same shape.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.llm.words import slices, tidy
from contextmill.session import materialise

#: Rows that the network is fitted on, about and at most, in equal numbers of each language, and runs of bytes of one row.
FIT_ROWS, ROW_RUNS = 3000, 3
#: Bytes of a run: what is left and right of it is not seen by its positions.
RUN = 96
HIDDEN = 8
STEPS, BATCH, RATE = 200, 192, 0.02
#: Runs read side by side.
_BLOCK = 2048
UNDETERMINED = "und"
_LETTER_BYTES = np.array([chr(b).isalpha() and b < 128 or b > 127 for b in range(256)])


def squash(x: np.ndarray) -> np.ndarray:
    """``x`` in place between -1 and 1."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def squash_slope(y: np.ndarray) -> np.ndarray:
    """The slope of ``squash`` where it gives ``y``."""
    return np.square(1 - np.abs(y))


@dataclass
class Direction:
    """One reading direction: what a byte adds to reset, update and new state, and what the last state adds."""

    given: np.ndarray  # (3 * hidden, 256)
    state: np.ndarray  # (3 * hidden, hidden)
    bias: np.ndarray  # (hidden, 1), of the new state, before the reset
    out: np.ndarray  # (languages, hidden)

    @staticmethod
    def start(rng: np.random.Generator, hidden: int, languages: int) -> Direction:
        def near_zero(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)

        return Direction(near_zero(3 * hidden, 256), near_zero(3 * hidden, hidden), np.zeros((hidden, 1), np.float32), near_zero(languages, hidden))

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.given, self.state, self.bias, self.out]

    def read(self, codes: np.ndarray, live: np.ndarray, trace: list | None = None) -> np.ndarray:
        """What each position adds to the languages' scores: (steps, languages, runs).

        ``codes`` are bytes by step and run, ``live`` how many runs reach a step; longer ones come first.
        """
        k = self.state.shape[1]
        h = np.zeros((k, codes.shape[1]), self.state.dtype)
        scores = np.zeros((len(codes), len(self.out), codes.shape[1]), self.state.dtype)
        for t, n in enumerate(live.tolist()):
            last = h[:, :n]
            x = np.take(self.given, codes[t, :n], axis=1)
            back = self.state @ last
            gates = x[: 2 * k]
            gates += back[: 2 * k]
            squash(gates)
            gates *= 0.5
            gates += 0.5
            reset, keep = gates[:k], gates[k:]
            inner = back[2 * k :]
            inner += self.bias
            new = x[2 * k :]
            new += reset * inner
            squash(new)
            step = last - new
            step *= keep
            step += new
            if trace is not None:
                trace.append((last.copy(), reset, keep, new, inner))
            h[:, :n] = step
            scores[t, :, :n] = self.out @ step
        return scores

    def gradient(self, codes: np.ndarray, live: np.ndarray, trace: list, slope: np.ndarray) -> list[np.ndarray]:
        """Slopes of the weights, back through time, from those of the scores."""
        k = self.state.shape[1]
        d_state, d_bias, d_out = np.zeros_like(self.state), np.zeros_like(self.bias), np.zeros_like(self.out)
        d_given = np.zeros((len(codes), 3 * k, codes.shape[1]), self.state.dtype)
        dh = np.zeros((k, codes.shape[1]), self.state.dtype)
        for t in range(len(codes) - 1, -1, -1):
            n = int(live[t])
            last, reset, keep, new, inner = trace[t]
            h = new + keep * (last - new)
            d_out += slope[t, :, :n] @ h.T
            d = dh[:, :n] + self.out.T @ slope[t, :, :n]
            d_new = d * (1 - keep) * squash_slope(new)
            d_inner = d_new * reset
            d_gates = np.concatenate((d_new * inner, d * (last - new)))
            d_gates *= 0.5 * squash_slope(2 * np.concatenate((reset, keep)) - 1)
            d_back = np.concatenate((d_gates, d_inner))
            d_given[t, : 2 * k, :n], d_given[t, 2 * k :, :n] = d_gates, d_new
            d_state += d_back @ last.T
            d_bias += d_inner.sum(axis=1, keepdims=True)
            dh[:, :n] = d * keep + self.state.T @ d_back
        one_hot = np.zeros((codes.size, 256), self.state.dtype)
        one_hot[np.arange(codes.size), codes.ravel()] = 1  # steps that a run does not reach have no slope
        return [d_given.transpose(1, 0, 2).reshape(3 * k, -1) @ one_hot, d_state, d_bias, d_out]


@dataclass
class Network:
    """Both directions and the languages' own weights."""

    languages: list[str]
    forward: Direction | None = None
    backward: Direction | None = None
    bias: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.forward.weights, *self.backward.weights, self.bias]

    def probabilities(self, runs: Runs, traces: tuple[list, list] | None = None) -> np.ndarray:
        """(steps, languages, runs) for every position of the runs."""
        one, two = traces or (None, None)
        scores = self.forward.read(runs.codes, runs.live, one)
        scores += np.take_along_axis(self.backward.read(runs.mirrored, runs.live, two), runs.mirror[:, None, :], axis=0)
        scores += self.bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores


class Runs:
    """Runs of bytes side by side, longest first: ``order`` tells which run a column is."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        begin, lengths = begin[self.order], lengths[self.order]
        steps = np.arange(lengths[0])[:, None]
        inside = steps < lengths
        self.mirror = np.where(inside, lengths - 1 - steps, 0)
        data = np.append(data, np.uint8(0))
        self.codes = np.where(inside, data[np.where(inside, begin + steps, 0)], 0).astype(np.intp)
        self.mirrored = np.take_along_axis(self.codes, self.mirror, axis=0)
        self.live = inside.sum(axis=1)
        self.letters = inside & _LETTER_BYTES[self.codes]


def cut_runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, length) of the runs of texts of these lengths that stand one behind the other."""
    counts = -(-lengths // RUN)
    of = np.repeat(np.arange(len(lengths)), counts)
    within = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * RUN
    return of, (np.cumsum(lengths) - lengths)[of] + within, np.minimum(RUN, lengths[of] - within)


def slopes(network: Network, runs: Runs, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean loss over all letters and its slopes, in the order of ``Network.weights``."""
    traces: tuple[list, list] = ([], [])
    slope = network.probabilities(runs, traces)
    column = np.arange(len(truth))
    letters = max(1, int(runs.letters.sum()))
    loss = -(np.log(np.maximum(slope[:, truth, column], 1e-30)) * runs.letters).sum() / letters
    slope[:, truth, column] -= 1
    slope *= (runs.letters[:, None, :] / letters).astype(slope.dtype)
    back = np.take_along_axis(slope, runs.mirror[:, None, :], axis=0)
    return float(loss), [
        *network.forward.gradient(runs.codes, runs.live, traces[0], slope),
        *network.backward.gradient(runs.mirrored, runs.live, traces[1], back),
        slope.sum(axis=(0, 2))[:, None],
    ]


def train(texts: list[bytes], languages: list[int], names: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 11) -> Network:
    """A network fitted on runs of at most ``RUN`` bytes with known languages."""
    rng = np.random.default_rng(seed)
    network = Network(names, Direction.start(rng, hidden, len(names)), Direction.start(rng, hidden, len(names)), np.zeros((len(names), 1), np.float32))
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths) - lengths
    known = np.array(languages)
    mean = [np.zeros_like(w) for w in network.weights()]
    square = [np.zeros_like(w) for w in network.weights()]
    for step in range(1, steps + 1):
        some = rng.integers(0, len(texts), BATCH)
        runs = Runs(data, begin[some], lengths[some])
        _, found = slopes(network, runs, known[some][runs.order])
        size = np.sqrt(sum(float(np.square(s).sum()) for s in found))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps)) + 1e-4
        for w, s, m, v in zip(network.weights(), found, mean, square):
            s = s * min(1.0, 1 / (size + 1e-12))
            m += 0.1 * (s - m)
            v += 0.01 * (s * s - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return network


def held_out(key: Column) -> Column:
    """Documents that are never learned from: a fifth by the checksum of their id, and those without one."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Network:
    """The network of a bounded sample: about ``rows`` rows at most, as many of each language as of any other.

    Only rows with a language and a text that are not held out count. Rows are chosen by a hash of
    id and row number, so the bound holds where an id or a text repeats; of each, up to ``ROW_RUNS`` runs
    from its beginning, middle and end go to the driver. Without such rows no language is known.
    """
    usable = docs.filter(~held_out(F.col(key)) & F.col(lang).isNotNull() & (F.length(text) > 0))
    usable = usable.select(F.col(key).alias("__id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = sorted((r.lang, r["count"]) for r in usable.groupBy("lang").count().collect())
    names = [name for name, _ in counts]
    if not names:
        return Network([])
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in counts for x in (name, min(1.0, 0.95 * rows / len(names) / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit("fit"), "__id", F.monotonically_increasing_id()), F.lit(1 << 30)) / (1 << 30)
    some = usable.withColumn("draw", draw).filter(F.col("draw") < share).select("text", "lang")

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, langs = [], []
            for whole, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                data = whole.encode()
                last = -(-len(data) // RUN) - 1
                for i in sorted({round(last * j / max(1, ROW_RUNS - 1)) for j in range(ROW_RUNS)}):
                    runs.append(data[i * RUN : (i + 1) * RUN])
                    langs.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.binary()), pa.array(langs, pa.string())], ["run", "lang"])

    sample = materialise(some.mapInArrow(few, "run binary, lang string"), "language-sample")
    # In an order of their own, so that the network does not depend on how tasks were dealt out.
    made = sorted((bytes(r.run), r.lang) for r in sample.collect())
    return train([run for run, _ in made], [names.index(name) for _, name in made], names)


def identify(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the mean probability of that language over the text's letters.

    Every byte of every text is read; a very long text is read in blocks of runs, beside some ten times its own bytes.
    NULL and empty texts, texts without a letter, and all where no language is known are ``und`` with score
    0. Equal scores go to the language that is first in order. Columns of ``docs`` with these two names
    are replaced.
    """
    new = ("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(network)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in new])
    names_kept = kept.columns
    marked = kept.withColumn("__letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                blobs = [(t or "").encode() for t in part.column(text).to_pylist()]
                total = pooled(own, blobs)
                size = total.sum(axis=1)
                known = np.asarray(part.column("__letters")).astype(bool) & (size > 0)
                best = total.argmax(axis=1) if own.languages else np.zeros(len(blobs), int)
                score = np.zeros(len(blobs))
                score[known] = total[known, best[known]] / size[known]
                names = [own.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
                columns = {name: part.column(name) for name in names_kept}
                columns["lang_pred"] = pa.array(names, pa.string())
                columns["score"] = pa.array(np.round(np.clip(score, 0, 1), 6))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return marked.mapInArrow(tidy(read), T.StructType([
        *kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def pooled(network: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): sums of the probabilities of all letters."""
    total = np.zeros((len(texts), len(network.languages)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    of, begin, lengths = cut_runs(np.fromiter(map(len, texts), np.int64, len(texts)))
    for at in range(0, len(of) if network.languages else 0, _BLOCK):
        runs = Runs(data, begin[at : at + _BLOCK], lengths[at : at + _BLOCK])
        found = np.einsum("tcn,tn->cn", network.probabilities(runs), runs.letters.astype(np.float32))
        text = of[at : at + _BLOCK][runs.order]
        for c, row in enumerate(found):
            total[:, c] += np.bincount(text, row, len(texts))
    return total
