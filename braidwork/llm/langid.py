"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 (A-Z lower-cased) in windows of ``CORE`` bytes
with ``CONTEXT`` bytes on either side, forwards and backwards, and gives every
byte a distribution over the languages.  A document's distribution is the mean
over all its bytes.

It is written and trained in numpy: back-propagation through time, Adam, a
fixed seed.  It learns from a bounded sample of rows: of each language
``per_language`` documents, the first by a hash of their key, with their whole
texts, cut into pieces of ``PIECE`` characters.  A step draws documents alike and
then pieces of them.  Every document is labelled over its whole text in Arrow
batches; windows are computed in blocks, so a long text costs no more memory
than a short one.

Defined results: null texts and texts without a letter are ``und`` with score
0.  Without any labelled text all are ``und``.  Rows do not depend on each
other, so repeated rows and null keys do no harm.  Only the key and the text
are read for a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.llm.quality import BLOCK_BYTES
from braidwork.shared import bounded_batches

CORE, CONTEXT = 224, 16
SPAN = CORE + 2 * CONTEXT
PAD = 256
HIDDEN = 12
WINDOWS_AT_ONCE = 1024
PIECE = 96
LETTER = re.compile(r"[^\W\d_]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Direction:
    """One gated recurrent layer, states and inputs as columns: gates update, reset, candidate."""

    inputs: np.ndarray  # (3 hidden, 257): what a byte adds to the gates
    gates: np.ndarray  # (2 hidden, hidden)
    candidate: np.ndarray  # (hidden, hidden)

    @staticmethod
    def fresh(rng: np.random.Generator, hidden: int) -> Direction:
        scale = hidden**-0.5
        layer = Direction(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (3 * hidden, PAD + 1)), (scale, (2 * hidden, hidden)), (scale, (hidden, hidden)))))
        layer.inputs[:hidden, PAD] = -40  # the update gate is shut: padding leaves the state as it is, and so learns nothing
        return layer

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(next state, update, reset, candidate)."""
        h = len(state)
        added = self.inputs.take(x, axis=1)
        both = self.gates @ state
        both += added[: 2 * h]
        sigmoid(both)
        update, reset = both[:h], both[h:]
        fresh = self.candidate @ (reset * state)
        fresh += added[2 * h :]
        np.tanh(fresh, out=fresh)
        after = fresh - state
        after *= update
        after += state
        return after, update, reset, fresh

    def states(self, x: np.ndarray, order: range) -> Iterator[tuple[int, np.ndarray]]:
        """(t, state after it) as step() gives them; what goes into the gates is halved beforehand, which is exact."""
        h = len(self.candidate)
        inputs, gates = self.inputs.copy(), self.gates * np.float32(0.5)
        inputs[: 2 * h] *= np.float32(0.5)
        state = np.zeros((h, x.shape[1]), np.float32)
        for t in order:
            added = inputs.take(x[t], axis=1)
            both = gates @ state
            both += added[: 2 * h]
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            fresh = self.candidate @ (both[h:] * state)
            fresh += added[2 * h :]
            np.tanh(fresh, out=fresh)
            fresh -= state
            fresh *= both[:h]
            fresh += state
            state = fresh
            yield t, state


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (languages, 2 hidden)
    bias: np.ndarray  # (languages, 1)

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        f, b = Direction.fresh(rng, hidden), Direction.fresh(rng, hidden)
        return Network(languages, f, b, rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32), np.zeros((len(languages), 1), np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.forward.inputs, self.forward.gates, self.forward.candidate, self.backward.inputs, self.backward.gates, self.backward.candidate, self.out, self.bias]

    def distributions(self, x: np.ndarray, core: slice = slice(None)) -> np.ndarray:
        """(steps, languages, windows) of the steps `core` of windows (steps, windows); either layer ends where no more of these come."""
        begin, end, _ = core.indices(len(x))
        h = self.out.shape[1] // 2
        logits = np.empty((end - begin, len(self.languages), x.shape[1]), np.float32)
        left, right = np.ascontiguousarray(self.out[:, :h]), np.ascontiguousarray(self.out[:, h:])
        for t, state in self.forward.states(x, range(end)):
            if t >= begin:
                logits[t - begin] = left @ state + self.bias
        for t, state in self.backward.states(x, range(len(x) - 1, begin - 1, -1)):
            if t < end:
                logits[t - begin] += right @ state
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all bytes that are not padding, and its gradient by params()."""
        steps, n = x.shape
        h = self.out.shape[1] // 2
        traces = []
        for layer, order in ((self.forward, range(steps)), (self.backward, range(steps - 1, -1, -1))):
            state = np.zeros((h, n), np.float32)
            trace = [None] * steps
            for t in order:
                after, update, reset, fresh = layer.step(x[t], state)
                trace[t] = (state, after, update, reset, fresh)
                state = after
            traces.append(trace)
        hidden = np.stack([np.concatenate([traces[0][t][1], traces[1][t][1]]) for t in range(steps)])
        logits = self.out @ hidden + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        real = (x != PAD).astype(np.float32)
        total = max(real.sum(), 1)
        picked = p[:, label, np.arange(n)]
        loss = float(-(np.log(picked + 1e-12) * real).sum() / total)
        error = p
        error[:, label, np.arange(n)] -= 1
        error *= (real / total)[:, None, :]
        d_out = np.einsum("tcn,thn->ch", error, hidden, optimize=True)
        d_bias = error.sum(axis=(0, 2))[:, None]
        d_hidden = self.out.T @ error
        found = []
        for k, (layer, trace, order) in enumerate(((self.forward, traces[0], range(steps - 1, -1, -1)), (self.backward, traces[1], range(steps)))):
            d_in = np.empty((steps, 3 * h, n), np.float32)
            d_gates, d_candidate = np.zeros_like(layer.gates), np.zeros_like(layer.candidate)
            carried = np.zeros((h, n), np.float32)
            for t in order:
                state, _, update, reset, fresh = trace[t]
                d = d_hidden[t, k * h : (k + 1) * h] + carried
                d_fresh = d * update * (1 - fresh * fresh)
                d_update = d * (fresh - state) * update * (1 - update)
                through = layer.candidate.T @ d_fresh
                d_reset = through * state * reset * (1 - reset)
                both = np.concatenate([d_update, d_reset])
                carried = d * (1 - update) + through * reset + layer.gates.T @ both
                d_candidate += d_fresh @ (reset * state).T
                d_gates += both @ state.T
                d_in[t, : 2 * h], d_in[t, 2 * h :] = both, d_fresh
            d_inputs = np.zeros((PAD + 1, 3 * h), np.float32)
            np.add.at(d_inputs, x.ravel(), d_in.transpose(0, 2, 1).reshape(-1, 3 * h))
            found += [d_inputs.T, d_gates, d_candidate]
        return loss, [*found, d_out.astype(np.float32), d_bias]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the texts with padding, start of every window's span); a text of n bytes has ceil(n / CORE) windows."""
    n = [-(-len(t) // CORE) for t in texts]
    size = [k * CORE + 2 * CONTEXT for k in n]
    symbols = np.full(sum(size), PAD, np.int16)
    starts, at = [], 0
    for t, k, s in zip(texts, n, size, strict=True):
        symbols[at + CONTEXT : at + CONTEXT + len(t)] = np.frombuffer(t.translate(_LOWER), np.uint8)
        starts.append(at + CORE * np.arange(k))
        at += s
    return symbols, np.concatenate(starts) if starts else np.zeros(0, np.int64)


def pooled(network: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): mean distribution over the bytes of every text; zeros for an empty one."""
    symbols, starts = windows(texts)
    sums = np.zeros((len(starts), len(network.languages)))
    for k in range(0, len(starts), WINDOWS_AT_ONCE):
        x = symbols[starts[k : k + WINDOWS_AT_ONCE] + np.arange(SPAN)[:, None]]
        core = slice(CONTEXT, CONTEXT + CORE)
        sums[k : k + WINDOWS_AT_ONCE] = (network.distributions(x, core) * (x[core] != PAD)[:, None, :]).sum(axis=0).T
    of_text = np.repeat(np.arange(len(texts)), [-(-len(t) // CORE) for t in texts])
    total = np.stack([np.bincount(of_text, sums[:, c], len(texts)) for c in range(len(network.languages))], axis=1)
    return total / np.maximum(np.fromiter(map(len, texts), float, len(texts)), 1)[:, None]


def train(pieces: list[tuple[bytes, str]], weights: list[float] | None = None, steps: int = 260, batch: int = 192, rate: float = 0.015, hidden: int = HIDDEN, seed: int = 0) -> Network | None:
    """Train on (piece, language), drawn by weight; None without any."""
    languages = sorted({lang for _, lang in pieces})
    if not languages:
        return None
    network = Network.fresh(languages, hidden, seed)
    if len(languages) == 1:
        return network
    length = max(len(p) for p, _ in pieces)
    x = np.full((length, len(pieces)), PAD, np.int16)
    for k, (p, _) in enumerate(pieces):
        x[: len(p), k] = np.frombuffer(p.translate(_LOWER), np.uint8)
    label = np.array([languages.index(lang) for _, lang in pieces])
    of = [np.flatnonzero(label == c) for c in range(len(languages))]
    weight = np.ones(len(pieces)) if weights is None else np.array(weights)
    chances = [weight[o] / weight[o].sum() for o in of]
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in network.params()]
    second = [np.zeros_like(p) for p in network.params()]
    for k in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(o, -(-batch // len(of)), p=p) for o, p in zip(of, chances, strict=True)])  # all languages alike
        _, gradient = network.gradients(x[:, chosen], label[chosen])
        size = np.sqrt(sum(float((g * g).sum()) for g in gradient))
        now = rate * 0.5 * (1 + np.cos(np.pi * k / (steps + 1)))
        for p, g, a, b in zip(network.params(), gradient, first, second, strict=True):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (now * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return network


def sample(docs: DataFrame, per_language: int) -> tuple[list[tuple[bytes, str]], list[float]]:
    """(piece, language) of the sampled documents and the pieces' weights; docs: key, text, lang."""
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    # The hash of a key, as a number from 0 to 1: half as many again as are needed are read, and the first are taken.
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    chosen = F.col("place") < 1.5 * per_language / F.col("n")
    rows = known.withColumn("place", place).join(F.broadcast(counts), "lang").where(chosen).select("lang", "place", "text").collect()
    taken: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.place, r.text)):
        if len(mine := taken.setdefault(r.lang, [])) < per_language:
            mine.append(r)
    pieces, weights = [], []
    for lang, some in sorted(taken.items()):
        for r in some:
            mine = [p.encode() for k in range(0, len(r.text), PIECE) if LETTER.search(p := r.text[k : k + PIECE])]
            pieces += [(p, lang) for p in mine]
            weights += [1 / max(len(mine), 1)] * len(mine)
    return pieces, weights


def identify(docs: DataFrame, teachers: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, **how) -> DataFrame:
    """(key, lang_pred, score) of docs; teachers: key, text and language of documents that may be learnt from."""
    network = train(*sample(teachers.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")), per_language), **how)

    def label(texts: list[str | None]) -> Iterator[tuple[str, float]]:
        data = [t.encode() if t else b"" for t in texts]
        mean = pooled(network, data) if network else None
        for k, t in enumerate(texts):
            if network is None or not t or not LETTER.search(t):
                yield "und", 0.0
            else:
                best = int(mean[k].argmax())
                yield network.languages[best], float(min(mean[k][best], 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, float]] = []
            held, size = [], 0
            for x in batch.column(1):
                held.append(x.as_py())
                size += len(held[-1] or "")
                if size > BLOCK_BYTES:
                    found += label(held)
                    held, size = [], 0
            found += label(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["key", "lang_pred", "score"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return bounded_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, schema).withColumnRenamed("key", key)
