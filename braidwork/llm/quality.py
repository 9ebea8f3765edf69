"""Document quality by a linear-chain conditional random field over lines.

Every line of a text gets features of its own and of the lines before and
after it: length, shares of capitals, digits, symbols and letters beyond ASCII,
words repeated at once, distinct words, mean word length.  A two-state chain
(good, bad) is fitted by gradient ascent on its likelihood; forward-backward
gives every line's chance of being good, and their mean, weighted by the lines'
lengths, is put on the labels' scale by a logistic curve.

The chain is fitted on the driver on a bounded sample of rows: ``sample_rows``
labelled documents, the first by a hash of their key, with their whole texts; for
the fit a text of more than CHAIN_LINES lines is several chains.  Every document is scored over its whole text
in Arrow batches; the model is a few hundred numbers.

Defined results: null and empty texts are one empty line.  Rows do not depend
on each other, so repeated rows and null keys do no harm.  Labels that are null
are no labels.  A score without a key still has its row; what a caller derives
from the key is then null.  Without labels of both kinds the score is the share of label 1
(0.5 without any).  Only the key and the text are read from a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.shared import bounded_batches, released

BLOCK_BYTES = 2 << 20
CHAIN_LINES = 100
#: Bytes whose sums are made at once, so that a giant line needs no long array of whole numbers.
SUMMED_AT_ONCE = 1 << 20
UPPER, LOWER, DIGIT, SYMBOL, BEYOND, SPACE = range(6)

_KIND = np.full(256, SYMBOL, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = UPPER, LOWER, DIGIT, BEYOND
_KIND[[0, *range(9, 14), 32]] = SPACE
N_OWN = 10


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of flags between starts."""
    out = np.zeros(len(starts), np.int64)
    for at in range(0, len(flags), SUMMED_AT_ONCE):
        end = min(at + SUMMED_AT_ONCE, len(flags))
        first = max(int(np.searchsorted(starts, at, "right")) - 1, 0)
        mine = starts[first : np.searchsorted(starts, end)]
        out[first : first + len(mine)] += np.add.reduceat(flags[at:end], np.maximum(mine - at, 0), dtype=np.int64)
    return out


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes) of every line, and the number of lines of every text."""
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    of_text = np.searchsorted(np.cumsum(sizes + 1), ends, "right")
    lines = np.bincount(of_text[: len(ends)], minlength=len(texts))
    kind = _KIND[raw]
    counts = np.stack([_sums(kind == k, starts) for k in range(5)], axis=1).astype(float)
    length = ends - starts
    filled = kind != SPACE
    begin = filled & ~np.concatenate([[False], filled[:-1]])
    n_words = _sums(begin, starts)
    words = data.replace(b"\0", b" ").split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    line_of = np.repeat(np.arange(len(starts)), n_words)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])])
    repeats = np.bincount(line_of, again, len(starts))
    keyed = hashes ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a word and its line
    order = np.argsort(keyed)
    first = np.concatenate([[True], np.diff(keyed[order]) != 0]) if len(keyed) else np.zeros(0)
    distinct = np.bincount(line_of[order], first, len(starts))
    letters = np.maximum(counts[:, UPPER] + counts[:, LOWER] + counts[:, BEYOND], 1)
    chars = np.maximum(counts.sum(axis=1), 1)
    per_word = np.maximum(n_words, 1)
    own = np.stack(
        [np.log1p(n_words), np.log1p(length), counts[:, UPPER] / letters, counts[:, DIGIT] / chars, counts[:, SYMBOL] / chars, counts[:, BEYOND] / chars, repeats / per_word, distinct / per_word, chars / per_word / 10, n_words == 0], axis=1
    )
    return own, length, lines


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and of the line after, and whether it is the first or the last."""
    last = np.cumsum(lines) - 1
    first = last - lines + 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = own[first], own[last]
    edge = np.zeros((len(own), 2))
    edge[first, 0] = edge[last, 1] = 1
    return np.hstack([own, before, after, edge])


@dataclass
class Chain:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    #: Scores of passing from state to state, [from, to], states bad and good.
    moves: np.ndarray
    #: Logistic curve from the mean chance (as log-odds) to the score.
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def unary(self, features: np.ndarray) -> np.ndarray:
        """Log-odds of good for every line by itself."""
        return ((features - self.mean) / self.scale) @ self.weights + self.bias

    def means(self, chance: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean chance of every text, as log-odds."""
        at = np.cumsum(lines) - lines
        weight = length + 1.0
        p = np.clip(np.add.reduceat(chance * weight, at) / np.add.reduceat(weight, at), 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        own, length, lines = line_features(texts)
        chance, _ = marginals(self.unary(with_neighbours(own, lines)), self.moves, lines)
        return 1 / (1 + np.exp(-(self.slope * self.means(chance, length, lines) + self.offset)))


def marginals(unary: np.ndarray, moves: np.ndarray, lines: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(chance of good of every line, expected number of moves [from, to], weighted by text) by forward-backward, all texts at once."""
    order = np.argsort(-lines, kind="stable")
    starts = (np.cumsum(lines) - lines)[order]
    sizes = lines[order]
    weights = np.ones(len(lines)) if weight is None else weight[order]
    odds = np.clip(unary, -30, 30)
    emit = np.stack([np.exp(-np.maximum(odds, 0)), np.exp(np.minimum(odds, 0))], axis=1)  # bad, good; the larger is 1
    step = np.exp(moves - moves.max())
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes.max(initial=0)))]
    forward = np.empty_like(emit)
    now = emit[starts]
    for t, k in enumerate(active):
        now = now[:k] @ step * emit[starts[:k] + t] if t else now[:k]
        now = now / now.sum(axis=1, keepdims=True)
        forward[starts[:k] + t] = now
    chance = np.empty(len(emit))
    expected = np.zeros((2, 2))
    back = np.ones((len(sizes), 2))
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        joint = forward[at] * back[:k]
        chance[at] = joint[:, 1] / joint.sum(axis=1)
        if t:
            arriving = emit[at] * back[:k]
            pair = forward[at - 1][:, :, None] * step * arriving[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True) * weights[:k, None, None]).sum(axis=0)
            back[:k] = arriving @ step.T
            back[:k] /= back[:k].sum(axis=1, keepdims=True)
    return chance, expected


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Fit a chain to texts labelled 1 (good) or 0; a line's state is its text's label."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        zero = np.zeros(1)
        return Chain(zero, zero, zero, 0.0, np.zeros((2, 2)), constant=share)
    own, length, lines = line_features(texts)
    features = with_neighbours(own, lines)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    scaled = (features - mean) / scale
    truth = np.repeat(labels, lines).astype(float)
    by_text = 0.5 / np.where(labels == 1, share, 1 - share)  # both labels count alike, lines and moves too
    weight = np.repeat(by_text, lines)
    chains = np.array([min(CHAIN_LINES, n - at) for n in lines.tolist() for at in range(0, n, CHAIN_LINES)], np.int64)
    of = np.repeat(np.arange(len(lines)), -(-lines // CHAIN_LINES))
    seen = np.zeros((2, 2))
    for label in (0, 1):
        mine = labels[of] == label
        seen[label, label] = ((chains[mine] - 1) * by_text[of[mine]]).sum()
    n = len(truth)
    params = np.zeros(scaled.shape[1] + 5)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, steps + 1):
        chance, expected = marginals(scaled @ params[:-5] + params[-5], params[-4:].reshape(2, 2), chains, by_text[of])
        missing = (truth - chance) * weight
        slope = np.concatenate([scaled.T @ missing / n, [missing.mean()], ((seen - expected) / n).ravel()]) - decay * params
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        params += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    chain = Chain(mean, scale, params[:-5].copy(), float(params[-5]), params[-4:].reshape(2, 2).copy())
    chance, _ = marginals(chain.unary(features), chain.moves, lines)
    x = chain.means(chance, length, lines)
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps of a damped logistic regression
        p = 1 / (1 + np.exp(-(a * x + b)))
        curve = p * (1 - p) + 1e-6
        gradient = np.array([((labels - p) * x).sum() - 0.1 * (a - 1), (labels - p).sum() - 0.1 * b])
        hessian = np.array([[(curve * x * x).sum() + 0.1, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 0.1]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    chain.slope, chain.offset = a, b
    return chain


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """A batch's texts, in order, about `most` bytes at a time."""
    held: list[bytes] = []
    size = 0
    for x in column.cast(pa.large_binary()):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of the first rows by the hash of their key; docs: key, text; labels: key, label."""
    chosen = labels.where("label in (0, 1)").orderBy(F.xxhash64("key"), "key", "label").limit(rows)
    found = docs.join(F.broadcast(chosen), "key").select("key", "text", "label").collect()  # `rows` labels at most
    found.sort(key=lambda r: (str(r.key), r.text, r.label))
    return [r.text.encode() for r in found], np.array([r.label for r in found], float)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 3000) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier); labels: key and label, whose rows may be learnt from."""
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chain = fit(*sample(narrow, labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")), sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chain.scores(b) for b in blocks(batch.column(0).field(text))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else [], pa.float64())], names=["row", "score"])

    rows = bounded_batches(docs.select(F.struct(*docs.columns).alias("row")))
    return rows.mapInArrow(released(run), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def learnable(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose crc32(key as text) mod 3 is not 1."""
    return rows.where(F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1)
