"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Words are runs of letters and digits, as they are written, and runs of other signs. Every word has a sparse ternary
index vector drawn from its hash; its word vector is the sum of its own and of those met around it in the training
texts, each shifted by how far before or after it stands (so that order counts), brought to length one. Every word of
the sample has a vector; one that training never met has none and counts as zero. A document's features are the mean
of its words' vectors and the mean of the products of neighbouring vectors, place by place, which tells how words
stand together. Nothing else goes into the score. The network's logits are divided by a temperature fitted on
training rows that the weights never saw.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_of_id, table
from .words import held, split_words

DIMENSIONS = 64
NONZERO = 4  # one in each of as many equal blocks of dimensions
WINDOW = 2
FEATURES = 2 * DIMENSIONS
#: The fit reads at most so many labelled rows of each class, of those whose text has at most so many signs, whole.
SAMPLE_ROWS = 2_000
SAMPLE_SIGNS = 20_000
HIDDEN = 32
EPOCHS = 150
THRESHOLD = 0.3
CACHE_WORDS = 200_000
#: Vectors of so many words of a text are held at once.
BLOCK = 1 << 16
WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def words_of(texts: pa.Array, cache: dict[str, tuple[int, ...]], number: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, ids): text i has the words ids[bounds[i]:bounds[i + 1]], numbered by number(word); a null text has none.

    cache: the words of blank-parted strings seen before.
    """
    bounds, raw, strings = split_words(texts)
    found = []
    for s in strings:
        own = cache.get(s)
        if own is None:
            own = cache[s] = tuple(map(number, WORD.findall(s)))
        found.append(own)
    size = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((k for own in found for k in own), np.int64, int(size.sum()))
    begin, each = np.concatenate([[0], np.cumsum(size)[:-1]])[raw] if len(raw) else raw, size[raw]
    after = np.cumsum(each)
    ids = flat[np.repeat(begin - (after - each), each) + np.arange(int(each.sum()))]
    return np.concatenate([[0], after])[bounds], ids


def index_vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each word's index vector, one in each block, from the word's hash."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[:, None]
    width = DIMENSIONS // NONZERO
    shifts = (8 * np.arange(NONZERO)).astype(np.uint64)
    draws = (hashes >> shifts) & np.uint64(255)
    places = (draws >> np.uint64(1)) % np.uint64(width) + np.arange(NONZERO, dtype=np.uint64) * np.uint64(width)
    return places.astype(np.int64), (draws & np.uint64(1)).astype(np.float64) * 2 - 1


@dataclass
class WordVectors:
    words: dict[str, int]
    vectors: np.ndarray  # the last row, of zeros, is for words that training never met

    @classmethod
    def learn(cls, texts: list[str]) -> WordVectors:
        """Random indexing over the texts, for every word in them."""
        words: dict[str, int] = {}
        bounds, ids = words_of(pa.array(texts, pa.large_string()), {}, lambda w: words.setdefault(w, len(words)))
        places, signs = index_vectors(list(words))
        vectors = np.zeros(len(words) * DIMENSIONS)
        text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        for gap in range(-WINDOW, WINDOW + 1):
            a, b = (ids, ids) if not gap else (ids[: -abs(gap)], ids[abs(gap) :])
            same = text_of[: len(a)] == text_of[len(ids) - len(a) :]  # no window reaches from one text to the next
            x, y = (a[same], b[same]) if gap >= 0 else (b[same], a[same])
            for k in range(NONZERO):
                vectors += np.bincount(x * DIMENSIONS + (places[y, k] + gap) % DIMENSIONS, signs[y, k], len(vectors))
        vectors = vectors.reshape(-1, DIMENSIONS)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
        return cls(words, np.concatenate([vectors, np.zeros((1, DIMENSIONS))]).astype(np.float32))


class Pooler:
    """Features of whole texts; the words of strings met before come from a bounded cache."""

    def __init__(self, model: WordVectors):
        self.model, self.cache = model, {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES), np.float32)
        known, none = self.model.words, len(self.model.words)
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        bounds, ids = words_of(texts, self.cache, lambda w: known.get(w, none))
        for i in range(len(texts)):
            own = ids[bounds[i] : bounds[i + 1]]
            single, pairs = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
            for at in range(0, len(own), BLOCK):
                rows = self.model.vectors[own[at : at + BLOCK + 1]]  # one more, for the pair across blocks
                single += rows[:BLOCK].sum(axis=0, dtype=np.float64)
                pairs += np.einsum("ij,ij->j", rows[1:], rows[:-1])
            out[i, :DIMENSIONS] = single / max(1, len(own))
            out[i, DIMENSIONS:] = pairs / max(1, len(own) - 1)
        return out


@dataclass(eq=False)
class QualityModel:
    vectors: WordVectors
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.maximum((x - self.shift) / self.scale @ w1 + b1, 0) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train_layers(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Adam on the weighted log loss with a small penalty on the weights; all rows at each step."""
    draw = np.random.default_rng(seed)
    params = [draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (weight / weight.sum())[:, None]
    for step in range(1, epochs + 1):
        w1, b1, w2, b2 = params
        hidden = np.maximum(x @ w1 + b1, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -60, 60)))
        d2 = (p - y[:, None]) * weight
        d1 = (d2 @ w2.T) * (hidden > 0)
        grads = [x.T @ d1 + 1e-3 * w1, d1.sum(0), hidden.T @ d2 + 1e-3 * w2, d2.sum(0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(params)


def fit_temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature, of a grid from 1/4 to 8, with the least log loss."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.sum(weight * np.logaddexp(0, np.where(y > 0, -logits, logits) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_signs: int = SAMPLE_SIGNS) -> QualityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, quality; other values than 0 and 1, and nulls, teach nothing).

    The bounded sample: of each class at most sample_rows rows with at most sample_signs signs, those with the least
    hashes; they weigh so that the classes keep their shares. The bound makes the join with labels a broadcast. A label
    that is given twice counts once, one document may have both. A null text is empty. With rows of one class the model
    scores that class, without any nearly 0.5.
    """
    labels = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    share = {k: max(1, n // (2 * sample_rows)) for k, n in counts.items()}
    h = F.xxhash64(F.lit(9), "doc_id")
    chosen = labels.filter(F.pmod(h, F.when(F.col("quality") == 1, F.lit(share.get(1, 1))).otherwise(F.lit(share.get(0, 1)))) == 0)
    first = lambda *by: F.row_number().over(W.partitionBy("quality").orderBy(*by))
    chosen = chosen.withColumn("place", first(h, "doc_id")).filter(F.col("place") <= 4 * sample_rows).drop("place")  # some have no document, some a long one
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= sample_signs).join(F.broadcast(chosen), "doc_id")
    rows = rows.withColumn("place", first(h, "doc_id", F.xxhash64("text"), "text")).filter(F.col("place") <= sample_rows)
    part = F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(5)) == 0
    rows = sorted(rows.select("doc_id", "text", "quality", part.alias("apart")).collect(), key=lambda r: (r["doc_id"], r["text"], r["quality"]))
    return fit_rows([r["text"] for r in rows], np.array([r["quality"] for r in rows], float), np.array([counts[r["quality"]] for r in rows], float), np.array([r["apart"] for r in rows], bool))


def fit_rows(texts: list[str], y: np.ndarray, of_class: np.ndarray, apart: np.ndarray) -> QualityModel:
    weight = np.array([n / max(1, np.sum(y == v)) for n, v in zip(of_class, y, strict=True)])
    vectors = WordVectors.learn([t for t, a in zip(texts, apart, strict=True) if not a] or texts)
    x = Pooler(vectors)(pa.array(texts, pa.large_string())).astype(float)
    if len(set(y.tolist())) < 2:
        rate = 0.0 if not len(y) else 20.0 if y[0] else -20.0
        return QualityModel(vectors, np.zeros(FEATURES), np.ones(FEATURES), (np.zeros((FEATURES, 1)), np.zeros(1), np.zeros((1, 1)), np.array([rate])), 1.0)
    use = ~apart if len(set(y[~apart].tolist())) == 2 else np.ones(len(y), bool)
    shift, scale = x[use].mean(0), x[use].std(0) + 1e-6
    layers = train_layers((x[use] - shift) / scale, y[use], weight[use])
    model = QualityModel(vectors, shift, scale, layers, 1.0)
    model.temperature = fit_temperature(model.logits(x[apart]), y[apart], weight[apart])
    return model


def pooler_of(model: QualityModel) -> Pooler:
    """The pooler of the model in this Python worker; its cache outlives a task."""
    return held(model, lambda: Pooler(model.vectors))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 is likelier) of each whole text; a null text is scored as an empty one.

    Other columns pass through, a column score is replaced; alike texts have alike scores, an empty table none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        pool = pooler_of(model)
        for texts in batches:
            parts = [pool(pa.array(texts.iloc[at : at + 512], pa.large_string(), from_pandas=True)) for at in range(0, len(texts), 512)]
            yield pd.Series(model.scores(np.concatenate(parts or [np.zeros((0, FEATURES))]).astype(float)))

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"], rate("text").alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of those whose id's crc32 is no multiple of 5.

    A null id counts as the empty text there and has no label. Repeated rows each get a row.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(5)) == 0
    model = fit(docs, labels.filter(~held_out))
    rows = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
