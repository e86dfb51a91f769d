"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary, all of its lower-case pieces of letters. For each language, piece
probabilities are fitted by expectation maximisation over all segmentations of its words (forward-backward over the
lattice of pieces). A word's likelihood is the sum over all its segmentations, by the forward algorithm; a text's is
the product over its words. The prediction is the language with the greatest likelihood under equal priors, the first
by name of equals, the score its share after tempering by word count.

Words of up to SHORT letters are summed many at a time in plain floating point, which can hold their least likelihood;
longer ones, of whatever length, one at a time in logarithms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_of_id, table
from .words import Recent, held, split_words

#: A letter and what follows of letters and their marks.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The fit reads at most so many documents of each language, of those with at most so many signs, whole.
SAMPLE_DOCS = 400
SAMPLE_SIGNS = 100_000
ROUNDS = 4
FLOOR = 1e-7
SHORT = 40  # FLOOR ** (SHORT + 1) is still a normal floating point number
CACHE_WORDS = 200_000
CACHED_SIGNS = 64
UNKNOWN = "und"


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Ids of all lower-case pieces of letters, with the word-start mark where the vocabulary has it.

    Beginnings of pieces that are no pieces have -1, so that a search can stop where nothing goes on.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    kept = sorted({p for p in pieces if p == p.lower() and (p.lstrip("▁").isalpha() or p == "▁")})
    return {p[:n]: -1 for p in kept for n in range(1, len(p))} | {p: i for i, p in enumerate(kept)}


def pieces(vocab: dict[str, int]) -> int:
    return 1 + max(vocab.values(), default=-1)


def units(text: str | None) -> list[str]:
    """A text's words in lower case."""
    return WORDS.findall(text.lower()) if text else []


def edges(marked: str, i: int, vocab: dict[str, int]) -> list[tuple[int, int]]:
    """(end, piece) of the pieces that fit at place i; piece -1 is a letter without a piece of its own.

    Every letter can stand alone, so every word has a segmentation.
    """
    found, alone = [], True
    for j in range(i + 1, len(marked) + 1):
        p = vocab.get(marked[i:j])
        if p is None:
            break  # no piece goes on like this
        if p >= 0:
            found.append((j, p))
            alone = alone and j > i + 1
    if alone:
        found.append((i + 1, -1))
    return found


def long_likelihood(word: str, vocab: dict[str, int], logs: np.ndarray) -> np.ndarray:
    """The log-likelihood of a word of any length by language; only as many places are held as a piece can be long."""
    marked, width = "▁" + word, 1 + max(map(len, vocab), default=1)
    alpha = np.full((width, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for i in range(len(marked)):
        here = alpha[i % width].copy()
        alpha[i % width] = -np.inf
        for j, p in edges(marked, i, vocab):
            alpha[j % width] = np.logaddexp(alpha[j % width], here + logs[p])
    return alpha[len(marked) % width]


def long_uses(word: str, vocab: dict[str, int], logs: np.ndarray, weight: float, uses: np.ndarray) -> None:
    """Add the expected uses of each piece over all segmentations of a long word; logs are of one language."""
    marked = "▁" + word
    fits = [edges(marked, i, vocab) for i in range(len(marked))]
    alpha, beta = np.full(len(marked) + 1, -np.inf), np.full(len(marked) + 1, -np.inf)
    alpha[0] = beta[-1] = 0
    for i, found in enumerate(fits):
        for j, p in found:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + logs[p])
    for i in range(len(marked) - 1, -1, -1):
        for j, p in fits[i]:
            beta[i] = np.logaddexp(beta[i], beta[j] + logs[p])
            uses[p] += weight * np.exp(alpha[i] + logs[p] + beta[j] - alpha[-1])


@dataclass
class Lattice:
    """The pieces that fit at each place of each word: edges sorted by end; piece -1 is a letter without a piece."""

    lengths: np.ndarray
    word: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    bounds: np.ndarray  # of the edges with each end

    @classmethod
    def of(cls, words: list[str], vocab: dict[str, int]) -> Lattice:
        word, begin, end, piece = [], [], [], []
        for w, text in enumerate(words):
            marked = "▁" + text
            for i in range(len(marked)):
                for j, p in edges(marked, i, vocab):
                    word.append(w)
                    begin.append(i)
                    end.append(j)
                    piece.append(p)
        end = np.array(end, np.int32)
        order = np.argsort(end, kind="stable")
        top = max(map(len, words), default=0) + 1
        bounds = np.searchsorted(end[order], np.arange(top + 2))
        take = lambda x: np.array(x, np.int32)[order]
        return cls(np.array([len(x) + 1 for x in words], np.int32), take(word), take(begin), end[order], take(piece), bounds)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, place, language] of the piece probabilities p[piece, language]; p's last row is for piece -1."""
        alpha = np.zeros((len(self.lengths), len(self.bounds) - 1, p.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, len(self.bounds) - 1):
            e = slice(self.bounds[j], self.bounds[j + 1])
            if e.start < e.stop:
                more = alpha[self.word[e], self.begin[e]] * p[self.piece[e]]
                for k in range(p.shape[1]):
                    alpha[:, j, k] = np.bincount(self.word[e], more[:, k], len(alpha))
        return alpha

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[np.arange(len(self.lengths)), self.lengths]

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations, words weighted; p has one language."""
        alpha = self.forward(p)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(self.lengths)), self.lengths] = 1
        for j in range(len(self.bounds) - 2, 0, -1):
            e = slice(self.bounds[j], self.bounds[j + 1])
            np.add.at(beta, (self.word[e], self.begin[e]), beta[self.word[e], j] * p[self.piece[e], 0])
        total = np.maximum(alpha[np.arange(len(self.lengths)), self.lengths], 1e-300)
        uses = alpha[self.word, self.begin] * p[self.piece, 0] * beta[self.word, self.end] * (weight / total)[self.word]
        return np.bincount(np.where(self.piece < 0, len(p) - 1, self.piece), uses, len(p))


def fit_language(words: list[str], weight: np.ndarray, vocab: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its words and their counts; the last is of a letter without a piece."""
    size = pieces(vocab) + 1
    p = np.full((size, 1), 1 / size)
    short = [i for i, w in enumerate(words) if len(w) <= SHORT]
    short.sort(key=lambda i: len(words[i]))
    for at_round in range(rounds):
        uses = np.zeros(size)
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            uses += Lattice.of([words[i] for i in part], vocab).expected(p, weight[part])
        for i in (i for i, w in enumerate(words) if len(w) > SHORT):
            long_uses(words[i], vocab, np.log(p[:, 0]), weight[i], uses)
        p = np.maximum(((uses + 0.01) / (uses.sum() + 0.01 * size))[:, None], FLOOR)
    return p


@dataclass(eq=False)
class LanguageModel:
    languages: list[str]
    probabilities: np.ndarray  # [piece, language]
    path: str


def key(word: str) -> str | bytes:
    """What a cache holds a word by: the word, or its digest if it is long."""
    return word if len(word) <= CACHED_SIGNS else xxhash.xxh3_128_digest(word)


class Scorer:
    """Predicts texts; the log-likelihoods of words and of blank-parted strings seen before come from bounded caches."""

    def __init__(self, model: LanguageModel):
        self.model, self.vocab = model, vocabulary(model.path)
        self.logs = np.log(model.probabilities)
        self.words, self.units = Recent(CACHE_WORDS), Recent(CACHE_WORDS)

    def learn(self, new: list[str]) -> None:
        split = [units(w) for w in new]
        flat = list({key(u): u for us in split for u in us}.items())
        _, missing = self.units.find([k for k, _ in flat])
        missing = set(missing)
        flat = sorted(((k, u) for k, u in flat if k in missing), key=lambda x: len(x[1]))
        short = [x for x in flat if len(x[1]) <= SHORT]
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            logs = np.log(Lattice.of([u for _, u in part], self.vocab).likelihood(self.model.probabilities))
            self.units.young.update(zip([k for k, _ in part], map(np.ndarray.tobytes, np.column_stack([logs, np.ones(len(part))]).astype("<f4")), strict=True))
        for k, u in flat[len(short) :]:
            self.units.young[k] = np.append(long_likelihood(u, self.vocab, self.logs), 1).astype("<f4").tobytes()
        known, width = self.units.young, len(self.model.languages) + 1
        for w, us in zip(new, split, strict=True):
            if len(us) == 1:
                self.words.young[key(w)] = known[key(us[0])]
            else:
                rows = np.frombuffer(b"".join(known[key(u)] for u in us), "<f4").reshape(-1, width)
                self.words.young[key(w)] = rows.sum(axis=0, dtype="<f4").tobytes()

    def __call__(self, texts: pa.Array) -> list[tuple[str, float]]:
        bounds, ids, words = split_words(texts)
        keys = list(map(key, words))
        data, new = self.words.find(keys)
        if new:
            new = set(new)
            self.learn([w for k, w in zip(keys, words, strict=True) if k in new])
            data = self.words.fill(keys, data)
        rows = np.frombuffer(b"".join(data), "<f4").reshape(len(words), -1)  # the last column counts units
        out = []
        for i in range(len(texts)):
            sums = rows[ids[bounds[i] : bounds[i + 1]]].sum(axis=0, dtype=np.float64) if bounds[i] < bounds[i + 1] else np.zeros(1)
            logs, count = sums[:-1], sums[-1]
            if not count or not self.model.languages:
                out.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmax(logs))
            share = np.exp((logs - logs[best]) / np.sqrt(count))  # words of a text are not independent
            out.append((self.model.languages[best], float(share[best] / share.sum())))
        return out


def scorer_of(model: LanguageModel) -> Scorer:
    """The scorer of the model in this Python worker; its cache outlives a task."""
    return held(model, lambda: Scorer(model))


def fit(docs: DataFrame, vocab_path: str | None = None, sample_docs: int = SAMPLE_DOCS, sample_signs: int = SAMPLE_SIGNS) -> LanguageModel:
    """Learn from text and lang of the rows given; rows with a null of either teach nothing.

    The bounded sample: of each language at most sample_docs of the documents with at most sample_signs signs, those
    with the least hashes of id and text; all their words count. Repeated rows are one document or several, as their
    number allows. Without any usable row the model has no language and predicts `und`.
    """
    path = vocab_path or vocabulary_path()
    vocab = vocabulary(path)
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= sample_signs)).select("lang", "text", F.xxhash64(F.lit(7), "doc_id", "text").alias("h"))
    counts = {r["lang"]: (r["n"], r["least"]) for r in docs.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((pieces(vocab) + 1, 0)), path)
    chosen = F.lit(False)  # about sample_docs to twice as many, and surely one
    for lang, (n, least) in counts.items():
        chosen = F.when(F.col("lang") == lang, (F.pmod("h", F.lit(max(1, n // sample_docs))) == 0) | (F.col("h") == least)).otherwise(chosen)
    first = W.partitionBy("lang").orderBy("h")
    sample = docs.filter(chosen).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= sample_docs)

    def count(batches):
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            pairs = [(a, w) for a, t in zip(langs, texts, strict=True) for w in units(t)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([w for _, w in pairs], pa.string())], ["lang", "word"])

    words = sample.select("lang", "text").mapInArrow(count, "lang string, word string").groupBy("lang", "word").count().toArrow()  # of the sample only
    words = words.sort_by([("lang", "ascending"), ("word", "ascending")])
    languages, columns = sorted(counts), []
    for lang in languages:
        own = words.filter(pc.equal(words["lang"], lang))
        columns.append(fit_language(own["word"].to_pylist(), own["count"].to_numpy().astype(float), vocab))
    return LanguageModel(languages, np.concatenate(columns, axis=1), path)


def predict(docs: DataFrame, model: LanguageModel, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score (0 to 1); `und`, 0 where the text is null or has no letter.

    Any other columns pass through, columns of these two names are replaced; alike texts get alike results. The model
    is one matrix of vocabulary by languages and goes along with the task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double>")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(sent.value)
        for texts in batches:
            found = []
            for at in range(0, len(texts), 512):
                found += scorer(pa.array(texts.iloc[at : at + 512], pa.large_string(), from_pandas=True))
            yield pd.DataFrame(found, columns=["lang", "score"])

    found = guess("text")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (name, score)], found["lang"].alias(name), found["score"].alias(score))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4)) != 2)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id's crc32 leaves another remainder by 4 than 2.

    A null id counts as the empty text there. Repeated rows each get a row, an empty table gives none; lang is read to
    learn from only.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    rows = docs.select("doc_id", (F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4)) == 2).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
