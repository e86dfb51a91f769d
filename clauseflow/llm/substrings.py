"""Removal of long word sequences that an earlier document has, over a compacted De Bruijn graph of word k-mers.

The k-mers of a text are the graph's edges. Of the k-mers in each window of WINDOW words the one with the least hash is
its anchor, the same wherever the window stands; a run of windows with one anchor is a segment, a piece of a path about
the anchor's edge. Equal segments are one node, with the smallest document that holds it. Where all segments of an
anchor are equal the path does not branch there, and the node decides about all its windows at once. Where they differ,
the path branches: the windows of the different segments (one text each, found again by its coordinates) are compared
one by one. So anchors, a small part of all places, are shuffled for all texts, and windows only at branches.

Equality is of two independent 64-bit hashes. Joins on anchors, segments and windows read tables written before, so
that adaptive execution can split those of a hot passage; aggregations combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, saved, table
from .words import chunks, split_words

WINDOW = 50
KMER = 8
#: Odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of a known generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranges:
    """Hashes of any ranges of a sequence of 64-bit values, from prefix sums of value * base ** place (mod 2 ** 64)."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, lane: int):
        base = BASES[lane]
        forward, back = self.powers.get(lane, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
        if len(forward) <= len(values):
            size = 1 << int(len(values)).bit_length()
            steps = np.full(size, base, np.uint64)
            inverse = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            steps[0] = inverse[0] = 1
            forward, back = self.powers[lane] = np.cumprod(steps), np.cumprod(inverse)
        self.back = back
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * forward[: len(values)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the least, the first of equals."""
    places, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = places[: len(places) - step], places[step:]
        places = np.where(values[b] < values[a], b, a)
        size += step
    return places


def segments_of(hashes: np.ndarray, window: int = WINDOW, k: int = KMER) -> tuple[np.ndarray, ...]:
    """(anchor, segment, first window, windows) of each run of windows of a text with one anchor."""
    windows = len(hashes) - window + 1
    if windows < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = np.arange(len(hashes) - k + 1)
    kmers = Ranges(hashes, 0).of(at, at + k)
    anchor = least_places(kmers, window - k + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.concatenate([first, [windows]]))
    segment = mixed(Ranges(hashes, 1).of(first, first + count + window - 1) ^ (anchor[first] - first).astype(np.uint64))
    return kmers[anchor[first]].view(np.int64), segment.view(np.int64), first, count


def window_hashes(hashes: np.ndarray, begin: int, count: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(count)
    part = hashes[begin : begin + count + window - 1]
    return tuple(Ranges(part, lane).of(at, at + window).view(np.int64) for lane in (0, 1))


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The 64-bit hash of every word, text by text."""
    bounds, ids, words = split_words(texts, BLANKS)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    for i in range(len(texts)):
        yield hashes[ids[bounds[i] : bounds[i + 1]]]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def all_segments(docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]):
        for part in chunks(batches):
            out: list[list] = [[], [], [], [], []]
            for i, hashes in enumerate(word_hashes(part.column("text"))):
                found = segments_of(hashes)
                for col, v in zip(out, (*found, np.full(len(found[0]), i)), strict=True):
                    col.append(v)
            anchor, segment, first, count, row = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
            ids, hs = (part.column(c).take(pa.array(row)) for c in ("doc_id", "h"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(segment), ids, hs, pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16))],
                ["anchor", "segment", "doc_id", "h", "place", "windows"],
            )

    return docs.filter("doc_id is not null").mapInArrow(cut, "anchor long, segment long, doc_id long, h long, place int, windows short")


def branch_windows(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The windows of each node (anchor, segment, windows, holder: doc_id, h, place), from its holder's text."""
    wanted = nodes.groupBy(F.col("holder.doc_id").alias("doc_id"), F.col("holder.h").alias("h")).agg(
        F.collect_list(F.struct("anchor", "segment", F.col("holder.place").alias("place"), "windows")).alias("nodes")
    )
    texts = docs.join(wanted, ["doc_id", "h"])

    def cut(batches: Iterator[pa.RecordBatch]):
        names = ["w1", "w2", "first_doc", "anchor", "segment", "offset"]
        for part in chunks(batches, rows=256):
            out: list[list] = [[] for _ in names]
            for doc_id, nodes, hashes in zip(part.column("doc_id").to_pylist(), part.column("nodes").to_pylist(), word_hashes(part.column("text")), strict=True):
                for node in {(x["anchor"], x["segment"]): x for x in nodes}.values():  # repeated rows hold a node twice
                    n = node["windows"]
                    w1, w2 = window_hashes(hashes, node["place"], n)
                    same = (np.full(n, v, np.int64) for v in (doc_id, node["anchor"], node["segment"]))
                    for col, v in zip(out, (w1, w2, *same, np.arange(n, dtype=np.int64)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out], names)

    return texts.select("doc_id", "nodes", "text").mapInArrow(cut, "w1 long, w2 long, first_doc long, anchor long, segment long, offset long")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The ranges (doc_id, h, cuts: array<struct<begin, end>>) of words that lie in windows an earlier document has."""
    segments = saved(all_segments(docs), "segments")
    anchors = segments.groupBy("anchor").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("segment").alias("a"), F.max("segment").alias("b"))
    anchors = saved(anchors.filter("first_doc < last_doc").select("anchor", "first_doc", (F.col("a") == F.col("b")).alias("straight")), "anchors")
    shared = saved(segments.join(anchors, "anchor"), "shared")
    straight = shared.filter("straight and doc_id > first_doc").select("doc_id", "h", F.array(F.struct(F.col("place").alias("begin"), (F.col("place") + F.col("windows") + window - 1).alias("end"))).alias("cuts"))
    branches = shared.filter("not straight")
    nodes = saved(branches.groupBy("anchor", "segment", "windows").agg(F.min(F.struct("doc_id", "h", "place")).alias("holder")), "nodes")
    windows = saved(branch_windows(docs, nodes), "windows")
    first = saved(windows.groupBy("w1", "w2").agg(F.min("first_doc").alias("earliest")), "earliest")
    judged = windows.join(first, ["w1", "w2"]).groupBy("anchor", "segment").agg(F.collect_list(F.struct("offset", "earliest")).alias("judged"))
    judged = saved(judged, "judged")
    hits = F.filter("judged", lambda x: x["earliest"] < F.col("doc_id"))
    branched = branches.join(judged, ["anchor", "segment"]).withColumn("hits", hits).filter(F.size("hits") > 0)
    begin = F.col("place")
    branched = branched.select("doc_id", "h", F.transform("hits", lambda x: F.struct((begin + x["offset"]).cast("int").alias("begin"), (begin + x["offset"] + window).cast("int").alias("end"))).alias("cuts"))
    return straight.unionByName(branched).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every row's words and what is left: doc_id, n_words, n_removed, kept_text (kept words joined by one blank).

    Windows are judged on the input. A null or blank text has no words; rows without an id keep all and count for no
    other; rows with one id are one document; the smallest id among equals keeps its words.
    """
    keyed = _keyed(docs)
    cuts = saved(repeats(keyed), "cuts")

    def keep(batches: Iterator[pa.RecordBatch]):
        for part in chunks(batches, rows=512):
            texts, counts, removed = [], [], []
            for text, ranges in zip(part.column("text").to_pylist(), part.column("cuts").to_pylist(), strict=True):
                words = text.encode().split()  # of bytes: at the six ASCII blanks only
                counts.append(len(words))
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [r["begin"] for r in ranges], 1)
                    np.add.at(edge, [r["end"] for r in ranges], -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                removed.append(counts[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return keyed.join(cuts, ["doc_id", "h"], "left").select("doc_id", "text", "cuts").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256)).drop("kept_text")
