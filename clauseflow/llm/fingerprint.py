"""Order MinHash fingerprints of whole texts, in DataFrame functions only.

A text's k-mers are its pairs of neighbouring words (the first word pairs with the text's beginning). Equal k-mers are
numbered in text order, so that repeats count. One hash of (k-mer, number) does for BINS permutations: its top bits
deal the k-mers into bins, and each bin keeps its TUPLE least. A bin's k-mers, in the order in which they stand in the
text, are hashed to the bin's value. Two texts agree in a bin only if they share these k-mers and their order, so the
share of bins that agree falls with the edit distance.

All sorts are of plain longs that carry a hash above and a position below, within a row; nothing is exploded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, shuffle_width, table

TUPLE = 2
BIN_BITS = 5
BINS = 1 << BIN_BITS
#: Low bits for a position: texts of up to 67 million words keep all positions apart.
PLACE_BITS = 26
#: Ranges of ids for each shuffle partition.
RANGES = 4
_PLACE = (1 << PLACE_BITS) - 1


def _above(hashed: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS)


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with an array<long> of (bin << 32 | value) for the bins that hold a k-mer, ascending. A text without words has none."""
    w, h, s, r, e, t = (f"_{name}_{x}" for x in "whsret")
    df = df.withColumn(w, F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x, i: F.xxhash64(F.get(w, i - 1), x)))
    df = df.withColumn(s, F.sort_array(F.transform(h, lambda x, i: _above(x, i)))).drop(w)  # equal k-mers together, in text order
    kmer = lambda v: F.shiftrightunsigned(v, PLACE_BITS)
    df = df.withColumn(r, F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (kmer(F.get(s, i)) != kmer(F.get(s, i - 1)))))

    def numbered(begin: Column, i: Column) -> Column:
        run = F.slice(s, begin + 1, F.coalesce(F.get(r, i + 1), F.size(s)) - begin)
        return F.transform(run, lambda v, number: _above(F.xxhash64(kmer(v), number), v.bitwiseAND(_PLACE)))

    df = df.withColumn(e, F.sort_array(F.flatten(F.transform(r, numbered)))).drop(s, r)
    least = F.filter(e, lambda v, i: (i < TUPLE) | (_bin(F.get(e, i - TUPLE)) != _bin(v)))
    df = df.withColumn(t, F.sort_array(F.transform(least, lambda v: F.shiftleft(_bin(v), PLACE_BITS).bitwiseOR(v.bitwiseAND(_PLACE))))).drop(e)

    def value(i: Column) -> Column:
        bin_ = kmer(F.get(t, i))
        own = F.filter(F.slice(t, i + 1, F.lit(TUPLE)), lambda v: kmer(v) == bin_)
        mixed = F.aggregate(own, F.lit(0).cast("long"), lambda a, v: F.xxhash64(a, kmer(F.get(h, v.bitwiseAND(_PLACE).cast("int")))))
        return F.shiftleft(bin_, 32).bitwiseOR(F.shiftrightunsigned(mixed, 32))

    firsts = F.filter(F.transform(t, lambda _, i: i), lambda i: (i == 0) | (kmer(F.get(t, i)) != kmer(F.get(t, i - 1))))
    return df.withColumn(name, F.transform(firsts, value)).drop(t, h)


def likeness(a: str, b: str) -> Column:
    """The share of bins that agree, of those that either signature holds; two empty texts are alike."""
    bins = F.array_union(F.transform(a, lambda v: F.shiftright(v, 32)), F.transform(b, lambda v: F.shiftright(v, 32)))
    return F.when(F.size(bins) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(bins), F.lit(1)))


def written(signature: Column) -> Column:
    """A signature as text: ten hex digits for each bin held."""
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 10, "0")), "")


def _bucket(key: Column, splitters: list[int]) -> Column:
    """How many of the ascending splitters are at most the key, in two steps of about their square root."""
    if not splitters:
        return F.lit(0)
    width = max(1, math.isqrt(len(splitters)))
    coarse = F.array(*[F.lit(x) for x in splitters[::width]])
    fine = F.array(*[F.array(*[F.lit(x) for x in splitters[i : i + width]]) for i in range(0, len(splitters), width)])
    block = F.size(F.filter(coarse, lambda x: x <= key))
    inside = F.size(F.filter(F.get(fine, block - 1), lambda x: x <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * width + inside)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (kd, h, text, ...) with the next different row's next_kd, next_h and next_text, the last with the first's.

    Rows are dealt into ranges of kd, a few for each shuffle partition, and one more row, the first of the range that
    follows, goes along with each; a window within a range then sees every neighbour. The texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = RANGES * shuffle_width(spark)
    at = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("kd", at, 10 * parts)).collect()[0][0] or []
    docs = docs.withColumn("range", _bucket(F.col("kd"), sorted(set(found))).cast("int"))
    firsts = docs.groupBy("range").agg(F.min(F.struct("kd", "h")).alias("k")).collect()  # a row for each range
    firsts.sort(key=lambda r: r["range"])
    follows = [(firsts[(i + 1) % len(firsts)]["k"]["kd"], firsts[(i + 1) % len(firsts)]["k"]["h"], r["range"]) for i, r in enumerate(firsts)]
    follows = spark.createDataFrame(follows, "kd long, h long, to int")
    extra = docs.join(F.broadcast(follows), ["kd", "h"]).groupBy("to").agg(F.min(F.struct(*docs.columns)).alias("r"))
    extra = extra.select(*[F.col("to").alias("range") if c == "range" else F.col(f"r.{c}").alias(c) for c in docs.columns], F.lit(1).alias("extra"))
    rows = docs.withColumn("extra", F.lit(0)).unionByName(extra)
    w = W.partitionBy("range").orderBy("extra", "kd", "h")
    after = F.struct(F.lead("kd").over(w).alias("kd"), F.lead("h").over(w).alias("h"), F.lead("text").over(w).alias("text"))
    rows = rows.withColumn("after", after).filter("extra = 0")
    different = (F.col("after.kd") != F.col("kd")) | (F.col("after.h") != F.col("h"))
    alone = F.lit(len(firsts) == 1)  # one range: its first may be its only row
    rows = rows.withColumn("after", F.when(different, F.col("after")))
    rows = rows.withColumn("after", F.max("after").over(W.partitionBy("range", "extra", "kd", "h")))
    whole = F.coalesce("after", F.when(alone, F.struct("kd", "h", "text")))
    rows = rows.withColumn("after", whole)
    return rows.select(*[c for c in docs.columns if c != "range"], F.col("after.kd").alias("next_kd"), F.col("after.h").alias("next_h"), F.col("after.text").alias("next_text"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's.

    The edited text ends in the first floor(n/4) signs of the next document instead of the text's own last. Null texts
    are empty; null ids come first; rows with one id follow each other by a hash of the text; repeated rows are one
    in that order and get the same values; a row without any other is its own next.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    docs = docs.withColumns({"kd": F.coalesce("doc_id", F.lit(-(1 << 63))), "h": F.xxhash64("text"), "n": F.length("text").cast("long")})
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n) - int(floor(n / 4)))"), F.expr("substring(next_text, 1, int(floor(n / 4)))"))).drop("next_text")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_signature(with_signature(rows, "text", "own").drop("text"), "edited", "other").drop("edited")
    rows = saved(rows, "signatures")
    nexts = rows.select(F.col("kd").alias("next_kd"), F.col("h").alias("next_h"), F.col("own").alias("following")).dropDuplicates(["next_kd", "next_h"])
    return rows.join(nexts, ["next_kd", "next_h"]).select(
        "doc_id",
        F.col("n").alias("n_chars"),
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("other")).alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
