"""Similarity join of texts by the Jaccard similarity of their word shingles, exact, by grouped prefixes.

All tokens (hashed shingles) have one order, rare ones first: those that many texts share, counted over all texts, come
last, and ties go by hash. Two sets whose similarity reaches the threshold share a token of their prefixes, which are
as many first tokens as may be missing from a partner, and one more. Sets that are equal are one class; classes with
equal prefix and size are one group; and only groups meet, on the tokens of their prefixes. Pairs of groups pass if
sizes and the places of shared tokens still allow the similarity; they are expanded to their classes, pass a bound from
token counts by hash bucket, and are verified on the whole sets.

Since links are wanted as components, a pair inside one component need not be verified. So first each class meets the
least class of its group, and in a few turns one centre of each block it is in, which joins the members of a large
group of near copies without its pairs; then whatever pairs between different components remain are all verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, saved, table
from .components import components
from .substrings import Ranges, word_hashes
from .words import chunks

SHINGLE = 3
PERCENT = 90
BUCKETS = 64
#: Tokens that at least COMMON texts of a run of RUN tokens share are counted; the FREQUENT commonest come last in the
#: order. Any order is right; this one keeps blocks small.
COMMON = 3
RUN = 1 << 21
FREQUENT = 1 << 17
#: The first links are sought on so many of a class's rarest shared tokens, in so many turns, each class with so many
#: of the likeliest partners. They only make the last, complete search smaller.
STAR_TOKENS = 12
STAR_TURNS = 2
STAR_PARTNERS = 2


def token_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each text; one token for all words of a text with fewer than `shingle`."""
    import pyarrow.compute as pc

    for hashes in word_hashes(pc.ascii_lower(pc.fill_null(texts, ""))):
        if not len(hashes):
            yield np.zeros(0, np.uint64)
            continue
        k = min(shingle, len(hashes))
        at = np.arange(len(hashes) - k + 1)
        yield np.unique(Ranges(hashes, 0).of(at, at + k) ^ np.uint64(0 if k == shingle else k))


def frequent_tokens(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that most texts share, ascending, and how many were counted; at most FREQUENT of them."""

    def count(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            often = n >= COMMON
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

        for part in chunks(batches):
            for tokens in token_sets(part.column("text"), shingle):
                held.append(tokens)
                size += len(tokens)
            if size >= RUN:
                yield flush()
                held, size = [], 0
        yield flush()

    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    order = np.argsort(rows["token"].to_numpy(np.int64).view(np.uint64))
    return rows["token"].to_numpy(np.int64).view(np.uint64)[order], rows["n"].to_numpy(np.int64)[order]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """For each row: n, c1 and c2 (the set's hash), g (of prefix and size), prefix, counts (tokens by bucket, u16)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, shingle))  # at most FREQUENT pairs of numbers

    def cut(batches: Iterator[pa.RecordBatch]):
        common, often = sent.value
        names = ["n", "c1", "c2", "g", "prefix", "counts"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        for part in chunks(batches):
            out: list[list] = [[] for _ in names]
            for tokens in token_sets(part.column("text"), shingle):
                whole = xxhash.xxh3_128_intdigest(tokens.tobytes())
                c1, c2 = np.array([whole >> 64, whole & (1 << 64) - 1], np.uint64).view(np.int64).tolist()
                rank = np.zeros(len(tokens), np.int64)
                if len(common) and len(tokens):
                    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                    rank = np.where(common[at] == tokens, often[at], 0)
                first = tokens[np.lexsort((tokens, rank))[: prefix_length(len(tokens), percent) if len(tokens) else 0]]
                g = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(first.tobytes(), len(tokens))).view(np.int64)))
                counts = np.minimum(np.bincount((tokens % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 65535).astype("<u2")
                for col, v in zip(out, (len(tokens), c1, c2, g, first.view(np.int64), counts.tobytes()), strict=True):
                    col.append(v)
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), *arrays], ["doc_id", "h", *names])

    return docs.mapInArrow(cut, "doc_id long, h long, n long, c1 long, c2 long, g long, prefix array<long>, counts binary")


def overlap_needed(a: Column, b: Column, percent: int) -> Column:
    """The least intersection with which sets of these sizes reach the similarity."""
    return F.ceil(percent * (a + b) / F.lit(100.0 + percent) - 1e-9)


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose token counts by bucket allow the similarity: a bucket shares at most the lesser count."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("counts").alias(f"{c}_counts"), F.col("n").alias(f"{c}_n"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def keep(batches: Iterator[pa.RecordBatch]):
        for part in batches:
            counts = [np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, BUCKETS) for c in ("a_counts", "b_counts")]
            full = (counts[0] == 65535) & (counts[1] == 65535)  # may hold more than was counted
            most = np.minimum(*counts).sum(axis=1, dtype=np.int64) + np.where(full.any(axis=1), 1 << 40, 0)
            total = part.column("a_n").to_numpy() + part.column("b_n").to_numpy()
            good = pa.array((100 + percent) * most >= percent * total)
            bound = pa.array(np.minimum(most / np.maximum(total - most, 1), 1.0) if len(most) else np.zeros(0))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), bound], ["a", "b", "bound"]).filter(good)

    return joined.mapInArrow(keep, "a long, b long, bound double")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity; sets are made again from one text of each."""
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = classes.join(nodes, "node").select("node", F.col("holder.doc_id").alias("_id"), F.col("holder.h").alias("_h"))

    def sets(batches: Iterator[pa.RecordBatch]):
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([t.tobytes() for t in token_sets(part.column("text"), shingle)], pa.binary())], ["node", "tokens"])

    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["h"] == F.col("_h"))).select("node", "text")
    held = saved(texts.mapInArrow(sets, "node long, tokens binary"), "sets")
    side = lambda c: held.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def link(batches: Iterator[pa.RecordBatch]):
        for part in batches:
            good = []
            for x, y in zip(part.column("a_tokens"), part.column("b_tokens"), strict=True):
                x, y = (np.frombuffer(t.as_buffer(), np.uint64) for t in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int(np.count_nonzero(large[at] == small))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = saved(both.mapInArrow(link, "a long, b long").distinct(), "links")
    discard(held)
    return links


def star_pairs(near: DataFrame, labels: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of each class b with the centres of blocks it is in, of other components than its own.

    A block is a token and a band of sizes. Its centre is the class that has the token earliest in its order: fewest
    rare tokens stand before it, so that it is likest what the block has in common; later turns look at places more and
    more coarsely. A class has as many pairs as tokens at most: a turn is linear in the blocks, however large one is.
    """
    banded = _labelled(near, labels, "least", "label").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + (turn % 2) / 2))
    banded = saved(banded, "banded")
    early = F.struct(F.floor(F.col("place") / 2**turn).alias("early"), F.xxhash64(F.lit(turn), "least").alias("chance"), F.col("least").alias("centre"), F.col("label").alias("centre_label"))
    centres = banded.groupBy("token", "band").agg(F.min(early).alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y")
    centres = saved(centres.select("token", "band", "c.centre", "c.centre_label"), "centres")
    met = banded.join(centres, ["token", "band"]).filter("label <> centre_label")
    return met.select(F.col("centre").alias("a"), F.col("least").alias("b")).distinct()


def _labelled(frame: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    found = labels.select(F.col("node").alias(node), F.col("label").alias(name))
    return frame.join(found, node, "left").withColumn(name, F.coalesce(name, node))


def similar_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """For each row (doc_id, text): doc_id, h (text hash), n_shingles, component_id (least doc_id of its component).

    Two rows are linked if the Jaccard similarity of their sets of `shingle` words is at least percent / 100. A null, empty or blank text has no
    set, links with nothing and is its own component. A component without any id has a null one.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = saved(prefixes(docs, percent, shingle), "prefixes")
    found = rows.filter("n > 0")
    classes = found.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "h")).alias("holder"), F.min("doc_id").alias("least_id"), F.min("n").alias("n"), F.min("g").alias("g"), F.min("counts").alias("counts"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = found.groupBy("g").agg(F.min("n").alias("n"), F.min("prefix").alias("prefix"))
    members = classes.groupBy("g").agg(F.min("node").alias("least"), F.count("*").alias("members"))
    groups = saved(groups.join(members, "g"), "groups")
    narrow = saved(rows.drop("prefix", "counts", "g"), "rows")
    discard(rows)

    # Blocks: tokens in the prefixes of more than one group.
    places = groups.select("g", "n", "least", "members", F.posexplode("prefix").alias("place", "token"))
    shared = saved(places.groupBy("token").count().filter("count > 1").select("token"), "tokens")
    blocks = saved(places.join(shared, "token"), "blocks")

    # First links: with the least class of the own group, and with centres of the blocks.
    own = classes.join(groups.filter("members > 1").select("g", "least"), "g").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = verified(possible(own, classes, percent), classes, docs, percent, shingle)
    few = W.partitionBy("least").orderBy("place")
    near = saved(blocks.select("token", "least", "n", "place").withColumn("_k", F.row_number().over(few)).filter(F.col("_k") <= STAR_TOKENS).drop("_k"), "near")
    labels = components(links)
    for turn in range(STAR_TURNS):
        stars = star_pairs(near, labels, percent, turn)
        bounded = possible(stars, classes, percent)
        surest = W.partitionBy("b").orderBy(F.desc("bound"), "a")
        chosen = bounded.withColumn("_k", F.row_number().over(surest)).filter(F.col("_k") <= STAR_PARTNERS).select("a", "b")
        found_now = verified(chosen, classes, docs, percent, shingle)
        if found_now.isEmpty():
            break
        links = saved(links.unionByName(found_now), "links")
        labels = components(links)

    # All pairs of groups between different components, then of their classes.
    grouped = saved(_labelled(classes.select("node", "g"), labels, "node", "label"), "grouped")
    label_of = grouped.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    marked = blocks.join(label_of, "g")
    open_tokens = saved(marked.groupBy("token").agg(F.min("low").alias("x"), F.max("high").alias("y")).filter("x < y").select("token"), "open")
    marked = saved(marked.join(open_tokens, "token"), "marked")
    left = marked.select("token", *[F.col(c).alias(f"{c}1") for c in ("g", "n", "place", "low", "high")])
    right = marked.select("token", *[F.col(c).alias(f"{c}2") for c in ("g", "n", "place", "low", "high")])
    need = overlap_needed(F.col("n1"), F.col("n2"), percent)
    allowed = (
        (F.col("g1") < F.col("g2"))
        & (100 * F.col("n2") >= percent * F.col("n1"))
        & (100 * F.col("n1") >= percent * F.col("n2"))
        # The first token that a pair shares stands before all others it shares, in both prefixes.
        & (F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2")) >= need)
        & ~((F.col("low1") == F.col("high1")) & (F.col("low2") == F.col("high2")) & (F.col("low1") == F.col("low2")))
    )
    met = left.join(right, "token").filter(allowed)
    # Tokens shared so far and what can follow the last of them bound the intersection.
    met = met.groupBy("g1", "g2", "n1", "n2").agg(F.count("*").alias("common"), F.max("place1").alias("p1"), F.max("place2").alias("p2"))
    met = met.filter(F.col("common") + F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) - 1 >= need)
    member = lambda g, c: grouped.select(F.col("g").alias(g), F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    between = met.select("g1", "g2").join(member("g1", "a"), "g1").join(member("g2", "b"), "g2").filter("a_label <> b_label")
    mixed_groups = label_of.filter("low < high").select(F.col("g").alias("g1"))
    inside = mixed_groups.join(member("g1", "a"), "g1").join(member("g1", "b"), "g1").filter("a < b and a_label <> b_label")
    rest = between.select("a", "b").unionByName(inside.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = verified(possible(rest, classes, percent), classes, docs, percent, shingle)
    labels = components(links.unionByName(more))

    classes = _labelled(classes.select("c1", "c2", "node", "least_id"), labels, "node", "label")
    least = saved(classes, "labelled").groupBy("label").agg(F.min("least_id").alias("component"))
    classes = saved(classes.join(saved(least, "least"), "label").select("c1", "c2", "component"), "components")
    linked = narrow.filter("n > 0").join(classes, ["c1", "c2"])
    alone = narrow.filter("n = 0").withColumn("component", F.col("doc_id"))
    return linked.unionByName(alone.select(*linked.columns)).select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents")).drop("h")
