"""Mixing sources to target weights, along a curriculum whose weights change over training time.

A source's share of the mix is its weight, held at `cap` passes over the source; what it can't take is shared again
by weight until no source is above its cap (targets). When the words come is the curriculum's: a source's weight at
training time t in [0, 1] is piecewise linear between knots, its integral is the part of its target that is due by t,
and inverting that integral gives the time at which any word count falls due. A document's copies come once a pass,
in a hashed order, at the time their first word falls due; range-sorting by that time gives the training order.

Whole passes take every document. Of the last, partial pass each source takes a part of its words: its documents fall
into classes by size (powers of CLASS), and from the class of the largest down each takes as much of its hashed order
as comes nearest to what is due of all classes so far, so that a later class of smaller documents makes up for what a
large document left over.

Running sums within a source are taken in hash buckets: each bucket is summed, the buckets' prefix sums are one small
row each, and each bucket is then numbered by itself, so that a hot source is many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dense_order, placed, saved, shuffle_width, table, tucked

CAP = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
#: Weight of a source over training time, as (time, weight) knots, by the place of its weight in WEIGHTS:
#: light sources fade out, heavy ones grow. Only the shape counts; its integral is scaled to the source's target.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
#: Sizes of a class lie within a factor of CLASS_BITS powers of two.
CLASS_BITS = 2
#: A bucket has about so many rows, as long as that makes no more than MOST_BUCKETS of them.
BUCKET_ROWS = 2_000
MOST_BUCKETS = 1 << 16

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filling(sizes: list[float], weights: list[float], cap: float = CAP) -> list[float]:
    """Targets that share sum(sizes) by weight, none above cap * its size; the excess is shared again by weight."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i])
    left, weight = total, sum(weights)
    for i in order:
        targets[i] = min(cap * sizes[i], left * weights[i] / weight) if weight else 0.0
        left -= targets[i]
        weight -= weights[i]
    return targets


def cumulative(schedule) -> list[tuple[float, float, float, float]]:
    """The schedule's integral, scaled to 1, by pieces: share due before, time, weight there, slope."""
    area = [((t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    if min(w for _, w in schedule) < 0 or sum(area) <= 0:
        raise ValueError("a schedule needs weights of at least 0 and a positive integral")
    out, due, whole = [], 0.0, sum(area)
    for ((t0, w0), (t1, w1)), a in zip(zip(schedule, schedule[1:], strict=False), area, strict=True):
        out.append((due, t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole))
        due += a / whole
    return out


def time_due(share: Column, schedule) -> Column:
    """The training time at which this share of a source's target has fallen due: the inverse of the integral."""
    found = F.lit(schedule[0][0])
    for due, time, weight, slope in cumulative(schedule):
        more = F.greatest(share - due, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight * weight) + 2 * slope * more, F.lit(0.0)))
        here = F.lit(time) + F.when(F.lit(weight) + root > 0, 2 * more / (F.lit(weight) + root)).otherwise(0.0)
        found = F.when(share >= due, here).otherwise(found)
    return F.least(found, F.lit(schedule[-1][0]))


def sources_of(sized: DataFrame, weights=WEIGHTS, cap: float = CAP) -> list[dict]:
    """For each source (names collected: a corpus has few): its place, name, size, target and kind (place in weights)."""
    rows = [(r["source"], r["size"] or 0) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    kinds = [i % len(weights) for i in range(len(rows))]
    targets = water_filling([s for _, s in rows], [weights[k] for k in kinds], cap)
    return [{"sid": i, "name": n, "size": int(s), "target": float(t), "kind": k} for i, ((n, s), t, k) in enumerate(zip(rows, targets, kinds, strict=True))]


def class_cuts(rows: DataFrame, sources: list[dict]) -> list[tuple[int, int, float]]:
    """(sid, class, words wanted) of the partial pass: a document is taken if its middle lies below what is wanted.

    One pass over the narrow rows for each class, the largest first; what a class took more or less than its part goes
    to the next one's account.
    """
    sums: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("class", "sid").agg(F.sum("size").alias("n")).collect():  # a row for each source and power
        sums.setdefault(r["class"], {})[r["sid"]] = r["n"]
    part = {x["sid"]: (x["target"] / x["size"]) % 1.0 if x["size"] else 0.0 for x in sources}
    due = dict.fromkeys(part, 0.0)
    cuts = []
    for c in sorted(sums, reverse=True):
        wanted = [(sid, c, due[sid] + part[sid] * n if part[sid] else 0.0) for sid, n in sums[c].items()]
        held = rows.sparkSession.createDataFrame([(sid, w) for sid, _, w in wanted], "sid int, wanted double")
        took = rows.filter(F.col("class") == c).join(F.broadcast(held), "sid").filter(F.col("at_class") + F.col("size") / 2 <= F.col("wanted"))
        got = {r["sid"]: r["n"] for r in took.groupBy("sid").agg(F.max(F.col("at_class") + F.col("size")).alias("n")).collect()}
        for sid, _, w in wanted:
            due[sid] = w - got.get(sid, 0)
        cuts += wanted
    return cuts


def planned(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, schedules=SCHEDULES, seed: int = 17) -> DataFrame:
    """The mix's plan for rows with doc_id, source, size and place (which tells rows apart that are alike otherwise)."""
    spark = docs.sparkSession
    sized = saved(docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")), "sizes")  # narrow, read several times
    sources = sources_of(sized, weights, cap)
    table_of = [(x["sid"], x["name"], x["size"], x["target"], x["kind"]) for x in sources]
    named = spark.createDataFrame(table_of, "sid int, _source string, source_size long, target double, kind int")
    buckets = min(max(16, sized.count() // BUCKET_ROWS), MOST_BUCKETS)
    rows = sized.join(F.broadcast(named.select("sid", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 7), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("class", F.floor((F.length(F.bin("size")) - 1) / CLASS_BITS).cast("int"))

    # Running sums of all documents of a source and of those of a class, by bucket and then within.
    begin = lambda *by: W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    within = lambda *by: W.partitionBy("sid", "bucket", *by).orderBy("h", "doc_id", "size", "place").rowsBetween(W.unboundedPreceding, -1)
    by_class = saved(rows.groupBy("sid", "bucket", "class").agg(F.sum("size").alias("n")), "bucket-sums")
    of_class = by_class.select("sid", "bucket", "class", F.coalesce(F.sum("n").over(begin("sid", "class")), F.lit(0)).alias("before_class"))
    of_source = by_class.groupBy("sid", "bucket").agg(F.sum("n").alias("n"))
    of_source = of_source.select("sid", "bucket", F.coalesce(F.sum("n").over(begin("sid")), F.lit(0)).alias("before"))
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(within()), F.lit(0))).withColumn("at_class", F.coalesce(F.sum("size").over(within("class")), F.lit(0)))
    rows = rows.join(of_source, ["sid", "bucket"]).join(of_class, ["sid", "bucket", "class"])
    rows = rows.withColumn("at", F.col("at") + F.col("before")).withColumn("at_class", F.col("at_class") + F.col("before_class")).drop("before", "before_class")
    rows = saved(rows, "mixing")

    cuts = spark.createDataFrame(class_cuts(rows, sources), "sid int, class int, wanted double")
    rows = rows.join(F.broadcast(named.drop("_source")), "sid").join(F.broadcast(cuts), ["sid", "class"])  # a row for each source, and for each of its classes
    full = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    last = (F.col("at_class") + F.col("size") / 2 <= F.col("wanted")).cast("long")
    rows = rows.withColumn("full", full).withColumn("passes", F.when(F.col("size") > 0, F.least(full + last, F.lit(int(cap)))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("taken", F.col("size") * F.col("passes"))

    # The k-th pass runs over demand k * source_size and on; within the partial pass documents keep their order, squeezed to its part.
    squeeze = F.col("target") / F.greatest("source_size", F.lit(1)) - F.col("full")

    def due(k):
        at = F.when(k < F.col("full"), F.col("at").cast("double")).otherwise(F.col("at") * squeeze)
        part = (k * F.col("source_size") + at) / F.greatest("target", F.lit(1.0))
        when = None
        for kind, schedule in enumerate(schedules):
            here = time_due(part, schedule)
            when = F.when(F.col("kind") == kind, here) if when is None else when.when(F.col("kind") == kind, here)
        return when.otherwise(part)

    copies = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("positions", F.transform(copies, due))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, passes, taken, positions, ranks.

    positions: the training times of the row's copies, ascending; ranks: the places of these copies in the training
    order, from 0, by a range sort of all copies. A null text or one without words has size 0 and is never taken; a
    null source is a source of its own, the last; null ids are ids like others. Rows that are alike are numbered and
    counted one by one; they may swap their places, which changes no result row. Columns other than doc_id, source and
    text aren't read. An empty table gives an empty result.
    """
    place = placed(docs)
    rows = place.frame.select("doc_id", "source", word_count(F.col("text")).alias("size"), place.column.alias("place"))
    plan = saved(planned(rows, **options), "plan")
    copies = plan.select("place", "h", "doc_id", F.posexplode("positions").alias("k", "position"))
    order = dense_order(copies, ["position", "h", "doc_id", "k", "place"])
    ranks = order.groupBy("place").agg(F.sort_array(F.collect_list("idx")).alias("ranks"))  # at most `cap` for each row
    return plan.join(ranks, "place", "left").select(
        "doc_id", "source", "size", "source_size", "target", "passes", "taken", "positions", F.coalesce("ranks", F.array().cast("array<bigint>")).alias("ranks")
    )


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, range-sorted by training time.

    A row finds its plan by its place in the files it is read from, so alike rows each have their own. All columns
    pass through, whatever their names; null texts are never taken, an empty table stays empty.
    """
    place = placed(docs)
    rows, back = tucked(place.frame, ["doc_id", "source", "text"], place=place.column)
    plan = planned(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), "place"), **options)
    plan = plan.filter("passes > 0").select(F.col("place").alias("plan_place"), "h", "positions")
    rows = rows.join(plan, F.col("place") == F.col("plan_place")).withColumn("position", F.explode("positions"))
    order = ["position", "h", "doc_id"]
    return back(rows.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, one row for each of them; see mixed() for nulls, ties, repeated rows and empty tables."""
    return mixed(table(spark, sf_dir, "documents")).drop("source", "passes")
