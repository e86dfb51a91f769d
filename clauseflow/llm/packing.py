"""Best-fit packing by bin completion.

How full sequences can get depends only on how many pieces have each length, and there are at most `capacity`
lengths, however many documents there are. So the search runs on that histogram, on the driver, and yields
patterns (lengths in one sequence) with multiplicities; the pieces then find their places by their rank among the
pieces of their length, in parallel.

The search: best-fit decreasing gives the incumbent. If it is above the lower bound, branch and bound takes the
largest length left and enumerates the undominated fillings of the room beside it one after the other, those without
waste first, each as often as the counts allow and then less often, and drops a branch once its waste exceeds what
would still beat the incumbent. A filling is dominated if some of its pieces could make way for one longer piece that
is left, as long as all of them together. Nothing but `steps` ends the search early; what it returns says whether the
result is proved to be the least number (it meets the bound, or all branches were tried) or how far from the bound it is.

Where an order is given, pieces are packed in ranges of it, so that the sequences follow that order.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_order, placed, saved, table
from .tokens import encoded, tokenizer_path

CAPACITY = 2048
SEPARATOR_ID = 0
#: Places that the search visits at most, one for each piece length it tries in a filling.
STEPS = 400_000
#: An order is followed in at most RANGES ranges of at least RANGE_SEQUENCES sequences each.
RANGES = 16
RANGE_SEQUENCES = 64

Pattern = tuple[tuple[int, int], ...]  # (length, times), lengths descending


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: equal bins are kept as one group with a multiplicity."""
    groups: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []  # sorted keys of groups

    def add(room: int, pattern: Pattern, times: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    add(capacity - each * length, ((length, each),), full)
                if rest:
                    add(capacity - rest * length, ((length, rest),), 1)
                break
            room = rooms[at]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = room // length
            use = min(times, left // each)
            rest = left - use * each if use < times else 0  # goes into one more bin, which it doesn't fill
            if spare := times - use - bool(rest):
                add(room, pattern, spare)
            if rest:
                add(room - rest * length, (*pattern, (length, rest)), 1)
                left -= rest
            if use:
                add(room - each * length, (*pattern, (length, each)), use)
                left -= use * each
    return [x for found in groups.values() for x in found]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Of the sequences needed: the sum's, and for each k what pieces of k and more need that no two large ones share."""
    n = np.zeros(capacity + 2, np.int64)
    for length, c in counts.items():
        n[length] = c
    sizes = n * np.arange(capacity + 2)
    number, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(sizes)])  # of lengths below i
    half = capacity // 2
    best = -(-int(total[-1]) // capacity)
    for k in [0, *(x for x in counts if 2 * x <= capacity)]:
        large = int(number[-1] - number[capacity - k + 1])
        middle = int(number[capacity - k + 1] - number[half + 1])
        room = middle * capacity - int(total[capacity - k + 1] - total[half + 1])
        small = int(total[half + 1] - total[k])
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


class OutOfSteps(Exception):
    """The search has visited as many places as it may."""


def dominated(filling: Pattern, waste: int, lengths: list[int], counts: dict[int, int]) -> bool:
    """Whether some pieces of the filling fit together into one longer piece that is left, which would fit for them."""
    used = dict(filling)
    sums, smaller = 1, sorted(used)  # sums: bit s is set if pieces shorter than x have the sum s
    at = 0
    for x in reversed(lengths):
        while at < len(smaller) and smaller[at] < x:
            for _ in range(used[smaller[at]]):
                sums |= sums << smaller[at]
            at += 1
        if counts[x] > used.get(x, 0):
            low = max(0, x - waste)
            if sums >> low & ((1 << (x - low + 1)) - 1):
                return True
    return False


def fillings(room: int, lengths: list[int], first: int, counts: dict[int, int], spare: int, tick: Callable[[], None]) -> Iterator[Pattern]:
    """All undominated fillings of the room with pieces of lengths[first:] that waste at most `spare`, one by one.

    Those without waste come first, otherwise those with the longest pieces. counts must be the same whenever the next
    one is asked for.
    """
    usable = [n for n in lengths[first:] if n <= room and counts[n]]
    below = [-n for n in usable]
    rest = [0] * (len(usable) + 1)
    for i in range(len(usable) - 1, -1, -1):
        rest[i] = rest[i + 1] + usable[i] * counts[usable[i]]

    def go(i: int, left: int, pattern: Pattern, least: int, most: int) -> Iterator[Pattern]:
        tick()
        for j in range(max(i, bisect.bisect_left(below, -left)), len(usable)):
            if left - rest[j] > most:
                break
            n = usable[j]
            for times in range(min(left // n, counts[n]), 0, -1):
                yield from go(j + 1, left - times * n, (*pattern, (n, times)), least, most)
        if least <= left <= most and not dominated(pattern, left, usable, counts):
            yield pattern

    yield from go(0, room, (), 0, 0)
    if spare:
        yield from go(0, room, (), 1, spare)


@dataclass(frozen=True)
class Packing:
    patterns: list[tuple[Pattern, int]]  # and how often each is used: every counted piece has one place
    size: int  # sequences
    bound: int  # no fewer are possible
    proved: bool  # size is the least number


def search(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Packing:
    """The fewest sequences that are found; depth first, with counts changed in place.

    A node's best-fit completion is tried as an incumbent now and then.
    """
    counts = {int(n): int(c) for n, c in counts.items() if c}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("a length is outside 1..capacity")
    best = best_fit_decreasing(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    bound, size = lower_bound(counts, capacity), sum(t for _, t in best)
    lengths = sorted(counts, reverse=True)
    visited, nodes = 0, 0

    def tick() -> None:
        nonlocal visited
        visited += 1
        if visited > steps:
            raise OutOfSteps

    def options(first: int, waste: int) -> Iterator[tuple[Pattern, int]]:
        """The sequences that may hold the largest length left, and how often: often first, then less often."""
        top = lengths[first]
        spare = (size - 1) * capacity - total - waste  # waste that would still beat the incumbent
        if spare < 0:
            return
        counts[top] -= 1
        found = fillings(capacity - top, lengths, first, counts, min(spare, capacity), tick)
        while True:
            filling = next(found, None)
            counts[top] += 1
            if filling is None:
                return
            pattern = Counter(dict(filling))
            pattern[top] += 1
            times = min(counts[n] // t for n, t in pattern.items())
            for k in range(times, 0, -1):
                yield tuple(sorted(pattern.items(), reverse=True)), k
            counts[top] -= 1

    path: list[tuple[Pattern, int]] = []
    stack: list[tuple[Iterator, int, int, int]] = []  # of each open node: what is left to try, first length, waste, sequences
    first, waste, used = 0, 0, 0
    try:
        while size > bound:
            while first < len(lengths) and not counts[lengths[first]]:
                first += 1
            if first == len(lengths) or nodes % 64 == 0:
                rest = best_fit_decreasing({n: c for n, c in counts.items() if c}, capacity)
                if used + sum(t for _, t in rest) < size:
                    best, size = [*path, *rest], used + sum(t for _, t in rest)
            nodes += 1
            stack.append((options(first, waste) if first < len(lengths) else iter(()), first, waste, used))
            while stack:
                tick()
                tried, first, waste, used = stack[-1]
                if len(path) == len(stack):  # what this node tried last is taken back
                    pattern, times = path.pop()
                    for n, t in pattern:
                        counts[n] += t * times
                found = next(tried, None)
                if found is None:
                    stack.pop()
                    continue
                pattern, times = found
                lost = (capacity - sum(n * t for n, t in pattern)) * times
                path.append(found)
                for n, t in pattern:
                    counts[n] -= t * times
                if waste + lost <= (size - 1) * capacity - total:
                    waste, used = waste + lost, used + times
                    break
            if not stack:
                return Packing(best, size, bound, True)  # every branch was tried
    except OutOfSteps:
        pass
    return Packing(best, size, bound, size <= bound)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[Pattern, int]]:
    """The patterns of search()."""
    return search(counts, capacity, steps).patterns


def places(patterns: list[tuple[Pattern, int]], sequence: int = 0) -> tuple[np.ndarray, int]:
    """The runs of ranks, a row each: length, first rank, pieces of the length in a sequence, first sequence, first offset;
    by length and rank. Sequences are numbered from `sequence`; the number after the last is returned, too."""
    runs = array("q")
    taken: Counter = Counter()
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            runs.extend((length, taken[length], each, sequence, offset))
            taken[length] += each * times
            offset += each * length
        sequence += times
    table = np.frombuffer(runs, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], sequence


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, separator: int = SEPARATOR_ID) -> DataFrame:
    """The pieces of every whole text's ids (the separator last): doc_id, piece, start, length, ids_crc32.

    A column place (of common.placed()) goes along with each piece.
    """
    end = np.array([separator], "<u4").tobytes()
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    kept = [c for c in docs.columns if c == "place"]

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            rows = []
            for row, (doc_id, data) in enumerate(encoded(iter([batch]), vocabulary)):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append(row)
                    for col, v in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            moved = [batch.column(c).take(pa.array(rows, pa.int64())) for c in kept]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)] + moved, names + kept)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select("doc_id", "text", *kept).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, steps: int = STEPS, order: list[str] | None = None) -> DataFrame:
    """Give every row of pieces (column length, 1 to capacity; doc_id and piece order equal lengths) a sequence_id and offset.

    Offsets of a sequence are gapless from 0. Rows that are alike get places of their own. An empty table stays empty.
    order: columns by which the pieces are dealt into ranges of about the same number of pieces, each packed by itself
    into sequences numbered after those of the range before; each range may cost a part of a sequence.
    """
    kept = pieces.columns
    ties = ["doc_id", "piece", "start", "ids_crc32"]
    if order:
        whole = pieces.agg(F.sum("length").alias("ids"), F.count("*").alias("n")).first()
        ranges = max(1, min(RANGES, (whole["ids"] or 0) // (capacity * RANGE_SEQUENCES)))
        pieces = dense_order(pieces, [*order, *ties]).withColumn("range", F.floor(F.col("idx") * ranges / F.lit(max(1, whole["n"]))).cast("int")).drop("idx")
        ties = [*order, *ties]
    else:
        pieces = pieces.withColumn("range", F.lit(0))
    counts: dict[int, dict[int, int]] = {}
    found = pieces.groupBy("range", "length").count().toArrow()  # at most RANGES times `capacity` rows
    for range_, length, n in zip(*(found[c].to_pylist() for c in ("range", "length", "count")), strict=True):
        counts.setdefault(range_, {})[length] = n
    ordered = dense_order(pieces, ["range", "length", *ties])
    tables, keys, begins, sequence, at = [], [], [], 0, 0
    for range_ in sorted(counts):
        runs, sequence = places(search(counts[range_], capacity, max(1, steps // len(counts))).patterns, sequence)
        tables.append(np.column_stack([range_ * (capacity + 1) + runs[:, 0], runs[:, 1:]]))
        for length in sorted(counts[range_]):
            keys.append(range_ * (capacity + 1) + length)
            begins.append(at)
            at += counts[range_][length]
    # As large as the patterns: bounded by ranges and capacity, not by rows.
    sent = pieces.sparkSession.sparkContext.broadcast((np.array(keys, np.int64), np.array(begins, np.int64), np.concatenate(tables or [np.zeros((0, 5), np.int64)])))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, begins, runs = sent.value
        for pdf in batches:
            sequence_of = np.zeros(len(pdf), np.int64)
            offset = np.zeros(len(pdf), np.int64)
            length, idx = pdf["length"].to_numpy(np.int64), pdf["idx"].to_numpy()
            key = pdf["range"].to_numpy(np.int64) * (capacity + 1) + length
            for k in np.unique(key):
                rows = np.flatnonzero(key == k)
                first, each, seq, off = runs[np.searchsorted(runs[:, 0], k) : np.searchsorted(runs[:, 0], k, "right"), 1:].T
                rank = idx[rows] - begins[np.searchsorted(keys, k)]
                run = np.searchsorted(first, rank, "right") - 1
                inside = rank - first[run]
                sequence_of[rows] = seq[run] + inside // each[run]
                offset[rows] = off[run] + inside % each[run] * length[rows[0]]
            yield pdf.drop(columns=["idx", "range"]).assign(sequence_id=sequence_of, offset=offset)

    names = [c for c in kept if c != "place"]
    schema = ", ".join(f"`{n}` {pieces.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    return ordered.select(*names, "range", "idx").mapInPandas(place, schema)


def packed_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places. A null text is empty; repeated rows are packed each."""
    return pack(saved(cut_pieces(docs, vocabulary or tokenizer_path(), capacity), "pieces"), capacity)


def packed_in_order(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """As packed_documents(), with sequences that follow the order in which the rows of docs were written."""
    place = placed(docs)
    pieces = cut_pieces(place.frame.select("doc_id", "text", place.column.alias("place")), vocabulary or tokenizer_path(), capacity)
    return pack(saved(pieces, "pieces"), capacity, order=["place"])


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids, a row for each piece.

    Null ids come first among pieces of one length, equal ids by piece and content; a null or empty text is one piece
    of the separator alone; a very long text is many pieces. An empty table gives no row. Other columns aren't read.
    """
    return packed_documents(table(spark, sf_dir, "documents"))
