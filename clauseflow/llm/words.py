"""Words of whole texts in Arrow batches: each different word becomes a Python object once a batch, the rest is numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import BLANKS


def coded_words(texts: pa.Array, blanks: str = BLANKS) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(bounds, ids, words): text i has the words words[k] for k in ids[bounds[i]:bounds[i + 1]]; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    for blank in blanks:
        if blank != " ":
            texts = pc.replace_substring(texts, blank, " ")
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    none = pc.index(words, "").as_py()
    if none >= 0:
        real = ids != none
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        ids = ids[real]
    return bounds, ids, words


def strings(words: pa.Array) -> list[str]:
    """An array without nulls as Python objects, by way of numpy, which makes them several times as fast as Arrow."""
    return words.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array, blanks: str = BLANKS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As coded_words(), the words as Python objects."""
    bounds, ids, words = coded_words(texts, blanks)
    return bounds, ids, strings(words)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into parts of at most `rows` rows and about `size` bytes of text; no row is cut."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n = (n + 1) // 2
            part = batch.slice(at, n)
            # A copy that begins at offset 0: pc.ascii_lower misreads the offsets of a slice.
            yield part if n == batch.num_rows else part.take(pa.array(np.arange(n)))
            at += n


_held: list = []


def held(owner, make):
    """What make() gives for this owner, kept in this Python worker beyond a task. Only the last owner's is kept, so that
    operators that follow each other in one worker don't add up their caches."""
    if not _held or _held[0] is not owner and _held[0] != owner:
        _held.clear()
        _held.extend((owner, make()))
    return _held[1]


class Recent:
    """A bounded cache of two generations: once `limit` entries are new, those not asked for since the last turn go."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def find(self, keys: list[str]) -> tuple[list, list[str]]:
        """(values, missing keys): a missing key's value is None; keys are different from each other."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        values, young, old, missing = list(map(self.young.get, keys)), self.young, self.old, []
        for i, v in enumerate(values):
            if v is None:
                k = keys[i]
                v = old.get(k)
                if v is None:
                    missing.append(k)
                else:
                    values[i] = young[k] = v
        return values, missing

    def fill(self, keys: list[str], values: list) -> list:
        """The values again, those that were missing as they are now."""
        return [self.young[k] if v is None else v for k, v in zip(keys, values, strict=True)]
