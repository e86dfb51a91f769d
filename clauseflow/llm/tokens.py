"""Token ids of whole texts, and a binary format that stores them bit-packed.

Format of a shard file (all integers little-endian):

    magic "CFBITS01" | bits u32 | block u32 | n_docs u64 | n_ids u64 | n_blocks u64 |
    doc_id i64[n_docs] | doc_null u8[n_docs] | doc_start u64[n_docs + 1] | block_offset u64[n_blocks + 1] | payload

Every id takes `bits` bits (the least that hold the vocabulary), most significant bit first. A block holds `block`
ids and begins on a byte, so block_offset allows random access, and one block is unpacked by one numpy expression.
Shards are cut and named in ascending document order; doc_start counts from the shard's own first id.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_width, table
from .words import Recent, chunks, coded_words, held, strings

END_ID = 2
MAGIC = b"CFBITS01"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK = 4096
SHARD_IDS = 1 << 22
READ_IDS = 1 << 19
CACHE_WORDS = 180_000
#: Bytes of text that are split into words at once: what is made of them is several times as large.
CHUNK = 2 << 20
#: Signs that the pre-tokenizer parts from letters before them.
TAILS = ".,;:!?$%&*#)]}\"'|-"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    return _tokenizer(path).get_vocab_size(with_added_tokens=True)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts as little-endian u32 bytes.

    The tokenizer's pre-tokenizer never joins across a blank, so a text's ids are its words' ids in a row; ids of
    words seen before come from a bounded cache. It also parts letters from the signs that follow and lower-cases, so
    a word is looked up without its tail, and the cache holds it once for all its tails. New words of letters only are
    one pre-token each, whose last piece carries the end-of-word mark: many of them are encoded as one text, and the
    marks part their ids.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self.cache = Recent(CACHE_WORDS)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as u32 bytes; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # Lower case before composing accents could compose more, or make a special token: such texts go as they are.
        plain = pc.invert(pc.match_substring_regex(texts, "<\\||[\u0300-\u036f]"))
        docs, places, words = coded_words(pc.if_else(plain, pc.ascii_lower(texts), texts), "\n ")
        data = self.data(words)
        places, docs = places.tolist(), docs.tolist()
        return [b"".join([data[k] for k in places[a:b]]) for a, b in zip(docs, docs[1:], strict=False)]

    def data(self, words: pa.Array) -> list[bytes]:
        """The ids of each word. Only letters without their tail, tails and words of other signs are looked up and kept."""
        coded = pc.utf8_rtrim(words, TAILS).dictionary_encode()
        cores, of = strings(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        letters = np.fromiter(map(str.isalpha, cores), bool, len(cores))
        whole = np.flatnonzero(~letters[of])  # may be a special token, or more than letters
        sizes = pc.binary_length(words).to_numpy(), pc.binary_length(coded.dictionary).to_numpy()
        tailed = np.flatnonzero(letters[of] & (sizes[0] > sizes[1][of]))
        others = strings(words.take(pa.array(whole)))
        tails = [w[len(cores[k]) :] for w, k in zip(strings(words.take(pa.array(tailed))), of[tailed].tolist(), strict=True)]
        known = self.ids([w for w, x in zip(cores, letters.tolist(), strict=True) if x])
        rest = list({*others, *tails})
        signs = dict(zip(rest, self.ids(rest), strict=True))
        by_core: list = [None] * len(cores)
        for k, v in zip(np.flatnonzero(letters).tolist(), known, strict=True):
            by_core[k] = v
        out = [by_core[k] for k in of.tolist()]
        for i, w in zip(whole.tolist(), others, strict=True):
            out[i] = signs[w]
        for i, t in zip(tailed.tolist(), tails, strict=True):
            out[i] += signs[t]
        return out

    def ids(self, asked: list[str]) -> list[bytes]:
        """The ids of each of these, which are different from each other."""
        found, missing = self.cache.find(asked)
        if missing:
            self.learn(missing)
            found = self.cache.fill(asked, found)
        return found

    def learn(self, missing: list[str]) -> None:
        letters, whole = [w for w in missing if w.isalpha()], [w for w in missing if not w.isalpha()]
        known = self.cache.young
        for at in range(0, len(letters), 2048):
            part = letters[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or len(ids) != (stops[-1] if len(stops) else 0):
                whole += part  # signs that the tokenizer sees otherwise than Python
                continue
            data, stops = ids.tobytes(), (4 * stops).tolist()
            known.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        for at in range(0, len(whole), 2048):
            part = whole[at : at + 2048]
            got = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            known.update((w, np.asarray(e.ids, "<u4").tobytes()) for w, e in zip(part, got, strict=True))


def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its cache outlives a task."""
    return held(("encoder", path), lambda: Encoder(path))


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as u32 bytes) of each row of Arrow batches with doc_id and text; a null text is empty."""
    encode = encoder(path)
    for part in chunks(batches, rows=2048, size=CHUNK):
        yield from zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True)


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, bits each, most significant first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8)).tobytes()


def unpack_block(data, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)).astype(np.uint32)
    return flat.astype(np.uint32) @ weights


class ShardBuilder:
    """A shard in the making: full blocks are packed as they come, so that it holds little more than the file's bytes."""

    def __init__(self, bits: int, block: int = BLOCK):
        self.bits, self.block, self.n_ids = bits, block, 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.packed: list[bytes] = []
        self.rest: list[bytes] = []  # ids of the block that isn't full yet
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.rest.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block:
            self._pack(self.held - self.held % self.block)

    def _pack(self, count: int) -> None:
        ids = np.frombuffer(b"".join(self.rest), "<u4")
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.packed += [pack_block(ids[at : min(at + self.block, count)], self.bits) for at in range(0, count, self.block)]
        self.rest, self.held = [ids[count:].tobytes()], len(ids) - count

    def parts(self) -> Iterator[bytes]:
        """The file's bytes, part by part; nothing can be added after it."""
        if self.held:
            self._pack(self.held)
        starts = np.zeros(len(self.counts) + 1, "<u8")
        np.cumsum(self.counts, out=starts[1:])
        offsets = np.zeros(len(self.packed) + 1, "<u8")
        np.cumsum([len(p) for p in self.packed], out=offsets[1:])
        yield HEAD.pack(MAGIC, self.bits, self.block, len(self.counts), self.n_ids, len(self.packed))
        yield np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
        yield np.array([d is None for d in self.doc_ids], "u1").tobytes()
        yield starts.tobytes()
        yield offsets.tobytes()
        yield from self.packed


def shard_bytes(doc_ids: list[int | None], parts: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    builder = ShardBuilder(bits, block)
    for doc_id, ids in zip(doc_ids, parts, strict=True):
        builder.add(doc_id, ids)
    return b"".join(builder.parts())


class Shard:
    """Random access to a shard file's bytes; only the blocks that a range touches are unpacked."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEAD.size
        raw = np.frombuffer(data, "<i8", self.n_docs, at)
        null = np.frombuffer(data, "u1", self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(raw, null, strict=True)]
        at += 9 * self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        got = [
            unpack_block(self.payload[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits)
            for b in range(first, last + 1)
        ]
        return np.concatenate(got)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def put_file(uri: str, parts: Iterable[bytes]) -> None:
    """Write a file of the shared store whole: under a name of its own first, then moved into place."""
    import uuid

    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file://" + urlparse(uri).path
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    store.move(own, path)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every whole text and write shard files under `folder`, in ascending doc_id order (null ids first).

    Returns the manifest: name, n_ids, first (ids of all shards before it). A task that runs again writes the same
    bytes under the same names. Rows with one doc_id follow each other by a hash of their text, so that many of them
    are still dealt to many tasks; repeated rows are written each. A null text gives only the end id. A very long text
    makes its shard longer, no text is cut. An empty table writes no file and returns an empty manifest.
    """
    spark = docs.sparkSession
    bits = width_of(max(vocabulary_size(vocabulary), (end_id or 0) + 1))
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names, counts, shard = [], [], ShardBuilder(bits)

        def flush():
            nonlocal shard
            name = f"part-{part:06d}-{len(names):06d}.bits"
            put_file(f"{folder}/{name}", shard.parts())
            names.append(name)
            counts.append(shard.n_ids)
            shard = ShardBuilder(bits)

        for doc_id, data in encoded(batches, vocabulary):
            shard.add(doc_id, data + end)
            if shard.n_ids >= shard_ids:
                flush()
        if shard.counts:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "n_ids"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(shuffle_width(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    rows = sorted(map(tuple, ordered.mapInArrow(write, "name string, n_ids long").collect()))  # a row for each file
    first, manifest = 0, []
    for name, n in rows:
        manifest.append((name, n, first))
        first += n
    return spark.createDataFrame(manifest, "name string, n_ids long, first long")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shard files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bits").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    kinds = (pa.string(), *[pa.int64()] * 4)
    names = ["name", "doc_id", "inside", "n_tokens", "ids_crc32"]

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(data.as_py())
                out: tuple[list, ...] = ([], [], [], [], [])
                first = 0
                while first < shard.n_docs:  # many documents at a time, so that a block is unpacked once
                    last = max(first + 1, int(np.searchsorted(shard.starts, shard.starts[first] + READ_IDS, "right")) - 1)
                    data = shard.ids(int(shard.starts[first]), int(shard.starts[last])).tobytes()
                    at = (shard.starts[first : last + 1] - shard.starts[first]).tolist()
                    out[4].extend(zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False))
                    first = last
                out[0].extend([name] * shard.n_docs)
                out[1].extend(shard.doc_ids)
                out[2].extend(shard.starts[:-1].tolist())
                out[3].extend(np.diff(shard.starts).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    rows = files.mapInArrow(read, "name string, doc_id long, inside long, n_tokens long, ids_crc32 long").join(manifest, "name")
    return rows.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as bit-packed shard files and read back from them.

    A row for each row of documents, repeated ones too: rows of one id by a hash of their text, null ids first. A null
    or empty text has its end id only. An empty table gives no row. Columns other than doc_id and text aren't read.
    """
    folder = scratch_path(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, manifest)
