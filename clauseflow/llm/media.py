"""Media columns: interleaved document sequences with their payloads in a store of their own.

HTML becomes an ordered array of structs, text and media references in turn; a reference names its payload by digest
and keeps its position and caption. Payloads lie in a Parquet table of the shared folder, losslessly, as PNG images of
8-bit RGB samples, and are found again by joining on the digest. Payload bytes are read where they lie: what a join
moves is a digest and what was computed from the payload.

The query lays every document's payload into the sequence of a page: after what the page's own HTML holds follows a
figure for each of its documents. Where a document's figure stands, and under which caption, comes out of the parsed
sequence, and what its payload holds out of the join on the reference's digest.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, tucked
from .words import chunks

ROW_BYTES = 192  # 64 RGB pixels
PAD = b"\x20"
PNG = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position: int, kind: string, text: string, digest: string, caption: string>>"
#: A page with more figures than this is several sequences, each with the page's own items before its figures.
FIGURES = 64
DIGEST = re.compile(r"sha256:([0-9a-f]{64})")


def padded(data: bytes) -> bytes:
    """The bytes with blanks up to a positive multiple of ROW_BYTES."""
    return data + PAD * ((-len(data)) % ROW_BYTES if data else ROW_BYTES)


def to_png(payload: bytes) -> bytes:
    """A payload of whole rows as an RGB image, 64 pixels wide, 8 bits a sample, no filter."""
    height = len(payload) // ROW_BYTES
    rows = np.zeros((height, 1 + ROW_BYTES), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW_BYTES)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", ROW_BYTES // 3, height, 8, 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png wrote; checks every chunk's sum."""
    if media[:8] != PNG:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not 8-bit RGB")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], 1 + 3 * size[0])
    if rows[:, 0].any():
        raise ValueError("a row is filtered")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean and deviation of the samples, their entropy in bits, and their shares in 8 ranges, as text."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / max(1, len(payload))
    values = np.arange(256)
    mean = float(share @ values)
    deviation = float(np.sqrt(max(0.0, share @ (values * values) - mean * mean)))
    entropy = float(-(share[share > 0] @ np.log2(share[share > 0])))
    ranges = ",".join(f"{x:.4f}" for x in share.reshape(8, 32).sum(axis=1))
    return f"mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};ranges={ranges}"


class _Sequence(HTMLParser):
    """Text and media references in document order; scripts and styles are left out, block tags part texts.

    What a template or noscript holds is left out, too, once it is closed; one that never is, is no reason to lose the
    rest of the page.
    """

    BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul body title".split())
    MEDIA = frozenset(("img", "video", "audio", "source", "embed"))
    CODE = frozenset(("script", "style"))
    HIDDEN = frozenset(("template", "noscript"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.code = 0  # open scripts and styles
        self.hidden: list[tuple] = []  # of open templates: what was there before
        self.figures: list[dict] = []  # open ones: where their items begin, their captions, where the first of these stands
        self.caption: list[str] | None = None  # of the figure self.owner
        self.owner: dict | None = None
        self.named: set[int] = set()  # items that have a figure's caption

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        if self.caption is not None:
            if caption := " ".join("".join(self.caption).split()):
                self.owner["captions"].append(caption)
            self.caption = self.owner = None

    def end_figure(self) -> None:
        """The figure's captions go to its media that have none of an inner figure; without any they are a text."""
        if self.owner is self.figures[-1]:
            self.end_caption()
        self.flush()
        figure = self.figures.pop()
        caption = " ".join(figure["captions"])
        media = [item for item in self.items[figure["begin"] :] if item["kind"] == "media" and id(item) not in self.named]
        for item in media if caption else ():
            item["caption"] = caption
            self.named.add(id(item))
        if caption and not media:
            self.items.insert(figure["at"], {"kind": "text", "text": caption, "digest": None, "caption": None})

    def finish(self) -> None:
        self.end_caption()
        while self.figures:
            self.end_figure()
        self.flush()

    def handle_starttag(self, tag, attrs):
        self.code += tag in self.CODE
        if tag in self.HIDDEN:
            self.flush()
            self.hidden.append((len(self.items), len(self.figures), self.caption and list(self.caption), self.owner))
        if tag in self.BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append({"begin": len(self.items), "captions": [], "at": len(self.items)})
        elif tag == "figcaption" and self.figures:  # outside a figure it is text
            self.end_caption()
            self.caption, self.owner = [], self.figures[-1]
            if not self.owner["captions"]:
                self.owner["at"] = len(self.items)
        elif tag in self.MEDIA and not self.code:
            found = dict(attrs)
            if src := (found.get("src") or "").strip():
                self.flush()
                named = DIGEST.fullmatch(src)
                digest = named[1] if named else hashlib.sha256(src.encode("utf-8", "surrogatepass")).hexdigest()
                self.items.append({"kind": "media", "text": src, "digest": digest, "caption": found.get("alt") or None})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.CODE or tag in self.HIDDEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.CODE:
            self.code = max(0, self.code - 1)
        elif tag in self.HIDDEN and self.hidden:
            items, figures, self.caption, self.owner = self.hidden.pop()
            self.text = []
            del self.items[items:], self.figures[figures:]
        elif tag == "figcaption":
            self.end_caption()
        if tag in self.BLOCKS:
            self.flush()
        if tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data):
        if not self.code:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    if not html:
        return []
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser.finish()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def interleaved(pages: DataFrame, html: str = "html", name: str = "sequence") -> DataFrame:
    """pages with the ordered text and media references of their HTML; null or empty HTML gives an empty sequence.

    A reference whose source reads sha256:<hex> names its payload; of any other source the digest is that of its text.
    Captions are a figure's figcaption, else the alt text. Other columns pass through, a column `name` is replaced.
    """

    @F.udf(SEQUENCE, useArrow=True)
    def parse(text):
        return sequence_of(text)

    return pages.withColumn(name, parse(F.col(html)))


def references(sequences: DataFrame, name: str = "sequence") -> DataFrame:
    """A row for each media reference: the other columns, position, digest, caption."""
    kept = [c for c in sequences.columns if c not in (name, "position", "digest", "caption")]
    items = sequences.select(*kept, F.explode(name).alias("_item")).filter(F.col("_item.kind") == "media")
    return items.select(*kept, "_item.position", "_item.digest", "_item.caption")


def resolved(sequences: DataFrame, payloads: DataFrame, key: str, name: str = "sequence") -> DataFrame:
    """sequences with each item's payload columns joined by digest (null where none has it), aligned by position.

    Every row stays, with all its columns: one whose key is null or that others have, too, and one with an empty or
    null sequence. Rows are numbered and written first, so that their items come back to their own row.
    """
    if key not in sequences.columns:
        raise ValueError(f"no column {key}")
    rows, back = tucked(sequences, [name])
    rows = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "sequences")
    items = rows.select("_row", F.explode(name).alias("item"))
    # Written first, so that the join is of two plain exchanges and a hot digest's references can be split.
    held = saved(payloads.dropDuplicates(["digest"]), "payloads").select(F.col("digest").alias("_digest"), F.struct(*[c for c in payloads.columns if c != "digest"]).alias("payload"))
    media = items.filter(F.col("item.digest").isNotNull()).join(held, F.col("item.digest") == F.col("_digest"), "left").drop("_digest")
    rest = items.filter(F.col("item.digest").isNull()).withColumn("payload", F.lit(None).cast(held.schema["payload"].dataType))
    whole = media.unionByName(rest).groupBy("_row").agg(F.collect_list(F.struct(F.col("item.position").alias("position"), "item", "payload")).alias("_whole"))
    whole = whole.withColumn("_whole", F.array_sort("_whole", lambda a, b: a["position"] - b["position"]))
    empty = F.array().cast(whole.schema["_whole"].dataType)
    out = rows.withColumn("_items", F.col(name)).drop(name).join(whole, "_row", "left")
    return back(out.withColumn(name, F.coalesce("_whole", F.when(F.col("_items").isNotNull(), empty))))


def stored_texts(docs: DataFrame) -> DataFrame:
    """The media store of documents: doc_id, n_bytes, digest of the payload, media (PNG), in the shared folder."""

    def store(batches: Iterator[pa.RecordBatch]):
        for part in chunks(batches, rows=256):
            sizes, digests, media = [], [], []
            for text in part.column("text").to_pylist():
                data = (text or "").encode()
                payload = padded(data)
                sizes.append(len(data))
                digests.append(hashlib.sha256(payload).hexdigest())
                media.append(to_png(payload))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "digest", "media"])

    return saved(docs.select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, digest string, media binary"), "media")


def read_media(store: DataFrame) -> DataFrame:
    """What the stored payloads hold, a row for each digest: sizes, sums and features of the bytes read back."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]):
        for part in chunks(batches, rows=256):
            out: dict[str, tuple] = {}
            for digest, media in zip(part.column("digest").to_pylist(), part.column("media").to_pylist(), strict=True):
                if digest not in out:
                    payload = from_png(media)
                    out[digest] = (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out.values(), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.select("digest", "media").mapInArrow(read, schema).groupBy("digest").agg(*[F.min(n).alias(n) for n in names[1:]])


def pages_with_figures(store: DataFrame, pages: DataFrame) -> DataFrame:
    """The documents of a store laid into pages (page_id, url, html), as rows of page_id, url, sequence and figures.

    sequence is the part of the page's sequence that its documents add: its positions go on where those of the page's own
    items end, which stay where they were written. figures has the documents' doc_id, n_bytes and digest in the order of
    these references. Documents go to pages in turn. Pages that get none are left out; without any page each document has a sequence of
    its own. Null or damaged HTML gives no items, and the figures all the same.
    """
    parsed = saved(interleaved(pages.select("page_id", "url", "html")).drop("html").withColumn("at", F.monotonically_increasing_id()), "pages")
    part = F.shiftright("at", 33)
    counts = sorted((r[0], r[1]) for r in parsed.groupBy(part.alias("p")).count().collect())  # a row for each file read
    begins, n = [], 0
    for p, c in counts:
        begins.append((p, n))
        n += c
    offsets = store.sparkSession.createDataFrame(begins or [(0, 0)], "part long, begin long")
    numbered = parsed.withColumn("part", part).join(F.broadcast(offsets), "part")
    numbered = numbered.select((F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("page"), "page_id", "url", F.size("sequence").alias("own"))

    figure = F.format_string('<figure><img src="sha256:%s"><figcaption>%s</figcaption></figure>', F.col("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = store.select("doc_id", "n_bytes", "digest", figure.alias("html"), F.monotonically_increasing_id().alias("row"))
    page = F.pmod("row", F.lit(n)) if n else F.col("row")
    rows = saved(rows.withColumn("page", page), "figures")
    blocks = max(1, -(-rows.count() // max(1, n * FIGURES))) if n else 1
    shares = rows.withColumn("block", F.pmod(F.floor(F.col("row") / F.lit(max(1, n))), F.lit(blocks)))
    shares = shares.groupBy("page", "block").agg(F.array_sort(F.collect_list(F.struct("row", "doc_id", "n_bytes", "digest", "html"))).alias("all"))
    shares = shares.withColumn("html", F.array_join(F.transform("all", lambda x: x["html"]), "")).withColumn("figures", F.transform("all", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["n_bytes"].alias("n_bytes"), x["digest"].alias("digest"))))
    laid = interleaved(shares.select("page", "figures", "html"), name="added").drop("html").join(numbered, "page", "left")
    moved = F.transform("added", lambda x: x.withField("position", x["position"] + F.coalesce("own", F.lit(0))))
    return laid.select("page_id", "url", moved.alias("sequence"), "figures")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's stored payload holds, and where its reference stands in the sequence of its page.

    A null or empty text is a payload of blanks. Null ids have an empty caption, repeated rows a reference each; columns
    other than doc_id and text aren't read. An empty documents table gives no row, a missing or empty pages table leaves
    each document alone in its sequence.
    """
    store = stored_texts(table(spark, sf_dir, "documents"))
    try:
        pages = table(spark, sf_dir, "pages")
    except AnalysisException:
        pages = spark.createDataFrame([], "page_id long, url string, html string")
    whole = resolved(pages_with_figures(store, pages), read_media(store), "page_id")
    items = whole.select("page_id", F.posexplode("figures").alias("k", "doc"), "sequence").select("page_id", "doc", F.get("sequence", F.col("k")).alias("x"))
    return items.select("doc.doc_id", "doc.n_bytes", "x.payload.*", "x.position", F.coalesce("x.item.caption", F.lit("")).alias("caption"), "page_id")
