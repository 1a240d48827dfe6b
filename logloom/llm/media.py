"""Op 6. Media columns: interleaved document sequences.

HTML pages are parsed into ordered elements, text or media references (digest, caption); references
meet the stored media by digest, and positions and captions stay with their elements. Payloads are
stored as 8-bit grey images 24 samples wide (a lossless PNG container), one object per digest and
writing task, and everything said about a payload is computed from the stored bytes read back.

Defined results: null html or text counts as empty (no elements; an empty payload is padded to 576
bytes of 255); a reference that no stored object answers stays, unresolved; repeated references and rows stay,
equal payloads share one digest; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, tune

WIDTH, UNIT = 24, 576
#: A digest with more than one in HOT of the references is split into SPLIT parts; there are fewer than HOT such digests.
HOT, SPLIT = 1000, 64
_PNG = b"\x89PNG\r\n\x1a\n"
ELEMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def encode(payload: bytes) -> bytes:
    """An 8-bit grey PNG of WIDTH columns; scan lines without filters."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def decode(stored: bytes) -> np.ndarray:
    """Samples (rows, WIDTH) of what `encode` stored; checks signature and checksums."""
    if stored[:8] != _PNG:
        raise ValueError("not a stored image")
    at, body, rows = 8, b"", 0
    while at < len(stored):
        (n,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        data = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            width, rows = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            body += data
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(rows, width + 1)[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Shape, integer mean, and the shares of four brightness bands in thousandths."""
    n = samples.size
    bands = np.bincount(samples.ravel() >> 6, minlength=4) * 1000 // n
    return f"{samples.shape[1]}x{len(samples)};mean={int(samples.sum(dtype=np.int64)) // n};bands=" + ",".join(map(str, bands))


def store(payloads: DataFrame) -> DataFrame:
    """payloads(digest, payload) -> the media store (digest, media), written; a task writes a digest once."""

    def put(batches):
        seen = set()
        for batch in batches:
            rows = []
            for d, p in zip(batch.column(0).to_pylist(), batch.column(1)):
                if d not in seen:
                    seen.add(d)
                    rows.append((d, encode(p.as_buffer())))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1], pa.binary())], ["digest", "media"])

    return durable(payloads.select("digest", "payload").mapInArrow(put, "digest string, media binary"))


def described(media: DataFrame) -> DataFrame:
    """media store -> one row a digest, from the bytes read back; the bytes themselves are not shuffled."""
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches):
        for batch in batches:
            rows = []
            for d, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = m.as_buffer().to_pybytes()
                s = decode(m)
                p = s.tobytes()
                rows.append((d, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], [x.split()[0] for x in schema.split(", ")])

    return media.select("digest", "media").mapInArrow(read, schema).dropDuplicates(["digest"])


class _Page(HTMLParser):
    """Ordered elements of one page: text runs, and images with the caption of their figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.run, self.skip, self.figure, self.caption = [], [], 0, None, None

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.out.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("img", "video", "audio", "source"):
            self.flush()
            source = a.get("src") or ""
            self.out.append(["media", None, a.get("data-digest") or source.rpartition("sha256:")[2] or None, a.get("alt")])
            if self.figure is not None:
                self.figure.append(self.out[-1])
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag not in ("b", "i", "em", "strong", "a", "span", "code", "u", "small", "sub", "sup"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for m in self.figure or []:
                m[3] = text
            self.caption = None
        elif tag == "figure":
            self.figure = None
        elif tag not in ("b", "i", "em", "strong", "a", "span", "code", "u", "small", "sub", "sup"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def elements(html: str | None) -> list[dict]:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    return [{"position": k, "kind": kind, "text": text, "digest": digest, "caption": caption} for k, (kind, text, digest, caption) in enumerate(page.out)]


def parsed(pages: DataFrame, key: str, *more: str) -> DataFrame:
    """pages(key, html, ...) -> key, elements and the other named columns."""
    struct_ = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def parse(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([elements(h) for h in batch.column(1).to_pylist()], struct_), *batch.columns[2:]], [key, "elements", *more])

    kind = lambda c: f"{c} {pages.schema[c].dataType.simpleString()}"
    return pages.select(key, "html", *more).mapInArrow(parse, ", ".join([kind(key), f"elements {ELEMENTS}", *map(kind, more)]))


def resolved(sequences: DataFrame, key: str, described_media: DataFrame, *more: str) -> DataFrame:
    """One row a media reference: key, position, caption, digest, the named columns and what the store says of it (null: unresolved).

    The text elements stay in `sequences`, aligned by position; only references are joined. They are written first, so that
    digests of many references can be counted without parsing twice: such a digest's references are dealt over SPLIT parts,
    and its one row of the store is repeated for each part. References without a digest are dealt out alike.
    """
    refs = sequences.select(key, *more, F.explode(F.filter("elements", lambda e: e["kind"] == "media")).alias("e")).select(key, *more, "e.position", "e.caption", "e.digest")
    refs = durable(refs)
    often = F.greatest(F.lit(refs.count() / HOT), F.lit(1.0))
    hot = F.broadcast(durable(refs.groupBy("digest").count().where(F.col("digest").isNotNull() & (F.col("count") > often)).select(F.col("digest").alias("_hot"))))
    split = F.col("_hot").isNotNull() | F.col("digest").isNull()
    dealt = refs.join(hot, F.col("digest") == F.col("_hot"), "left").withColumn("_part", F.when(split, F.pmod(F.xxhash64(key, "position"), F.lit(SPLIT))).otherwise(0).cast("int"))
    known = described_media.join(hot, F.col("digest") == F.col("_hot"), "left")
    known = known.withColumn("_part", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop("_hot").join(known.drop("_hot"), ["digest", "_part"], "left").drop("_part")


def interleaved(pages: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """pages(key, html) and a media store -> key, elements in page order, media elements with feature and size."""
    found = resolved(seq := parsed(pages, key), key, described(media))
    by_page = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "digest", "caption", "media_bytes", "feature"))).alias("media"))
    return seq.join(by_page, key, "left")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark, 128)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.octet_length("text")
    pad = F.greatest(F.ceil(n / UNIT), F.lit(1)) * UNIT - n
    filler = F.expr(f"substring(unhex(repeat('FF', {UNIT})), 1, CAST(pad AS INT))")
    sized = docs.withColumn("n_bytes", n.cast("long")).withColumn("pad", pad)
    payload = sized.withColumn("payload", F.concat(F.col("text").cast("binary"), filler)).withColumn("digest", F.sha2("payload", 256))
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<article><p>"), escaped, F.lit('</p><figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure></article>"))
    seq = parsed(payload.select("doc_id", html.alias("html"), "n_bytes"), "doc_id", "n_bytes")
    outline = F.transform("elements", lambda e: F.struct(e["position"].alias("position"), e["kind"].alias("kind"), e["caption"].alias("caption"), F.crc32(e["text"]).alias("text_crc32")))
    found = resolved(seq.withColumn("outline", outline), "doc_id", described(store(payload)), "n_bytes", "outline")
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", F.to_json("outline").alias("elements"),
    )
