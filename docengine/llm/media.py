"""Interleaved sequences of text and media references from HTML."""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.common import sliced, stored, without

ITEM = T.StructType().add("position", T.IntegerType()).add("kind", T.StringType()).add("text", T.StringType()).add("digest", T.StringType()).add("caption", T.StringType())
SEQUENCE = T.ArrayType(ITEM)
BLOCKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote pre figure figcaption br hr".split())
HIDDEN = frozenset(("script", "style", "template"))
SCHEME = "sha256:"
UNIT = 576  # samples of a frame: 24 rows of 24
SIDE = 24


# ---- HTML to a sequence -------------------------------------------------------
class _Sequence(HTMLParser):
    """Text runs between blocks and media references, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.run, self.hidden, self.figure, self.in_caption, self.caption = [], [], 0, None, False, []

    def flush(self):
        text = "".join(self.run)
        if text.strip():
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.in_caption, self.caption = True, []
        elif tag in ("img", "audio", "video", "source") and not self.hidden:
            at = dict(attrs)
            src = at.get("src") or ""
            if src.startswith(SCHEME):
                self.flush()
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": src[len(SCHEME) :].lower(), "caption": at.get("alt")})

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.in_caption:
            self.in_caption = False
            for item in self.items[self.figure or 0 :]:
                if item["kind"] == "media" and item["caption"] is None:
                    item["caption"] = "".join(self.caption).strip()
        elif tag == "figure":
            self.figure = None
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.in_caption:
            self.caption.append(data)
        elif not self.hidden:
            self.run.append(data)


def sequence(page: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.items


def _parsed(at: int, columns: list[str]):
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                items = pa.array([sequence(h) for h in part.column(at).to_pylist()], pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])))
                yield pa.RecordBatch.from_arrays([*part.columns, items], [*columns, "sequence"])

    return run


def interleave(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with sequence: text and media structs in document order.

    A media item is an img, audio, video or source whose src is
    "sha256:<digest>"; its caption is its alt, or its figure's figcaption.
    Scripts, styles and templates are left out, with the media in them. Null or
    empty HTML has an empty sequence; a very long page is parsed whole. Repeated
    rows are rows, an empty table gives one. Input columns keep their values,
    but for one named sequence, which is replaced.
    """
    base = without(pages, "sequence")
    schema = T.StructType([*base.schema.fields, T.StructField("sequence", SEQUENCE)])
    return base.mapInArrow(_parsed(base.columns.index(column), base.columns), schema)


def references(sequences: DataFrame, *keys: str) -> DataFrame:
    """One row a media item: the keys, position, digest and caption."""
    items = sequences.select(*keys, F.explode(F.filter("sequence", lambda i: i["kind"] == "media")).alias("_md"))
    return items.select(*keys, "_md.position", "_md.digest", "_md.caption")


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """refs with the columns of a store that has one row a digest; unknown digests keep nulls.

    Repeated references are rows, and empty tables are allowed; columns of
    both sides but digest must differ in name. A plain join on the digest: a digest with a third of all references is
    split by Spark's skew handling, as nothing above needs its rows together.
    """
    return refs.join(store, "digest", "left")


# ---- payloads as grey-scale PNG ---------------------------------------------------
def padded(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data)) % UNIT if data else UNIT)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey-scale PNG, SIDE samples a row, filter type 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    lines = np.zeros((len(rows), SIDE + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """Samples of a PNG that to_png wrote; any damage raises."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, width = 8, [], 0
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("PNG chunk is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", part)[0]
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """A difference hash: the mean frame as 24 rows of 24 samples, each against its right neighbour."""
    frame = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE).sum(axis=0, dtype=np.int64)
    return np.packbits(frame[:, :-1] < frame[:, 1:]).tobytes().hex()


def _encode(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            media = [to_png(padded((t or "").encode())) for t in part.column(1).to_pylist()]
            digests = [hashlib.sha256(m).hexdigest() for m in media]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests), pa.array(media, pa.binary())], ["doc_id", "digest", "media"])


def _decode(batches):
    for batch in sliced(batches):
        out = []
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if hashlib.sha256(media).hexdigest() != digest:
                raise ValueError(f"stored bytes of {digest} are damaged")
            payload = from_png(media)
            text = payload.rstrip(b"\xff")  # UTF-8 has no such byte
            out.append((digest, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), digest, feature(payload)))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each text's payload as PNG (doc_id, digest, media), written to the shared folder and read back.

    The payload is the text's UTF-8 (null: empty) with bytes 255 up to a
    positive multiple of UNIT.
    """
    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_encode, "doc_id long, digest string, media binary"), "media")


def decoded(media: DataFrame) -> DataFrame:
    """One row of features a digest, computed from the stored bytes beside the store.

    Only features are shuffled to drop repeats, never the bytes. They are
    written, so that a join with them is a join of two plain exchanges, where
    Spark can split a digest with many references.
    """
    return stored(media.select("digest", "media").mapInArrow(_decode, FEATURES).dropDuplicates(["digest"]), "media-features")


def _pages(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            digests = part.column(1).to_pylist()
            texts = [from_png(m).rstrip(b"\xff").decode() for m in part.column(2).to_pylist()]
            made = [page_of(t, d) for t, d in zip(texts, digests)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], ["doc_id", "html"])


def page_of(text: str, digest: str) -> str:
    """A page of a text's lines, with a figure after the first that refers to stored media."""
    first, *rest = [f"<p>{html.escape(line, quote=False)}</p>" for line in text.split("\n")]
    figure = f'<figure><img src="{SCHEME}{digest}"><figcaption>{digest[:12]} &amp; text</figcaption></figure>'
    return "".join(["<article>", first, figure, *rest, "</article>"])


def pages_of(media: DataFrame) -> DataFrame:
    """(doc_id, html): the page of each stored text, made from its stored bytes."""
    return media.select("doc_id", "digest", "media").mapInArrow(_pages, "doc_id long, html string")
