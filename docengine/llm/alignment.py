"""Alignment of two tokenizers' tokens: an event sweep over token ends."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import give_back, scratch, stored
from docengine.llm.packing import AT_ONCE, Encoder, default_tokenizer_path

EVENTS = "row long, doc_id long, start long, side int, ids binary"
SWEPT = "doc_id long, row long, n_a long, n_b long, n_groups long, groups string, links array<struct<a:int,b:int,times:int>>"
RUN = 1 << 15  # tokens in a row of events
SWEEP = 1 << 18  # tokens that are swept at once
BROADCAST_PAIRS = 1_000_000  # of some 50 bytes


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---- tokens ---------------------------------------------------------------------------
def byte_level_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokens:
    """The bytes of each id, end to end."""

    def __init__(self, of_id: list[bytes]):
        self.size = np.array([len(b) for b in of_id], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(of_id), np.uint8)

    def spell(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether the ids' bytes are the text's."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if (ends[-1] if len(ends) else 0) != len(text):
            return False
        return np.array_equal(self.bytes[np.repeat(self.first[ids] - (ends - size), size) + np.arange(len(text))], np.frombuffer(text, np.uint8))


class ByteEncoder(Encoder):
    """Ids of whole texts by a byte-level vocabulary, as packing has them."""

    def tokens(self) -> Tokens:
        letters, of_id = byte_level_letters(), [b""] * len(self.first)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            of_id[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        return Tokens(of_id)


class PieceEncoder(Encoder):
    """Ids of whole texts by a vocabulary of pieces that mark a blank by U+2581; texts come with the blank that it adds.

    No piece has the mark behind another letter, so no merge crosses the
    place where a run of blanks begins, and a text's ids are those of its
    parts between such places. Vocabularies with such pieces encode whole texts.
    """

    MARK = "▁"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.parts = not any(re.search(f"[^{self.MARK}]{self.MARK}", n) for n in names)
        self.first = np.array([n.startswith(self.MARK) for n in names])
        self.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        blank = [self.pieces.piece_to_id(self.MARK)]  # of a text's last blank; the empty text, which it would be, has no ids
        return [np.array(x if t != " " else blank, np.uint32) for t, x in zip(texts, self.pieces.encode([t[1:] for t in texts], num_threads=1))]

    @staticmethod
    def starts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        cut = data == 0x20
        cut[1:] &= data[:-1] != 0x20
        cut[begin] = True
        return np.flatnonzero(cut)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return super().batch(texts) if self.parts else self.encode(texts)

    def tokens(self) -> Tokens:
        p, of_id = self.pieces, []
        for i in range(p.get_piece_size()):
            name = p.id_to_piece(i)
            of_id.append(b"" if p.is_control(i) or p.is_unknown(i) else bytes([int(name[3:5], 16)]) if p.is_byte(i) else name.replace(self.MARK, " ").encode())
        return Tokens(of_id)


# ---- events ----------------------------------------------------------------------------
def _events(path_a: str, path_b: str):
    """Texts to the union of the end events of both tokenizers, in runs of ids; where an event is follows from the start of its run and the ids' bytes."""

    def run(batches):
        from pyspark import TaskContext

        sides = (ByteEncoder(path_a), PieceEncoder(path_b))
        tokens = [s.tokens() for s in sides]
        narrow = ["<u2" if len(t.size) < 65_536 else "<u4" for t in tokens]
        row = TaskContext.get().partitionId() << 36

        def flush(docs, texts):
            nonlocal row
            fit = [i for i, t in enumerate(texts) if t and PieceEncoder.MARK not in t]  # a text with the mark comes out with a blank for it
            spaced = [" " + texts[i] for i in fit]
            ids, out = [s.batch(spaced) for s in sides], []
            found = {i: pair for i, t, pair in zip(fit, spaced, zip(*ids)) if all(k.spell(x, t.encode()) for k, x in zip(tokens, pair))}
            for i, doc in enumerate(docs):
                if i not in found:
                    out.append((row, doc, 0, 0, None))
                else:
                    for side, x in enumerate(found[i]):
                        ends = np.cumsum(tokens[side].size[x])
                        out += [(row, doc, int(ends[k - 1]) if k else 0, side, x[k : k + RUN].astype(narrow[side]).tobytes()) for k in range(0, len(x), RUN)]
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["row", "doc_id", "start", "side", "ids"])

        docs, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                docs.append(doc.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= AT_ONCE:
                    yield flush(docs, texts)
                    docs, texts, size = [], [], 0
        if docs:
            yield flush(docs, texts)
        give_back()

    return run


# ---- the sweep ---------------------------------------------------------------------------
class Sweep:
    """A machine that meets the events of one document after another, in the order of their offsets.

    It holds the ids since the last place where both sides ended, and what it
    has gathered of the document it is in.
    """

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray):
        self.size, self.b_ids = (size_a, size_b), len(size_b)
        most = max(len(size_a), len(size_b))
        digits = np.char.zfill(np.arange(most).astype("S"), len(str(most - 1))).view(np.uint8).reshape(most, -1)
        self.count = np.char.str_len(np.arange(most).astype("S"))
        self.digits = np.where(np.arange(digits.shape[1]) >= digits.shape[1] - self.count[:, None], digits, 0).astype(np.uint8)
        self.ids: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.waiting = 0  # tokens
        self.at, self.end = 0, 0  # what is swept, what has come of side 0; bytes since the first document
        self.docs: list[dict] = []  # documents that aren't done; the last may still grow
        self.done: list[dict] = []

    def open(self, row: int, doc_id: int | None) -> None:
        self.docs.append({"row": row, "doc_id": doc_id, "begin": self.end, "n_a": 0, "n_b": 0, "n_groups": 0, "groups": [], "links": []})

    def add(self, side: int, ids: np.ndarray) -> None:
        self.ids[side].append(ids.astype(np.int64))
        self.waiting += len(ids)
        if side == 0:
            self.end += int(self.size[0][ids].sum())

    def flush(self, last: bool = False) -> None:
        """Sweep to the last place where both sides end."""
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in self.ids)
        end_a, end_b = (self.at + np.cumsum(size[x]) for size, x in zip(self.size, (a, b)))
        if len(a) and len(b):
            shared_a = end_b[np.minimum(np.searchsorted(end_b, end_a), len(b) - 1)] == end_a
            if shared_a.any():
                n = int(np.flatnonzero(shared_a)[-1]) + 1
                m = int(np.searchsorted(end_b, end_a[n - 1])) + 1
                self._sweep(a[:n], end_a[:n], shared_a[:n], b[:m], end_b[:m])
                self.at = int(end_a[n - 1])
                a, b = a[n:], b[m:]
        self.ids, self.waiting = ([a], [b]), len(a) + len(b)
        keep = 0 if last else 1
        while len(self.docs) > keep:
            self.done.append(self.docs.pop(0))

    def _sweep(self, a, end_a, shared_a, b, end_b) -> None:
        shared_b = end_a[np.searchsorted(end_a, end_b)] == end_b
        group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        begin = np.concatenate([[self.at], end_a[shared_a][:-1]])
        doc_of = np.searchsorted([d["begin"] for d in self.docs], begin, side="right") - 1
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        # each place where a side ends closes one link of the token it is in on either side
        places = np.union1d(end_a, end_b)
        link_a, link_b = np.searchsorted(end_a, places), np.searchsorted(end_b, places)
        doc_link = doc_of[group_a[link_a]]
        pairs = np.int64(len(self.size[0]) * self.b_ids)
        links, times = np.unique(doc_link * pairs + a[link_a] * self.b_ids + b[link_b], return_counts=True)
        # a1,a2|b1;a3|b2: the ids in order, each behind a sign
        at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        sign[at_a[np.concatenate([[True], shared_a[:-1]])]] = ord(";")
        sign[at_b[np.concatenate([[True], shared_b[:-1]])]] = ord("|")
        cells = np.concatenate([sign[:, None], self.digits[ids]], axis=1).ravel()
        text = cells[cells > 0]
        ends = np.cumsum(self.count[ids] + 1)
        whole = np.bincount(doc_of[group_a], minlength=len(self.docs)), np.bincount(doc_of[group_b], minlength=len(self.docs)), np.bincount(doc_of, minlength=len(self.docs))
        stop = np.concatenate([[0], ends])[np.cumsum(whole[0] + whole[1])]
        link_stop = np.searchsorted(links, np.arange(1, len(self.docs) + 1) * pairs)
        low = link_low = 0
        for k, doc in enumerate(self.docs):
            if whole[2][k]:
                for name, n in zip(("n_a", "n_b", "n_groups"), whole):
                    doc[name] += int(n[k])
                doc["groups"].append(text[low + (not doc["groups"]) : stop[k]].tobytes())
                doc["links"].append((links[link_low : link_stop[k]] - k * pairs, times[link_low : link_stop[k]]))
            low, link_low = stop[k], link_stop[k]

    def rows(self) -> pa.RecordBatch:
        """What is done, as rows of SWEPT."""
        docs, self.done = self.done, []
        for d in docs:
            if len(d["links"]) > 1:
                pair, times = (np.concatenate(x) for x in zip(*d["links"]))
                pair, at = np.unique(pair, return_inverse=True)
                d["links"] = [(pair, np.bincount(at, times).astype(np.int64))]
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        each = [d["links"][0] if d["links"] else none for d in docs]
        pair, times = (np.concatenate([none[0], *[x[c] for x in each]]) for c in (0, 1))
        offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in each])]).astype(np.int32)
        links = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (pair // self.b_ids, pair % self.b_ids, times)], ["a", "b", "times"])
        columns = [pa.array([d[c] for d in docs], pa.int64()) for c in ("doc_id", "row", "n_a", "n_b", "n_groups")]
        groups = pa.array([b"".join(d["groups"]).decode() for d in docs], pa.string())
        return pa.RecordBatch.from_arrays([*columns, groups, pa.ListArray.from_arrays(pa.array(offsets), links)], ["doc_id", "row", "n_a", "n_b", "n_groups", "groups", "links"])


def _swept(path_a: str, path_b: str, at_once: int):
    def run(batches):
        sizes = [kind(path).tokens().size for kind, path in ((ByteEncoder, path_a), (PieceEncoder, path_b))]
        narrow = ["<u2" if len(s) < 65_536 else "<u4" for s in sizes]
        sweep, row = Sweep(*sizes), None
        for batch in batches:
            for r, doc, side, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "side", "ids"))):
                if r != row:
                    if sweep.waiting >= at_once or len(sweep.docs) >= at_once:
                        sweep.flush()
                        yield sweep.rows()
                    sweep.open(r, doc)
                    row = r
                if ids is not None:
                    sweep.add(side, np.frombuffer(ids, narrow[side]))
                    if sweep.waiting >= at_once:
                        sweep.flush()
                        if sweep.done:
                            yield sweep.rows()
        sweep.flush(last=True)
        yield sweep.rows()
        give_back()

    return run


# ---- the operator --------------------------------------------------------------------------
def alignments(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, at_once: int = SWEEP) -> DataFrame:
    """SWEPT: one row a document, with groups and links of its tokens.

    A is a byte-level vocabulary's tokens of a blank and the text, B a piece
    vocabulary's of the text, to which it adds that blank; special tokens'
    strings are plain text. Both sides' token ends are events at byte offsets.
    They go, in runs of ids, to the task of their document, sorted by offset,
    and stream through a machine: where both sides end, a group is done; at
    each event the two tokens it lies in are linked. groups is a string such
    as a1,a2|b1;a3|b2,b3 of decimal ids; links holds the distinct linked
    pairs, with how often each occurs. The machine's state is the ids since
    the last shared end (usually a word) and the current document's row.

    Texts that are null or empty, or whose tokens' bytes aren't those of
    blank and text, have no tokens: zeros, an empty string and no links.
    Repeated rows and null ids are kept (row tells rows apart). Very long
    texts are whole. Empty input, empty output. Needs doc_id and text; other
    columns are left out.
    """
    paths = tokenizer_a or default_tokenizer_path(), tokenizer_b or default_piece_path()
    events = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_events(*paths), EVENTS)
    sorted_events = events.repartition("row").sortWithinPartitions("row", "start", "side")
    return sorted_events.mapInArrow(_swept(*paths, at_once), SWEPT)


def with_counts(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned (stored; with row and links) and n_links, n_best, count_sum.

    A pair's count is the number of documents that hold it linked. n_best
    are the links whose count is the highest of their A id, ties included;
    count_sum adds the counts of all links. Pairs' counts are added up before
    they are shuffled, and are joined by broadcast up to broadcast_pairs of
    them, beyond that by a shuffle join.
    """
    links = aligned.select("row", F.inline("links"))
    with scratch(aligned.sparkSession):
        counts = links.groupBy("a", "b").agg(F.count("*").alias("docs"))
        counts = stored(counts, "pair-counts", stay=True)
        best = counts.groupBy("a").agg(F.max("docs").alias("most"))
        best = stored(counts.join(best, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best")), "best-pairs", stay=True)
    few = best.count() <= broadcast_pairs
    met = links.join(F.broadcast(best) if few else best, ["a", "b"])
    times = F.col("times").cast("long")
    sums = met.groupBy("row").agg(F.sum(times).alias("n_links"), F.sum(times * F.col("best")).alias("n_best"), F.sum(times * F.col("docs")).alias("count_sum"))
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_links", "n_best", "count_sum")}
    return aligned.drop("links").join(sums, "row", "left").withColumns(zero)
