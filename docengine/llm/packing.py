"""Cost-balanced packing of tokenized documents into sequences."""

from __future__ import annotations

import heapq
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import give_back, part_hash_pairs

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
MEMO = 1_000_000  # pieces, of some 30 bytes each
AT_ONCE = 1 << 20  # bytes of text
JOINED = 100  # new pieces in a string; the tokenizer slows down on longer ones
#: White space other than blank, line feed, tab and carriage return, or what some call so.
ODD_SPACE = re.compile("[\\x00\\x0b\\x0c\\x1c-\\x1f\\x85\\u00a0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
_GAP = np.isin(np.arange(256), [0x20, 0x0A, 0x09, 0x0D])
_MARK = np.isin(np.arange(256), list(b",.;:!?*#%&$|"))
_ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts.

    The vocabulary's splitter always starts a new token where a run of white
    space begins, and between an ASCII letter or digit and marks that end a
    word. So a text's ids are those of its pieces between such places, one
    after another. A piece is encoded once and remembered by two 64-bit
    hashes, as flat arrays (MEMO pieces at most, then afresh). New pieces that
    are one blank or line feed and a word are encoded JOINED at a time as one
    string: its ids split at those that begin with a blank or line feed. Texts
    with ODD_SPACE, or a piece whose second hash is another's, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.first[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True  # a blank, a line feed
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)  # sorted by key
        self.at, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def starts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where the pieces of data begin; begin: where texts do."""
        gap, mark = _GAP[data], _MARK[data]
        before = np.roll(gap, 1)
        cut = gap & ~before
        ends = np.roll(gap, -1)  # the last byte of a word
        ends[begin[1:] - 1] = ends[-1] = True
        run = mark & np.roll(_ALNUM[data], 1)  # a mark after a letter or digit; its run of marks has to end the word
        change = np.flatnonzero(~mark | ends)  # the first place from a mark on that ends the run or the word
        first = np.flatnonzero(run)
        stop = change[np.minimum(np.searchsorted(change, first), len(change) - 1)]
        cut[first[mark[stop] & ends[stop]]] = True
        cut[begin] = True
        return np.flatnonzero(cut)

    def _learn(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        """Encode pieces that aren't known."""
        raw = data.tobytes()
        plain = _GAP[data[starts]] & (length > 1) & np.isin(data[starts], [0x20, 0x0A])
        plain[plain] &= ~_GAP[data[starts[plain] + 1]]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        k = int(plain.sum())
        pieces = [raw[s : s + n] for s, n in zip(starts[order].tolist(), length[order].tolist())]
        joined = [b"".join(pieces[i : min(i + JOINED, k)]).decode() for i in range(0, k, JOINED)]
        long = np.concatenate([np.empty(0, np.uint32), *self.encode(joined)])
        if np.count_nonzero(self.first[long]) != k:  # a vocabulary with tokens that hold a blank: their ids don't show where a piece ends
            k, long = 0, np.empty(0, np.uint32)
        alone = self.encode([p.decode() for p in pieces[k:]])
        cuts = np.flatnonzero(self.first[long])
        count = np.concatenate([np.diff(cuts, append=len(long)), np.array([len(x) for x in alone], np.int64)]).astype(np.int64)
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, long, *alone])
        place = np.searchsorted(self.keys, keys)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.keys, self.checks = np.insert(self.keys, place, keys), np.insert(self.checks, place, checks)
        self.at, self.count = np.insert(self.at, place, at[back]), np.insert(self.count, place, count[back])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        odd = [ODD_SPACE.search(t) is not None for t in texts]
        parts = [t.encode() for t, o in zip(texts, odd) if not o and t]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        again = [i for i, o in enumerate(odd) if o]
        if parts:
            size = np.array([len(p) for p in parts])
            begin, data = np.cumsum(size) - size, np.frombuffer(b"".join(parts), np.uint8)
            starts = self.starts(data, begin)
            length = np.diff(starts, append=len(data))
            key, check = part_hash_pairs(data, starts)
            kinds, one, at = np.unique(key, return_index=True, return_inverse=True)
            if len(self.keys) + len(kinds) > MEMO:
                self.clear()
            place = np.searchsorted(self.keys, kinds)
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == kinds if len(self.keys) else np.zeros(len(kinds), bool)
            if not known.all():
                new = one[~known]
                self._learn(data, starts[new], length[new], kinds[~known], check[new])
                place = np.searchsorted(self.keys, kinds)
            place = place[at]
            count = self.count[place]
            ends = np.cumsum(count)
            ids = self.ids[np.repeat(self.at[place] - (ends - count), count) + np.arange(ends[-1])]
            first = np.searchsorted(starts, begin)
            per_text = np.split(ids, (ends - count)[first[1:]])
            wrong = np.logical_or.reduceat(self.checks[place] != check, first)
            for i, one_text, bad in zip((i for i, o in enumerate(odd) if not o and texts[i]), per_text, wrong):
                out[i] = one_text
                if bad:
                    again.append(i)
        for i, x in zip(again, self.encode([texts[i] for i in again])):
            out[i] = x
        return out


def _cut(path: str, capacity: int, end_id: int):
    """Documents to pieces: full ones with their checksum, the rest with their ids."""

    def run(batches):
        from pyspark import TaskContext

        encoder, end = Encoder(path), np.array([end_id], np.uint32)
        narrow = "<u2" if max(end_id, len(encoder.first)) < 65_536 else "<u4"
        row = TaskContext.get().partitionId() << 36

        def flush(docs, texts):
            nonlocal row
            out = []
            for doc, ids in zip(docs, encoder.batch(texts)):
                ids = np.concatenate([ids, end])
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    out.append((doc, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids), row, None if len(piece) == capacity else piece.astype(narrow).tobytes()))
                    row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place", "ids"])

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
        del encoder
        give_back()

    return run


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int, float]]:
    """(piece, first, length, sequence, offset, cost) of each part placed.

    Sequences hold exactly the tokens there are: as many of full capacity as
    fit, and what is over in powers of two, so none needs padding. Pieces in
    descending cost go to the sequence of lowest cost that has room, the
    largest first on ties; a piece longer than the room is cut there.
    """
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    heap = [(0.0, -room, k) for k, room in enumerate(rooms)]
    used, out = [0] * len(rooms), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        first, left = 0, lengths[piece]
        while left:
            cost, room, k = heapq.heappop(heap)
            n = min(left, -room)
            own = linear * n + quadratic * n * n
            out.append((piece, first, n, k, used[k], own))
            used[k] += n
            if n < -room:
                heapq.heappush(heap, (cost + own, room + n, k))
            first, left = first + n, left - n
    return out


def _pack(capacity: int, linear: float, quadratic: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("place", "ascending")])
        doc, start, crc, tokens, ids = (rows[c].to_pylist() for c in ("doc_id", "start", "ids_crc32", "doc_tokens", "ids"))
        lengths, group, out = rows["length"].to_pylist(), key[0].as_py(), []
        for i, first, n, k, offset, cost in balance(lengths, capacity, linear, quadratic):
            check = crc[i]
            if n < lengths[i]:
                width = len(ids[i]) // lengths[i]
                check = zlib.crc32(np.frombuffer(ids[i], f"<u{width}")[first : first + n].astype("<u4").tobytes())
            out.append((doc[i], start[i] + first, n, check, tokens[i], (group << 32) + k, offset, cost))
        kinds = [pa.int64()] * 7 + [pa.float64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, group_docs: int = 1024) -> DataFrame:
    """Pieces of all documents with the sequence and offset they go to.

    A document's ids are its text's (null: empty) and end_id. It is cut at
    every multiple of capacity; pieces are dealt by a hash of their place in
    the input into groups of about group_docs documents' pieces, so repeated
    rows spread too, and each group is packed by balance(), with cost
    linear * n + quadratic * n * n for a piece of n tokens. Each id lies in
    one piece. Rows with the same or a null doc_id are packed like others.
    A very long text is cut like any other; its task holds its ids, 4 bytes
    each. Empty input, empty output. Other columns are left out.
    """
    groups = max(1, math.ceil(docs.count() / group_docs))
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(tokenizer or default_tokenizer_path(), capacity, end_id), PIECES)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "place"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack(capacity, linear, quadratic), PACKED)
