"""Language-model scores from an Elias-Fano n-gram trie."""

from __future__ import annotations

import ast
import io
import math
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import arrow_rows, give_back, mixed, part_hashes, sliced, stored, word_starts

END = np.uint64(0x454E4445)  # the end token's hash
CHUNK = 4 << 20  # bytes of text whose tokens share one row, at least
MOST_CHUNK = 32 << 20
BUCKET = 2 << 20  # n-grams of chunks whose counts are added up in one task, at least
CELL = 256  # n-grams that a chunk has for a bucket, at least, while chunks are under MOST_CHUNK
PRIOR = (100.0, 5.0)  # weight, in tokens, of the shorter context's share in a bigram's and a trigram's
STEP = 1e-3  # of a quantised log10
SLAB = 1 << 14  # look-ups at once, so that their arrays stay in the processor's cache


# ---- Elias-Fano sequences ------------------------------------------------------
def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Places of the i-th set bits; before: set bits ahead of each word."""
    at = np.searchsorted(before, i, side="right") - 1
    word, rest, place = words[at], (i - before[at]).astype(np.uint64), at.astype(np.int64) * 64
    for half in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << half) - 1)
        n = np.bitwise_count(low).astype(np.uint64)
        up = rest >= n
        rest = np.where(up, rest - n, rest)
        word = np.where(up, word >> np.uint64(half), low)
        place += np.where(up, half, 0)
    return place


class EliasFano:
    """A sequence that never falls: low bits packed, high bits in unary."""

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        values = np.asarray(values, np.uint64)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(universe >> low_bits) + n + 64) // 64 * 64 + 64, np.uint8)
        bits[high] = 1
        low = np.zeros((n * low_bits + 63) // 64 + 2, np.uint64)
        if low_bits and n:
            part, at = values & np.uint64((1 << low_bits) - 1), np.arange(n) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero((at & 63) + low_bits > 64)  # one value at most reaches into a next word
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        return {"high": np.packbits(bits, bitorder="little").view(np.uint64), "low": low.view(np.uint8), "meta": np.array([n, low_bits], np.int64)}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.high, self.low_bytes = parts["high"], parts["low"]
        self.n, self.low_bits = (int(x) for x in parts["meta"])
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.cumsum(ones) - ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        byte, out = bit >> 3, np.zeros(len(i), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            out |= self.low_bytes[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((_select(self.high, self.ones, i) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)).astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that isn't under x."""
        high, low = x >> self.low_bits, (x & ((1 << self.low_bits) - 1)).astype(np.uint64)
        first = lambda h: np.where(h > 0, _select(~self.high, self.zeros, np.maximum(h - 1, 0)) - (h - 1), 0)
        a, b = first(high), first(high + 1)
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            under = np.zeros(len(x), bool)
            under[open_] = self._low(mid[open_]) < low[open_]
            a, b = np.where(open_ & under, mid + 1, a), np.where(open_ & ~under, mid, b)
        return a

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, or -1."""
        out = np.full(len(x), -1, np.int64)
        for low in range(0, len(x) if self.n else 0, SLAB):
            part = x[low : low + SLAB]
            at = self.successor(part)
            inside = np.minimum(at, self.n - 1)
            out[low : low + SLAB] = np.where((at < self.n) & (self.access(inside) == part), at, -1)
        return out


# ---- the trie ----------------------------------------------------------------
def _quantised(log10: np.ndarray) -> np.ndarray:
    """16-bit codes, rounded down, so shares never sum to more than before."""
    return np.clip(np.ceil((5 - log10) / STEP), 0, 65535).astype(np.uint16)


def _value(code: np.ndarray) -> np.ndarray:
    return 5 - code.astype(np.float64) * STEP


class Trie:
    """Up to trigrams over words 0 to v - 1; id v is a text's start.

    Level 2 holds each context's successors as context * (v + 1) + word in
    one Elias-Fano sequence, with monotone pointers to where a context
    begins. Level 3 is under the bigram that is a trigram's context; the
    last word is kept as its rank among the successors of the word before it,
    so a query is a successor search in level 2, whose rank then is searched
    in level 3. Each n-gram has a quantised log10 probability, each context a
    quantised log10 weight of what the shorter context says (hierarchical
    Dirichlet prior, which needs no sums over successors).
    """

    @staticmethod
    def build(p1, context_n, bigrams, bigram_n, trigrams, trigram_n, prior=PRIOR) -> bytes:
        """p1 of each word; context_n of each word and the start; bigrams are sorted keys
        context * (v + 1) + word; trigrams are (place of the context's bigram, place of the
        bigram of the last two words), sorted."""
        v = len(p1)
        u, w = np.divmod(bigrams, v + 1)
        back1, back2 = prior[0] / (context_n + prior[0]), prior[1] / (bigram_n + prior[1])
        p2 = (bigram_n + prior[0] * p1[w]) / (context_n[u] + prior[0])
        pointers = np.searchsorted(bigrams, np.arange(v + 2) * (v + 1))
        width = int(np.diff(pointers).max()) + 1
        node, last = trigrams
        p3 = (trigram_n + prior[1] * p2[last]) / (bigram_n[node] + prior[1])
        level3 = node * width + last - pointers[w[node]]
        parts = {"sizes": np.array([v, width]), "back1": _quantised(np.log10(back1)), "p2": _quantised(np.log10(p2)), "back2": _quantised(np.log10(back2)), "p3": _quantised(np.log10(p3))}
        for name, values, universe in (("level2", bigrams, (v + 1) ** 2), ("pointers", pointers, len(bigrams) + 1), ("level3", level3, max(1, len(bigrams)) * width)):
            parts |= {f"{name}.{k}": x for k, x in EliasFano.build(values, universe).items()}
        out = io.BytesIO()
        head = repr([(k, str(x.dtype), len(x)) for k, x in parts.items()]).encode()
        out.write(len(head).to_bytes(8, "little") + head)
        for x in parts.values():
            out.write(b"\0" * (-out.tell() % 8) + x.tobytes())
        return out.getvalue()

    def __init__(self, blob: bytes):
        """The levels as memory maps of a file that has no name any more."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            whole = np.memmap(f, np.uint8, "r")
        n = int.from_bytes(whole[:8].tobytes(), "little")
        at, parts = 8 + n, {}
        for name, kind, length in ast.literal_eval(whole[8 : 8 + n].tobytes().decode()):
            at += -at % 8
            size = np.dtype(kind).itemsize * length
            parts[name] = whole[at : at + size].view(kind)
            at += size
        self.back1, self.p2, self.back2, self.p3 = (parts[k] for k in ("back1", "p2", "back2", "p3"))
        self.v, self.width = (int(x) for x in parts["sizes"])
        self.level2, self.pointers, self.level3 = (EliasFano({k: parts[f"{name}.{k}"] for k in ("high", "low", "meta")}) for name in ("level2", "pointers", "level3"))

    def pairs(self, v: np.ndarray, w: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 P(w | v), place in level 2 or -1); base: log10 of w alone."""
        place = self.level2.find(v * (self.v + 1) + w)
        out, hit = base + _value(self.back1[v]), place >= 0
        out[hit] = _value(self.p2[place[hit]])
        return out, place

    def triples(self, before: np.ndarray, v: np.ndarray, second: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 P(w | u v): before and second are the places of (u, v) and (v, w), lower is log10 P(w | v)."""
        out, known = lower.copy(), before >= 0
        out[known] += _value(self.back2[before[known]])
        both = np.flatnonzero(known & (second >= 0))
        third = self.level3.find(before[both] * self.width + second[both] - self.pointers.access(v[both]))
        out[both[third >= 0]] = _value(self.p3[third[third >= 0]])
        return out


# ---- n-grams of a chunk ---------------------------------------------------------
def _squeezed(x: np.ndarray) -> bytes:
    """Integers from 0 on, by planes of their bytes, each compressed alone, as their bytes are spread unlike one another's."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    packed = [zstandard.ZstdCompressor(level=1).compress(p.tobytes()) for p in planes[:used]]
    return np.array([len(x), used, *map(len, packed)], "<u4").tobytes() + b"".join(packed)


def _whole(data: bytes) -> np.ndarray:
    n, used = np.frombuffer(data, "<u4", 2).tolist()
    ends = np.cumsum(np.frombuffer(data, "<u4", used, 8)) + 8 + 4 * used
    planes = np.zeros((8, n), np.uint8)
    for plane, start, end in zip(planes, [8 + 4 * used, *ends], ends):
        plane[:] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[start:end]), np.uint8)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as gaps of their upper 56 bits, over their low bytes, which are mostly 0."""
    return np.diff(keys >> np.uint64(8), prepend=np.uint64(0)) << np.uint64(8) | keys & np.uint64(255)


def _keys(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps >> np.uint64(8), dtype=np.uint64) << np.uint64(8) | gaps & np.uint64(255)


def _kinds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with its inverse; where there is room, the place is sorted along in the low bits, which is much faster."""
    n = max(1, len(keys)).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + n > 64:
        return np.unique(keys, return_inverse=True)
    packed = keys.astype(np.uint64) << np.uint64(n) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order, keys = (packed & np.uint64((1 << n) - 1)).astype(np.int64), (packed >> np.uint64(n)).astype(np.int64)
    new = np.diff(keys, prepend=-1) > 0
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return keys[new], inverse


START = np.uint64(0x5354415254)


class Grams:
    """A chunk's different words, bigrams and trigrams, and where its tokens have them.

    hashes are those of the chunk's words, tokens their places, lengths the
    tokens of each text. keys has a corpus-wide key of each: odd for words,
    with a low byte of 0 for others, so 56 bits tell n-grams apart.
    """

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray):
        self.v, self.first = len(hashes), np.cumsum(lengths) - lengths
        before = np.concatenate([[self.v], tokens[:-1]])
        before[self.first] = self.v
        self.bigrams, self.at2 = _kinds(before * (self.v + 1) + tokens)
        inner = np.ones(len(tokens), bool)
        inner[self.first] = False
        self.inner = np.flatnonzero(inner)
        pair, self.at3 = _kinds(self.at2[self.inner - 1] * len(self.bigrams) + self.at2[self.inner])
        self.before, self.last = np.divmod(pair, max(1, len(self.bigrams)))  # trigrams as two bigrams
        self.left, self.right = np.divmod(self.bigrams, self.v + 1)
        every, low = np.append(hashes, START), np.uint64(255)
        two = mixed(every[self.left] * np.uint64(3) + mixed(every[self.right]))
        three = mixed(two[self.before] * np.uint64(5) + mixed(every[self.right[self.last]]))
        self.keys = np.concatenate([hashes | np.uint64(1), two & ~low, three & ~low])
        self.order = np.argsort(self.keys, kind="stable")

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        """x of all keys: that of words, bigrams and trigrams."""
        return np.split(x, [self.v, self.v + len(self.bigrams)])

    def buckets(self, n: int) -> np.ndarray:
        """Where each of n ranges of keys begins and ends in order."""
        bucket = (self.keys[self.order] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        return np.searchsorted(bucket.astype(np.int64), np.arange(n + 1))


def _words(data: bytes) -> np.ndarray:
    """Hashes from their gaps, which go round at 64 bits where a class ends."""
    return np.cumsum(_whole(data), dtype=np.uint64)


# ---- on Spark ------------------------------------------------------------------
CHUNKS = "chunk long, doc_id array<long>, held_out array<boolean>, lengths array<int>, tokens binary, words binary, n_grams long, train_texts long, train_tokens long"


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' different words, the words' places there token by token, and the tokens of each text.

    Words are in classes by the bits of their count, the most frequent first,
    and by hash in a class: places are small and hashes have small gaps.
    """
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = word_starts(data)
    lengths = np.diff(np.searchsorted(starts, ends), prepend=0) + 1
    last = np.cumsum(lengths) - 1  # the end tokens
    every = np.full(int(last[-1]) + 1, END)
    own = np.ones(len(every), bool)
    own[last] = False
    for low in range(0, len(starts), 1 << 17):  # a slab of words at once
        part = starts[low : low + (1 << 17)]
        stop = starts[low + (1 << 17)] if low + (1 << 17) < len(starts) else len(data)
        every[np.flatnonzero(own)[low : low + (1 << 17)]] = part_hashes(data[part[0] : stop], part - part[0], words=True)
    hashes, tokens = np.unique(every, return_inverse=True)
    order = np.argsort(-np.frexp(np.bincount(tokens))[1], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return hashes[order], place[tokens], lengths


def _tokenized(chunk_bytes: int):
    """Rows of about chunk_bytes of text: tokens as places in the chunk's own words."""

    def run(batches):
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        pending: list[tuple] = []

        def flush():
            nonlocal serial, pending
            hashes, tokens, lengths = _tokens([t for _, _, t in pending])
            train = np.array([not h for _, h, _ in pending])
            row = [[(part << 32) + serial], [[d for d, _, _ in pending]], [[h for _, h, _ in pending]], [lengths.astype(np.int32)], [_squeezed(tokens)], [_squeezed(np.diff(hashes, prepend=np.uint64(0)))], [3 * len(tokens)], [int(train.sum())], [int(lengths[train].sum())]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            serial, pending = serial + 1, []
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["chunk", "doc_id", "held_out", "lengths", "tokens", "words", "n_grams", "train_texts", "train_tokens"])

        size = 0
        for batch in sliced(batches):
            for doc, held, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode().lower()  # bytes: only A-Z change
                pending.append((doc, held, data))
                size += len(data)
                if size >= chunk_bytes:
                    yield flush()
                    size = 0
        if pending:
            yield flush()
        give_back()

    return run


def _dealt(buckets: int):
    """A row for each chunk and bucket: the keys of its n-grams there, as gaps, and their training counts."""

    def run(batches):
        for batch in sliced(batches, 1):
            chunk, held, lengths, tokens, words = (batch.column(c)[0].as_py() for c in ("chunk", "held_out", "lengths", "tokens", "words"))
            lengths, tokens = np.array(lengths), _whole(tokens).astype(np.int64)
            grams = Grams(_words(words), tokens, lengths)
            train = np.repeat(~np.array(held, bool), lengths)
            n = [np.bincount(at[own], minlength=size) for at, own, size in ((tokens, train, grams.v), (grams.at2, train, len(grams.bigrams)), (grams.at3, train[grams.inner], len(grams.last)))]
            n, keys, cuts = np.concatenate(n)[grams.order], grams.keys[grams.order], grams.buckets(buckets)
            out = [(b, chunk, _squeezed(_gaps(keys[i:j])), _squeezed(n[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "keys", "counts"])
        give_back()

    return run


def _summed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's n-grams, back to each chunk in its order; and a row (chunk null) with the number of different words."""
    chunks = rows["chunk"].to_pylist()
    keys = [_keys(_whole(x)) for x in rows["keys"].to_pylist()]
    kinds, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([_whole(x) for x in rows["counts"].to_pylist()]), len(kinds)).astype(np.int64)
    back = np.split(total[at], np.cumsum([len(x) for x in keys])[:-1])
    out = [(key[0].as_py(), c, _squeezed(x), None) for c, x in zip(chunks, back)]
    out.append((key[0].as_py(), None, None, int(((total > 0) & (kinds & np.uint64(1) > 0)).sum())))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["bucket", "chunk", "corpus", "kinds"])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(tokens: int, texts: int, kinds: int, prior: tuple[float, float]):
    def run(key: tuple[pa.Scalar, ...], chunk: pa.Table, counted: pa.Table) -> pa.Table:
        docs, held, lengths, at, words = (chunk[c][0].as_py() for c in ("doc_id", "held_out", "lengths", "tokens", "words"))
        lengths, at = np.array(lengths), _whole(at).astype(np.int64)
        grams = Grams(_words(words), at, lengths)
        parts = sorted(zip(counted["bucket"].to_pylist(), counted["corpus"].to_pylist()))
        n = np.empty(len(grams.keys), np.int64)
        n[grams.order] = np.concatenate([_whole(x) for _, x in parts]).astype(np.int64)
        c, n2, n3 = grams.cut(n)
        p1 = (c + 0.5) / (tokens + 0.5 * (kinds + 1))

        seen2, seen3 = n2 > 0, n3 > 0
        place = np.cumsum(seen2) - 1
        trie = Trie(Trie.build(p1, np.append(c, texts), grams.bigrams[seen2], n2[seen2], (place[grams.before[seen3]], place[grams.last[seen3]]), n3[seen3], prior))
        base = np.log10(p1)
        two, found = trie.pairs(grams.left, grams.right, base[grams.right])
        three = trie.triples(found[grams.before], grams.left[grams.last], found[grams.last], two[grams.last])
        log10 = two[grams.at2]
        log10[grams.inner] = three[grams.at3]
        add = lambda x: np.add.reduceat(x, grams.first)
        return pa.Table.from_arrays([pa.array(docs, pa.int64()), pa.array(held, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(add((c > 0).astype(np.int64)[at])), pa.array(add(base[at])), pa.array(add(log10))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def sizes(text_bytes: int) -> tuple[int, int]:
    """(bytes of a chunk, n-grams of a bucket) for so much text.

    A chunk has about half an n-gram a byte and sends each bucket one row. A
    row should have CELL n-grams or more, so chunks and buckets grow with the
    root of the corpus, up to what a task can hold.
    """
    grown = math.sqrt(max(1, CELL * text_bytes / (BUCKET / CHUNK)))
    chunk = int(min(MOST_CHUNK, max(CHUNK, grown)))
    return chunk, BUCKET * chunk // CHUNK


def score(docs: DataFrame, held_out: Column, prior: tuple[float, float] = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text.

    Learns from the texts that aren't held out (a null there counts as not),
    from every word, bigram and trigram of them: nothing is cut off by its
    count. Texts are cut to rows (chunks) of about CHUNK bytes. A chunk's
    different n-grams are dealt to ranges of their hashes, added up there
    over all chunks and sent back, so the model is spread over the cluster
    and grows with the corpus; the driver gets four sums. A range has each
    chunk's n-grams once, so no word or pair makes it large. Each chunk then
    builds the trie of those n-grams that its own texts can ask for, with
    counts of the whole corpus, and is scored by it. A context's probability
    is (n + prior * that of the shorter context) / (context's n + prior).
    A very long text is one chunk of its own. Columns of other names, clashing
    or not, don't matter, as only doc_id and text are read.

    score is log10 P of the whole text. Null texts are empty: one end token.
    Null ids and repeated rows are kept. Empty input, empty output. Words are
    told apart by 63-bit hashes, n-grams by 56-bit ones. Other columns are
    left out.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    chunk_bytes, bucket = sizes(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    with arrow_rows(spark, 500):
        chunks = stored(slim.mapInArrow(_tokenized(chunk_bytes), CHUNKS), "lm-chunks")
    total = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_grams", "train_texts", "train_tokens")], F.count("*").alias("chunks")).first()
    tokens, texts = total["train_tokens"], total["train_texts"]
    buckets = max(1, math.ceil(total["n_grams"] / bucket))
    with arrow_rows(spark, 2):
        dealt = chunks.select("chunk", "held_out", "lengths", "tokens", "words").mapInArrow(_dealt(buckets), "bucket long, chunk long, keys binary, counts binary")
        summed = stored(dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_summed, "bucket long, chunk long, corpus binary, kinds long"), "lm-counts")
    kinds = summed.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]

    tasks = max(1, total["chunks"])  # so a task has about one chunk, whatever the size of the table
    own = chunks.select("chunk", "doc_id", "held_out", "lengths", "tokens", "words").repartition(tasks, "chunk").groupBy("chunk")
    corpus = summed.where("chunk is not null").select("chunk", "bucket", "corpus").repartition(tasks, "chunk").groupBy("chunk")
    out = own.cogroup(corpus).applyInArrow(_scored(tokens, texts, kinds, tuple(prior)), SCORES)
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))
