"""Byte-level BPE with vectorised pre-tokenisation."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Classes of a code point; those of white space and apostrophes depend on what follows.
LETTER, NUMBER, OTHER, SHORT1, SHORT2, SPACE_LAST, BLANK_LAST, BLANK_IN, END = range(9)
# What the scan is in before a code point: nothing, a run of a class, white space, a space that
# joins the next run, a contraction with one or two letters to come.
NONE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_BLANK, JOINED, ONE_MORE, TWO_MORE = range(8)
#: White_Space of Unicode.
BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points handled in one scan, unless a single text is longer; pieces kept with their ids.
CHUNK, CACHED = 1_000_000, 150_000
#: Bytes from which a piece is merged by itself.
LONG = 400


def transition(kind: int, state: int) -> tuple[int, bool]:
    """State after a code point, and whether a piece begins at it."""
    if kind == LETTER:
        if state == ONE_MORE:
            return NONE, False
        if state == TWO_MORE:
            return ONE_MORE, False
        return IN_LETTER, state not in (JOINED, IN_LETTER)
    if kind == NUMBER:
        return IN_NUMBER, state not in (JOINED, IN_NUMBER)
    if kind in (OTHER, SHORT1, SHORT2):
        if state in (JOINED, IN_OTHER):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT1: ONE_MORE, SHORT2: TWO_MORE}[kind], True
    if kind == SPACE_LAST:
        return JOINED, True
    if kind == BLANK_LAST:
        return NONE, True
    if kind == BLANK_IN:
        return IN_BLANK, state != IN_BLANK
    return NONE, True


@lru_cache(1)
def scan_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Monoid of transition functions: element of each class, products, the constant value of
    an element (or -1), and whether a piece begins, by class and state."""
    step = [tuple(transition(k, s)[0] for s in range(8)) for k in range(9)]
    ids = {f: i for i, f in enumerate(dict.fromkeys(step))}
    todo = list(ids)
    for f in todo:
        for g in step:
            h = tuple(g[s] for s in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    product = np.array([[ids[tuple(g[s] for s in f)] for g in todo] for f in todo], np.uint16)
    constant = np.array([f[0] if len(set(f)) == 1 else -1 for f in todo], np.int8)
    begins = np.array([[transition(k, s)[1] for s in range(8)] for k in range(9)])
    return np.array([ids[f] for f in step], np.uint16), product, constant, begins


@lru_cache(1)
def point_classes() -> np.ndarray:
    """Letter, number, white space (BLANK_IN) or other, for every code point."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8)
    out[BLANKS] = BLANK_IN
    return out


def boundaries(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in code points of texts that each end with a separator at `ends`;
    and the class of each code point. Works by prefix products of transition functions."""
    element, product, constant, begins = scan_tables()
    kinds = point_classes()[points]
    kinds[ends] = END
    blank = kinds == BLANK_IN
    stays = np.empty_like(blank)  # followed by white space or the text's end
    stays[:-1] = blank[1:] | (kinds[1:] == END)
    stays[-1:] = True
    last = blank & ~stays
    kinds[last] = np.where(points[last] == 0x20, SPACE_LAST, BLANK_LAST)
    for i in np.flatnonzero(points[:-1] == 0x27):
        if kinds[i] == END:
            continue
        two = "".join(map(chr, points[i + 1 : i + 3]))
        if kinds[i + 1] != END and two[0] in "stmd":
            kinds[i] = SHORT1
        elif two in ("re", "ve", "ll") and kinds[i + 2] != END:
            kinds[i] = SHORT2
    f = np.concatenate([element[[END]], element[kinds]])
    gap = 1
    while gap < len(f) and (constant[f] < 0).any():
        f[gap:] = product[f[:-gap], f[gap:]]
        gap *= 2
    return begins[kinds, constant[f[:-1]]], kinds


class Pairs:
    """Ranks of pairs of ids whose tokens make up a token together, in an open-addressing table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.far = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)])
        known = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(known, np.int64).T
        self.bits = int(len(known) * 4).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, self.far, np.int32)
        keys, slot = left << 20 | right, self.slots(left << 20 | right)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], rank[put]
            keys, rank, slot = (np.delete(x, put) for x in (keys, rank, slot))
            slot = (slot + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        slot, out = self.slots(keys), np.full(len(keys), self.far, np.int32)
        at = np.arange(len(keys))
        while len(at):
            found = self.keys[slot]
            hit = found == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (found >= 0)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


def merge_all(pieces: list[bytes], pairs: Pairs) -> list[tuple[int, ...]]:
    """Ids of many pieces at once. In each round every unfinished piece merges its leftmost
    pair of the lowest rank; a token's id is its rank."""
    out: list[tuple[int, ...]] = [()] * len(pieces)
    who = np.arange(len(pieces))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ids = pairs.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    rank = np.full(len(ids), pairs.far, np.int32)
    rank[:-1] = pairs.rank(ids[:-1], ids[1:])
    rank[np.cumsum(sizes) - 1] = pairs.far
    while len(who):
        starts = np.cumsum(sizes) - sizes
        low = np.minimum.reduceat(rank, starts)
        done = low == pairs.far
        if done.any():
            values = ids.tolist()
            for k in np.flatnonzero(done).tolist():
                out[who[k]] = tuple(values[starts[k] : starts[k] + sizes[k]])
            keep = np.repeat(~done, sizes)
            ids, rank = ids[keep], rank[keep]
            who, sizes, low = who[~done], sizes[~done], low[~done]
            if not len(who):
                break
        of = np.repeat(np.arange(len(who)), sizes)
        hit = np.flatnonzero(rank == low[of])
        hit = hit[np.concatenate([[True], of[hit[1:]] != of[hit[:-1]]])]
        ids[hit] = rank[hit]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        ids, rank, of = ids[keep], rank[keep], of[keep]
        sizes -= 1
        hit -= np.arange(len(hit))
        last = np.cumsum(sizes) - 1
        rank[hit] = pairs.far
        inner = hit[hit < last]
        rank[inner] = pairs.rank(ids[inner], ids[inner + 1])
        prior = hit[hit > last - sizes + 1] - 1
        rank[prior] = pairs.rank(ids[prior], ids[prior + 1])
    return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one long piece, with a heap over a linked list."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    alive: list[bytes | None] = list(parts)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = alive[i]
        j = after[i]
        if left is None or j >= n or len(left) + len(alive[j]) != size:
            continue
        alive[i], alive[j] = left + alive[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(both := alive[a] + alive[b])) is not None:
                heapq.heappush(heap, (r, a, len(both)))
    return tuple(ranks[p] for p in alive if p is not None)


class Pieces(dict):
    """Ids of pieces seen before."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, Pairs(ranks)

    def learn(self, pieces: set[str]) -> None:
        todo = []
        for text in pieces - self.keys():
            piece = text.encode("utf-8", "surrogatepass")
            if piece in self.ranks:
                self[text] = (self.ranks[piece],)
            elif len(piece) > LONG:
                self[text] = merge_long(piece, self.ranks)
            else:
                todo.append((text, piece))
        if todo:
            texts, raw = zip(*todo)
            self.update(zip(texts, merge_all(raw, self.pairs)))


def encode_texts(texts: list[str], cache: Pieces) -> list[np.ndarray]:
    """Ids of each text."""
    out: list[np.ndarray] = []
    at = 0
    gc.disable()  # millions of tuples without cycles
    try:
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= CHUNK):
                size += len(texts[upto]) + 1
                upto += 1
            out += encode_chunk(texts[at:upto], cache)
            if len(cache) > CACHED:
                cache.clear()
            at = upto
    finally:
        gc.enable()
    return out


def encode_chunk(texts: list[str], cache: Pieces) -> list[np.ndarray]:
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    begin, kinds = boundaries(points, ends)
    edges = np.flatnonzero(begin)
    real = np.flatnonzero(kinds[edges] != END)
    pieces = [joined[a:b] for a, b in zip(edges[real].tolist(), edges[real + 1].tolist())]
    cache.learn(set(pieces))
    ids = list(map(cache.__getitem__, pieces))
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))
    upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(edges[real], ends)]
    return np.split(flat, upto[:-1])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines if line.strip())}


def _shared_ranks(df: DataFrame, path: str):
    # Bounded by the vocabulary, about 50,000 short tokens.
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text and the UTF-8 offset at which each token begins.

    `vocabulary` is the path of a rank file on the driver. Null texts count as empty; an empty
    text has no ids. Every input row gives one row. Code points are classed by Python's Unicode
    tables. Returns id, ids array<int>, offsets array<int>.
    """
    shared = _shared_ranks(docs, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = shared.value
        cache, width = Pieces(ranks), np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            width[i] = len(token)
        for batch in batches:
            ids = encode_texts([t or "" for t in batch["text"]], cache)
            offsets = [np.cumsum(width[x]) - width[x] for x in ids]
            yield pd.DataFrame({"id": batch["id"], "ids": [x.astype("i4") for x in ids], "offsets": [x.astype("i4") for x in offsets]})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInPandas(run, f"id {kind}, ids array<int>, offsets array<int>")
    return rows.withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of encoded texts: id, decoded binary. Null ids decode to no bytes."""
    shared = _shared_ranks(encoded, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = {i: t for t, i in shared.value.items()}
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "decoded": [b"".join(map(token.__getitem__, [] if x is None else x)) for x in batch["ids"]]})

    kind = dict(encoded.dtypes)[id_col]
    rows = encoded.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids").mapInPandas(run, f"id {kind}, decoded binary")
    return rows.withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text and returns id, n_tokens, ids_sha256 and
    decoded_sha256, without moving the ids out of the task. Nulls and rows as in bpe_encode."""
    shared = _shared_ranks(docs, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = shared.value
        cache, token = Pieces(ranks), {i: t for t, i in ranks.items()}
        for batch in batches:
            ids = encode_texts([t or "" for t in batch["text"]], cache)
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(b"".join(map(token.__getitem__, x.tolist()))).hexdigest() for x in ids],
                }
            )

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInPandas(run, schema)
    return rows.withColumnRenamed("id", id_col)
