"""Stupid-backoff language-model scores of all documents against counts over all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Bytes of text in a chunk, about, and bytes of text for each partition of the count tables.
CHUNK, PART = 12 << 20, 8 << 20
BACKOFF = 0.4


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, chunk) as one compressed row for each chunk of a batch."""
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        order = np.argsort(chunks, kind="stable")
        names, begins = np.unique(chunks[order], return_index=True)
        packs = []
        for places in np.split(order, begins[1:]) if len(order) else []:
            sink = pa.BufferOutputStream()
            rows = batch.select(["id", "text"]).take(pa.array(places))
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_batch(rows)
            packs.append(zstandard.compress(sink.getvalue(), 3))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packs, pa.binary())], ["chunk", "pack"])


def unpacked(packs) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(pack)).read_all() for pack in packs])


def word_hashes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, and how many each has."""
    parts = []
    for text in texts.cast(pa.binary()):
        words = (text.as_py() or b"").split()  # at the six ASCII blanks
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.array([len(p) for p in parts], np.int64)


def grams(hashes: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """In turn, for n = 1 to order, the hash of the n-gram that ends at each word; 0 where the document has
    not begun n words ago."""
    first = np.cumsum(sizes) - sizes
    last = mixed(hashes) | np.uint64(1)
    yield last
    for n in range(2, order + 1):
        longer = np.zeros(len(hashes), np.uint64)
        longer[1:] = mixed(last[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) | np.uint64(1)
        for place in range(n - 1):
            longer[first[sizes > place] + place] = 0
        last = longer
        yield last


def squeezed(values: np.ndarray) -> bytes:
    """Small integers in few bytes: bytes of equal weight together, compressed."""
    return zstandard.compress(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def squeezed_keys(keys: np.ndarray) -> bytes:
    """Ascending integers by their differences."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def unsqueezed_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data), dtype=np.uint64)


def slices(keys: np.ndarray, parts: int) -> list[int]:
    """Where each partition's range of hashes begins among sorted keys, and where the last ends."""
    width = (1 << 64) // parts + 1
    return [*np.searchsorted(keys, np.array([i * width for i in range(parts)], np.uint64)).tolist(), len(keys)]


def chunk_tables(order: int, parts: int):
    """The n-grams of a chunk of documents with their counts, by hash range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, sizes = word_hashes(unpacked(pdf["pack"])["text"])
        rows = []
        for n, keys in enumerate(grams(hashes, sizes, order), 1):
            keys, counts = np.unique(keys[keys > 0], return_counts=True)
            edges = slices(keys, parts)
            for part, (a, b) in enumerate(zip(edges, edges[1:])):
                if b > a:
                    rows.append((part, int(pdf["chunk"].iloc[0]), n, squeezed_keys(keys[a:b]), squeezed(counts[a:b])))
        return pd.DataFrame(rows, columns=["part", "chunk", "n", "keys", "counts"])

    return run


def count_partition(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts over the rest of the corpus of one hash range of n-grams, for each chunk that has them."""
    out = []
    for n, rows in pdf.groupby("n"):
        keys = [unsqueezed_keys(k) for k in rows["keys"]]
        counts = np.concatenate([unsqueezed(c) for c in rows["counts"]]).astype(np.int64)
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        others = np.bincount(where, weights=counts).astype(np.int64)[where] - counts
        edges = np.cumsum([0, *map(len, keys)])
        out += [(c, n, p, squeezed(others[a:b])) for c, p, a, b in zip(rows["chunk"], rows["part"], edges[:-1], edges[1:])]
    return pd.DataFrame(out, columns=["chunk", "n", "part", "others"])


def runs(*keys: np.ndarray) -> np.ndarray:
    """Lengths of the runs of places where all keys are equal to those of the place before."""
    size = len(keys[0])
    begins = np.zeros(size, bool)
    begins[:1] = True
    for k in keys:
        begins[1:] |= k[1:] != k[:-1]
    return np.diff(np.append(np.flatnonzero(begins), size))


def looked_up(keys: np.ndarray, away: pd.DataFrame, parts: int, owner: np.ndarray | None = None) -> np.ndarray:
    """The count of each n-gram in the corpus, by hash range: how often the chunk has it, and the
    other chunks (rows part, others); 0 where there is no n-gram. With `owner`, the ascending number
    of each n-gram's document, that document's own n-grams are left out."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    edges = slices(ranked, parts)
    edges[0] = int((keys == 0).sum())
    total = np.zeros(len(keys), np.int64)
    for part, others in zip(away["part"], away["others"]):
        here = runs(ranked[edges[part] : edges[part + 1]])
        total[edges[part] : edges[part + 1]] = np.repeat(unsqueezed(others).astype(np.int64) + here, here)
    if owner is not None:
        own = runs(ranked, owner[order])
        total -= np.repeat(own, own)
        total[: edges[0]] = 0
    out = np.empty_like(total)
    out[order] = total
    return out


def score_chunk(order: int, least: int, parts: int, held_out: bool):
    """Joins the counts to the n-grams of a chunk's documents and sums scores by document."""

    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, counts = unpacked(packs["pack"].to_pylist()), answers.to_pandas()
        hashes, sizes = word_hashes(docs["text"])
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes) if held_out else None
        fell = np.ones(len(hashes), bool)
        score = context = None
        for n, keys in enumerate(grams(hashes, sizes, order), 1):
            count = looked_up(keys, counts[counts["n"] == n], parts, owner)
            log_count = np.log(np.maximum(count, 1))
            if n == 1:
                score = log_count.copy()
            else:
                found = (keys > 0) & (count >= least)
                score[(keys > 0) & ~found] += np.log(BACKOFF)
                context[1:] = log_count[1:] - context[:-1]
                np.copyto(score, context, where=found)
                fell &= ~found
            context = log_count
        some = sizes > 0
        n_unigram, part_score = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        first = (np.cumsum(sizes) - sizes)[some]
        n_unigram[some] = np.add.reduceat(fell, first, dtype=np.int64)
        part_score[some] = np.add.reduceat(score, first)
        return pa.table({"id": docs["id"], "n_tokens": sizes, "n_unigram": n_unigram, "part_score": part_score})

    return run


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, least: int = 1, held_out: bool = False) -> DataFrame:
    """(id, n_tokens, n_unigram, log_score, mean_log_score) for every row.

    Words are runs without ASCII white space. An n-gram's score is its count by that of its first
    n - 1 words; n-grams of two or more words that the corpus has fewer than `least` times are not
    in the tables and back off, by factor 0.4, to the shorter one; single words score by their share
    of all words. Counts cover all documents; n_unigram says how many words fell back to that.
    log_score is the sum of natural logarithms, mean_log_score that by word (null without words).
    With `held_out` a row is scored by the counts of all other rows: its own n-grams are taken off
    those of the corpus, so what only this row says backs off, and a word that no other row has
    counts as one. Otherwise a row is scored by counts that it is part of.
    A null text has no words. Rows that repeat count and are returned each; an empty table gives no
    rows; other columns are not read.

    Documents go to chunks by a hash of id and text, compressed. Each chunk sends its distinct n-grams with
    counts to the hash range they belong to, so a frequent n-gram counts once for each chunk; the
    ranges add up the counts and answer each chunk with those of all other chunks, which it adds to
    its own and joins to its documents' n-grams.
    N-grams are told apart by 64-bit hashes.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    parts = max(1, -(-size // PART))
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, -(-size // CHUNK)))).alias("chunk")
    chunks = source.select("id", "text", chunk).mapInArrow(packed, "chunk long, pack binary").groupBy("chunk")
    tables = chunks.applyInPandas(chunk_tables(order, parts), "part int, chunk long, n int, keys binary, counts binary")
    totals = tables.groupBy("part").applyInPandas(count_partition, "chunk long, n int, part int, others binary")
    schema = f"id {kind}, n_tokens long, n_unigram long, part_score double"
    sums = staged(chunks.cogroup(totals.groupBy("chunk")).applyInArrow(score_chunk(order, least, parts, held_out), schema))
    tokens = sums.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0]
    log_score = F.col("part_score") - F.col("n_unigram") * F.log(F.greatest(F.lit(float(tokens)) - (F.col("n_tokens") if held_out else 0), F.lit(1.0)))
    return sums.select(
        F.col("id").alias(id_col), "n_tokens", "n_unigram", log_score.alias("log_score"), F.when(F.col("n_tokens") > 0, log_score / F.col("n_tokens")).alias("mean_log_score")
    )
