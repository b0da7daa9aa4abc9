"""Repeated passages: found by anchors, located by sharded Aho-Corasick automata, removed."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Words of a window, and of an anchor inside it.
WINDOW, ANCHOR = 13, 6
#: Documents that share an anchor from which its windows are dealt out one by one.
HOT = 1000
#: Bytes of all removed spans up to which they are broadcast, and rows of texts that repeat as a
#: whole; beyond, they are joined by key.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 100_000
#: Distinct texts that an automaton is built from, about.
SHARD = 4000
#: Stands for no document: no id is larger.
NOBODY = np.iinfo(np.int64).max


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: bytes are split at exactly the six ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    size = max(len(hashes) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = mixed(out + hashes[k : k + size])
    return out


def anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window, the place of its anchor: the run of `anchor` words with the least hash,
    the leftmost among equals. So equal windows have equal anchors at equal places. Also the
    hashes of the runs of words."""
    grams = gram_hashes(hashes, anchor)
    runs = window - anchor + 1
    if len(grams) < runs:
        return np.zeros(0, np.int64), grams
    return np.lib.stride_tricks.sliding_window_view(grams, runs).argmin(1) + np.arange(len(grams) - runs + 1), grams


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def distinct_texts(source: DataFrame) -> DataFrame:
    """(key, first, last, n, salt) of each text: its smallest and largest id and its rows. An id and
    a salt name one text: the salt is 0 unless an id is the first of several texts."""
    texts = source.where("id is not null").groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    texts = staged(texts)
    several = texts.groupBy("first").agg(F.count("*").alias("texts")).where("texts > 1").select("first", F.lit(True).alias("several"))
    return staged(texts.join(several, "first", "left").select("key", "first", "last", "n", F.when(F.col("several"), F.xxhash64("key")).otherwise(0).alias("salt")))


def one_row_each(source: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, salt, text) of the first document of each text. Only texts with several rows move."""
    odd = texts.where("n > 1 or salt <> 0").select("key", "first", "salt")
    if odd.count() <= BROADCAST_ROWS:
        odd = F.broadcast(odd)
    marked = source.where("id is not null").join(odd, "key", "left")
    alone = marked.where("salt is null").select("id", F.lit(0).cast("long").alias("salt"), "text")
    return alone.union(marked.where("id = first").dropDuplicates(["key"]).select("id", "salt", "text"))


def anchor_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor long, id, salt) once for each anchor of a text's windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = []
            for text in batch["text"]:
                at, grams = anchors(word_hashes(words_of(text)), window, anchor)
                keys.append(signed(np.unique(grams[np.unique(at)]) if len(at) else grams[:0]))
            n = list(map(len, keys))
            yield pd.DataFrame({"anchor": np.concatenate(keys), "id": np.repeat(batch["id"].to_numpy(), n), "salt": np.repeat(batch["salt"].to_numpy(), n)})

    return docs.mapInPandas(run, "anchor long, id long, salt long")


def pieces(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(route, id, salt, start, text) from rows (id, salt, text, shared, hot): runs of consecutive windows
    with one shared anchor, or single windows where the anchor is hot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            routes, ids, salts, starts, texts = [], [], [], [], []
            for doc, salt, text, shared, hot in zip(batch["id"], batch["salt"], batch["text"], batch["shared"], batch["hot"]):
                words = words_of(text)
                hashes = word_hashes(words)
                at, grams = anchors(hashes, window, anchor)
                if not len(at):
                    continue
                keys = signed(grams)[at]
                known, is_hot = np.isin(keys, shared), np.isin(keys, hot)
                first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | is_hot[1:] | is_hot[:-1]]))
                last = np.append(first[1:], len(at)) - 1
                first, last = first[known[first]], last[known[first]]
                if not len(first):
                    continue
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                joined = b" ".join(words)
                begin = np.concatenate([[0], ends[:-1] + 1])[first].tolist()
                texts += [joined[i:j].decode("utf-8", "surrogatepass") for i, j in zip(begin, ends[last + window - 1].tolist())]
                if is_hot[first].any():
                    whole = signed(gram_hashes(hashes, window))
                    routes.append(np.where(is_hot[first], whole[first], keys[first]))
                else:
                    routes.append(keys[first])
                ids.append(np.full(len(first), doc, np.int64))
                salts.append(np.full(len(first), salt, np.int64))
                starts.append(first.astype(np.int32))
            none = np.zeros(0, np.int64)
            yield pd.DataFrame({"route": np.concatenate([none, *routes]), "id": np.concatenate([none, *ids]), "salt": np.concatenate([none, *salts]), "start": np.concatenate([none, *starts]).astype(np.int32), "text": texts})

    return docs.mapInPandas(run, "route long, id long, salt long, start int, text string")


def recurring(codes: np.ndarray, places: np.ndarray, copied: np.ndarray, window: int) -> set[tuple[int, ...]]:
    """Windows that two documents can have: of those that begin at `places`, the ones whose hash
    comes twice and the ones in a text that is `copied`."""
    if not len(places):
        return set()
    _, inverse, counts = np.unique(gram_hashes(codes.astype(np.uint64), window)[places], return_inverse=True, return_counts=True)
    words = codes.tolist()
    return {tuple(words[i : i + window]) for i in places[(counts[inverse] > 1) | copied].tolist()}


def owners(window: int):
    """For the distinct texts of a shard with their first documents: of each window, the first
    document that has it, or NOBODY where no other document can.

    Windows that recur by hash are compiled to an automaton. The texts of the shard are streamed
    through it, one behind the other: what it finds, by the words themselves, gives each window's
    first document and every place.
    """

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        ids: dict[str, int] = {}
        texts = [t.split(" ") for t in shard["text"]]
        codes: list[int] = []
        for words in texts:
            codes += [ids.setdefault(w, len(ids) + 1) for w in words]
            codes.append(0)  # ends a text; no window has it
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        windows = np.maximum(sizes - window + 1, 0)
        places = np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        first, last = shard["first"].to_numpy(np.int64), shard["last"].to_numpy(np.int64)
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, passage in enumerate(recurring(np.array(codes, np.int64), places, np.repeat(last > first, windows), window)):
            machine.add_word(passage, i)
        own = np.full(len(codes), NOBODY)
        if len(machine):
            machine.make_automaton()
            ends, found = np.array(list(machine.iter(tuple(codes))), np.int64).T
            least = np.full(len(machine), NOBODY)
            np.minimum.at(least, found, np.repeat(first, sizes + 1)[ends])
            own[ends - window + 1] = least[found]
        return pd.DataFrame({"key": shard["key"], "owners": [own[a : a + n] for a, n in zip(starts.tolist(), windows.tolist())]})

    return run


def merged_spans(window: int):
    """From rows (id, salt, starts): the words that windows at these places cover, as bounds
    [begin, end, begin, end, ...] of disjoint spans in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bounds = []
            for starts in batch["starts"]:
                at = np.unique(np.asarray(starts, np.int64))
                new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + window]))
                ends = np.append(at[new[1:] - 1], at[-1]) + window
                bounds.append(np.stack([at[new], ends], 1).ravel().astype(np.int32))
            yield pd.DataFrame({"id": batch["id"], "salt": batch["salt"], "bounds": bounds})

    return run


def repeated_windows(source: DataFrame, texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, salt, bounds array<int>): of the first document of each text, the spans of words covered
    by windows that also start in a document with a smaller id.

    `source` has id, key and text, `texts` is distinct_texts() of it. Equal windows have equal
    anchors, so only windows with an anchor in two texts can repeat; their texts go to shards by
    anchor, those of hot anchors by the window itself, each distinct piece once. A shard compiles
    the windows that recur and locates all of them by automaton.
    """
    alone = one_row_each(source, texts)
    rows = staged(anchor_rows(alone, window, anchor))
    shared = rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")  # a text has an anchor once
    by_doc = (
        rows.join(shared.select("anchor", (F.col("n") > HOT).alias("hot")), "anchor")
        .groupBy("id", "salt")
        .agg(F.collect_list("anchor").alias("shared"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    )
    found = staged(pieces(alone.join(by_doc, ["id", "salt"]).select("id", "salt", "text", "shared", "hot"), window, anchor))
    discard(rows)
    keyed = found.withColumn("key", F.unhex(F.md5(F.concat(F.col("route").cast("string"), F.lit(":"), "text"))))
    # A piece of one document can still share windows with others of its route.
    parts = keyed.groupBy("key", "route").agg(F.first("text").alias("text"), F.min("id").alias("first"), F.max("id").alias("last"))
    shards = max(1, -(-found.count() // SHARD))
    located = (
        parts.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
        .select("shard", "key", "text", "first", "last")
        .groupBy("shard")
        .applyInPandas(owners(window), "key binary, owners array<long>")
    )
    hits = keyed.select("key", "id", "salt", "start").join(located, "key")
    later = F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("id"), F.col("start") + i)), lambda x: x.isNotNull())
    starts = hits.select("id", "salt", later.alias("starts")).where(F.size("starts") > 0).groupBy("id", "salt").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    spans = staged(starts.mapInPandas(merged_spans(window), "id long, salt long, bounds array<int>"))
    discard(found)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every document without the words of windows that also start in a document with a smaller id.

    Words are runs without ASCII white space, unchanged; windows are judged on the input. Null
    texts and texts shorter than a window keep all their words. Each row is judged by its own id
    and text: rows that share an id but not the text are different documents, rows that repeat are
    returned each. A null id is not smaller than any other and none is smaller than it. An empty
    table gives an empty result; other columns are not read. Returns id, n_words, n_removed and
    kept, the words left joined by one space.
    """
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("key"), text.alias("text"))
    texts = distinct_texts(source)
    spans = repeated_windows(source, texts, window)
    named = texts.select("key", "first", "salt").join(spans.withColumnRenamed("id", "first"), ["first", "salt"]).select("key", "first", "bounds")
    copied = texts.where("last > first").select("key", F.col("first").alias("of"))
    gone = staged(copied.join(named, "key", "full").select("key", F.coalesce("of", "first").alias("first"), "bounds"))
    bytes_ = gone.agg(F.coalesce(F.sum(F.size(F.coalesce("bounds", F.array().cast("array<int>"))) * 4 + 64), F.lit(0))).head()[0]
    if bytes_ <= BROADCAST_BYTES:
        gone = F.broadcast(gone)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, bounds, whole in zip(batch["text"], batch["bounds"], batch["whole"]):
                words = words_of(text)
                n, left = len(words), words
                if whole is True:
                    left = words if n < window else []
                elif whole is False and bounds is not None and len(bounds):
                    edges = [0, *bounds.tolist(), n]
                    left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                sizes.append(n)
                removed.append(n - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"id": batch["id"], "n_words": sizes, "n_removed": removed, "kept": kept})

    marked = source.join(gone, "key", "left").select("id", "text", "bounds", (F.col("id") > F.col("first")).alias("whole"))
    return marked.mapInPandas(run, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
