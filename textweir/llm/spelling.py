"""Spelling variants: blocked Gram matrices of letter counts, then exact single edits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: The letters of words, dealt to groups of about equal weight by how common they are.
ALPHABET = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
GROUPS = 5
#: One edit changes the counts of two letters at most, so of two groups: three groups agree.
COMBINATIONS = list(combinations(range(GROUPS), GROUPS - 2))
#: Most rows of a tile (a pair of tiles is one product) and of small blocks that share a product,
#: and the most letters of either.
TILE, SHARED, LETTERS = 2048, 256, 4_000_000

IN_GROUPS = [ALPHABET[g::GROUPS] for g in range(GROUPS)]
#: Column of the count matrix for each byte of Latin-1; columns of a group stand together.
COLUMN = np.full(256, 255, np.uint8)
for _i, _letter in enumerate("".join(IN_GROUPS)):
    COLUMN[ord(_letter)] = _i
FIRSTS = np.cumsum([0, *map(len, IN_GROUPS[:-1])])
#: For each set of agreeing groups (as bits), the first combination that all of them make.
FIRST_COMBINATION = np.array([next((i for i, c in enumerate(COMBINATIONS) if all(bits >> g & 1 for g in c)), -1) for bits in range(1 << GROUPS)])


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least: int = 2, damaged: int = 31) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, of at least `least_length` code points and
    `least` occurrences over all texts.

    A run of a document whose crc32 with the document's id is divisible by `damaged` loses one
    letter, as a slip of the pen would. Null texts have no words; a null id counts as an empty one;
    every occurrence counts, also in repeated rows; other columns are not read.
    """
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # A run that is too short stays too short when it loses a letter.
    found = F.regexp_extract_all(lower, F.lit(rf"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % damaged == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def block_keys(word: Column) -> Column:
    """array<struct<combination, key>>: hashes of the letters of a word in three of the groups,
    whatever their order."""
    letters = F.array_join(F.sort_array(F.split(word, "")), "")
    keys = []
    for i, groups in enumerate(COMBINATIONS):
        others = "".join(letters_ for g, letters_ in enumerate(IN_GROUPS) if g not in groups)
        keys.append(F.struct(F.lit(i).cast("tinyint").alias("combination"), F.xxhash64(F.lit(i), F.translate(letters, others, "")).alias("key")))
    return F.array(*keys)


def blocks(words: DataFrame) -> DataFrame:
    """(key, a, b, tile, combination, code, n): every word in its ten blocks; a block of many words
    is cut to tiles, and each pair of tiles (a <= b) becomes a block of its own."""
    rows = words.select("word", "n", F.inline(block_keys(F.col("word"))))
    size = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.length("word")) / LETTERS)).cast("int")
    large = staged(rows.groupBy("key").agg(size.alias("tiles")).where("tiles > 1"))
    tile = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    dealt = rows.join(large, "key", "left").withColumn("tile", F.coalesce(tile, F.lit(0)))
    others = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles") - 1, F.lit(0))))
    pairs = dealt.withColumn("other", others)
    return pairs.select("key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "combination", F.encode("word", "ISO-8859-1").alias("code"), "n")


class Block(NamedTuple):
    """Words of whole blocks: number of the block, the word in Latin-1, its length and count, its
    tile, whether the block is a pair of different tiles, and its combination."""

    group: np.ndarray
    code: np.ndarray
    length: np.ndarray
    n: np.ndarray
    tile: np.ndarray
    crossing: np.ndarray
    combination: np.ndarray

    def at(self, index: np.ndarray | slice) -> Block:
        return Block(*(column[index] for column in self))


def joined(blocks_: list[Block]) -> Block:
    return blocks_[0] if len(blocks_) == 1 else Block(*map(np.concatenate, zip(*blocks_)))


def one_edit(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j, j as long as i or longer by one, differ by one replaced or inserted
    letter. `letters` holds all words one after the other."""
    out = np.zeros(len(i), bool)
    cuts = np.searchsorted(np.cumsum(lengths[i]), np.arange(LETTERS, lengths[i].sum(), LETTERS)) + 1
    for part in np.split(np.arange(len(i)), cuts):
        if not len(part):
            continue
        size = lengths[i[part]]
        first = np.cumsum(size) - size
        k = np.arange(size.sum()) - np.repeat(first, size)
        mine = letters[np.repeat(starts[i[part]], size) + k]
        theirs = np.repeat(starts[j[part]], size) + k
        wrong, longer = mine != letters[theirs], lengths[j[part]] > size
        shifted = mine != letters[np.minimum(theirs + 1, len(letters) - 1)]
        ahead = np.minimum.reduceat(np.where(wrong, k, np.repeat(size, size)), first)
        behind = np.maximum.reduceat(np.where(shifted, k, -1), first)
        out[part] = np.where(longer, behind < ahead, np.add.reduceat(wrong, first, dtype=np.int64) == 1)
    return out


def near_in(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of near words within blocks whose rows are ordered by length.

    The Gram matrix of the letter counts of some rows and all those up to the next length gives
    squared distances; pairs at 2 (equal lengths) or 1 (adjacent ones) are verified. A pair counts
    only where its combination is the first that both words share.
    """
    lengths, width = block.length, len(ALPHABET)
    letters = np.frombuffer(b"".join(block.code), np.uint8)
    starts = np.cumsum(lengths) - lengths
    rows = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(rows * width + COLUMN[letters], minlength=len(lengths) * width).reshape(-1, width)
    # Both kinds hold these sums exactly.
    exact = counts.astype(np.float32 if lengths[-1] < 2000 else np.float64)
    squares = (exact * exact).sum(1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(lengths), SHARED):
        e = min(s + SHARED, len(lengths))
        u = np.searchsorted(lengths, lengths[e - 1] + 1, "right")
        distance = squares[s:e, None] + squares[None, s:u] - 2 * (exact[s:e] @ exact[s:u].T)
        i, j = np.nonzero((distance > 0.5) & (distance < 2.5) & (block.group[s:e, None] == block.group[None, s:u]))
        i, j = i + s, j + s
        ok = (i < j) & (lengths[j] - lengths[i] < 2) & (~block.crossing[i] | (block.tile[i] != block.tile[j]))
        i, j = i[ok], j[ok]
        ok = one_edit(letters, starts, lengths, i, j)
        i, j = i[ok], j[ok]
        agree = ~np.logical_or.reduceat(counts[i] != counts[j], FIRSTS, 1) @ (1 << np.arange(GROUPS))
        ok = FIRST_COMBINATION[agree] == block.combination[i]
        found.append((i[ok], j[ok]))
    return tuple(np.concatenate(side) for side in zip(*found))


def summed(block: Block) -> pd.DataFrame:
    """(code, n_near, form_n, form): for each word with near words in these blocks their number and
    the most frequent one, ties to the smaller. A word in several blocks comes several times."""
    block = block.at(np.argsort(block.length, kind="stable"))
    i, j = near_in(block)
    word, other = np.r_[i, j], np.r_[j, i]
    n, code = block.n, block.code
    order = np.array(sorted(range(len(n)), key=lambda x: (-n[x], code[x])))
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    best = np.full(len(n), len(n))
    np.minimum.at(best, word, rank[other])
    has = np.flatnonzero(best < len(n))
    form = order[best[has]]
    return pd.DataFrame({"code": code[has], "n_near": np.bincount(word, minlength=len(n))[has], "form_n": n[form], "form": code[form]})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of words (word, n) of the letters a-z and U+00C0 to U+00FF that
    are one edit away from others: how many those are, and the most frequent of them.

    Blocks stream through sorted partitions; a task holds one pair of tiles.
    """
    ordered = blocks(words).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_blocks(batches):
            yield summed(block)

    found = ordered.mapInPandas(run, "code binary, n_near long, form_n long, form binary")
    plain = lambda c: F.decode(c, "ISO-8859-1")
    rows = found.select(plain("code").alias("word"), "n_near", F.struct((-F.col("form_n")).alias("less"), plain("form").alias("form")).alias("best"))
    # Code points of Latin-1 letters order as their UTF-8 bytes do.
    best = rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[Block]:
    """Cuts batches at the ends of blocks, so that each part holds whole ones; small blocks come
    together, up to SHARED rows, and blocks of one word, which have no pairs, not at all."""
    tail: list[Block] = []
    last, number = None, 0
    for batch in batches:
        keys = batch[["key", "a", "b"]].to_numpy()
        new = np.r_[last is None or bool((keys[0] != last).any()), (keys[1:] != keys[:-1]).any(1)]
        code = batch["code"].to_numpy()
        group, length = number + np.cumsum(new), np.fromiter(map(len, code), np.int64, len(code))
        rows = Block(group, code, length, *(batch[c].to_numpy() for c in ("n", "tile")), (batch["a"] != batch["b"]).to_numpy(), batch["combination"].to_numpy())
        number, last = int(group[-1]), keys[-1]
        cut = np.flatnonzero(new)
        if not len(cut):
            tail.append(rows)
            continue
        yield from shares(joined([*tail, rows.at(slice(0, cut[-1]))]))
        tail = [rows.at(slice(cut[-1], None))]
    if tail:
        yield from shares(joined(tail))


def shares(rows: Block) -> Iterator[Block]:
    if not len(rows.group):
        return
    new = rows.group[1:] != rows.group[:-1]
    rows = rows.at(~(np.r_[True, new] & np.r_[new, True]))
    starts = np.flatnonzero(np.r_[True, rows.group[1:] != rows.group[:-1]][: len(rows.group)])
    ends = np.r_[starts[1:], len(rows.group)]
    letters = np.r_[0, np.cumsum(rows.length)]
    begin = 0
    for start, end in zip(starts, ends):
        if start > begin and (end - begin > SHARED or letters[end] - letters[begin] > LETTERS):
            yield rows.at(slice(begin, start))
            begin = start
    if begin < len(rows.group):
        yield rows.at(slice(begin, None))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of counted_words().

    The form of a word is the most frequent word one edit away (ties: the smallest), if it is at
    least `times` as frequent; the root is where forms lead, the word itself without one. Texts
    of any length are read whole; an empty table has no words.
    """
    words = staged(counted_words(docs, id_col, text_col))
    both = words.join(near_words(words), "word", "left")
    enough = F.col("form_n") >= times * F.col("n")
    formed = staged(
        both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    )
    discard(words)
    roots = followed(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def followed(links: DataFrame) -> DataFrame:
    """(word, root) where links (word, root) lead in the end. Each round doubles the steps; counts
    grow tenfold with a step, so a few rounds do."""
    links = staged(links)
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("up"))
        stepped = staged(links.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        discard(links)
        links = stepped
        if links.where("moved").limit(1).count() == 0:
            return links.select("word", "root")
