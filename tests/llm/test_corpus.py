"""Operators on documents against plain restatements of their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from textweir.llm import bpe, mixing, ngrams, passages, pii, quality, sharding, simhash
from textweir.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda t: WORD.findall(t or "")


# Sharding


def by_group(texts):
    sizes = Counter()
    for t in texts:
        sizes[t] += len((t or "").encode()) + 1
    return sizes


def plain_capacity(sizes, shards):
    """The least largest sum of contiguous parts, by dynamic programming over all last cuts."""
    upto = [0]
    for x in sizes:
        upto.append(upto[-1] + x)
    best = upto[:]
    for _ in range(shards - 1):
        best = [min([max(best[j], upto[i] - upto[j]) for j in range(i)], default=0) for i in range(len(upto))]
    return best[-1]


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding(spark, docs, clashing, nothing, texts, shards):
    rows = sharding.minimax_shards(clashing, shards=shards, cells=4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(range(len(texts)))
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    place = defaultdict(set)
    for r in rows:
        place[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in place.values())
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    # The largest shard is as small as contiguous ranges of keys allow.
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.key] += r["size"]
    ordered = [sizes[k] for k in sorted(sizes)]
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert max(load.values()) == plain_capacity(ordered, shards)
    assert sharding.minimax_shards(nothing).count() == 0


def test_cuts_are_minimal(spark):
    import random

    rng = random.Random(3)
    keys = sorted({rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(900)} | {-(1 << 63), (1 << 63) - 1})
    sizes = [rng.randint(1, 100) for _ in keys]
    sizes[450] = 6_000
    df = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
    for shards in (4, 16):
        cuts = sharding.cut_keys(df, shards)
        load = Counter()
        for k, s in zip(keys, sizes):
            load[sum(k >= c for c in cuts)] += s
        assert len(cuts) < shards and max(load.values()) == plain_capacity(sizes, shards)


# Language model


@pytest.mark.parametrize("order,least,held_out", [(2, 2, False), (3, 2, False), (3, 1, True), (2, 3, True)])
def test_stupid_backoff(spark, clashing, nothing, texts, monkeypatch, order, least, held_out):
    monkeypatch.setattr(ngrams, "CHUNK", 20_000)
    monkeypatch.setattr(ngrams, "PART", 9_000)

    def grams(w, n):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    counts = [None, *(sum((grams(words(t), n) for t in texts), Counter()) for n in range(1, order + 1))]
    fell = 0
    for r in ngrams.stupid_backoff(clashing, order=order, least=least, held_out=held_out).collect():
        w = words(texts[r.doc_id])
        own = [None, *(grams(w, n) if held_out else Counter() for n in range(1, order + 1))]
        total = sum(counts[1].values()) - sum(own[1].values())
        unigrams = 0

        def seen(gram):
            return counts[len(gram)][gram] - own[len(gram)][gram]

        expected = 0.0
        for i in range(len(w)):
            n = min(order, i + 1)
            while n > 1 and seen(tuple(w[i - n + 1 : i + 1])) < least:
                expected += math.log(0.4)
                n -= 1
            gram = tuple(w[i - n + 1 : i + 1])
            unigrams += n == 1
            expected += math.log(seen(gram) / seen(gram[:-1])) if n > 1 else math.log(max(seen(gram), 1) / total)
        fell += unigrams > 1
        assert (r.n_tokens, r.n_unigram) == (len(w), unigrams) and r.log_score == pytest.approx(expected, abs=1e-6)
    assert fell
    assert ngrams.stupid_backoff(nothing, held_out=held_out).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def confirmed(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and doubled % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if confirmed(k, m.group()))


def test_personal_data(spark, nothing):
    import random

    rng = random.Random(3)
    parts = ["a@b.c", "x.@y..z", "%._a@b-c.d.e", "..", "@", ".", "é", "😀", "1.2.3.4", "256.1.1.1", ".5.6", "000255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "  -", "+1 (555) 123-4567", "+", "12345678", "(", ")", " ", "a", "-", "b.c@", "DE89 3704 0044 0532 0130 00", "ssn 123-45-6789 ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None, "", "1 " * 5000, "a." * 20000, "1" * 20000, "a@b" + ".c" * 9000, "a" * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit("clash")).repartition(4)
    for r in pii.find_pii(df).select("doc_id", pii.listed(pii.BASE_KINDS, F.col("pii")).alias("b"), pii.listed(pii.KINDS, F.col("pii")).alias("all")).collect():
        assert r.b == base_spans(texts[r.doc_id])
        assert set(filter(None, r.b.split(","))) <= set(r["all"].split(","))
    masked = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    assert len(masked) == len(texts) and masked[1500] is None and masked[1501] == ""
    assert pii.find_pii(nothing).count() == 0


def test_context_and_masks(spark):
    texts = ["my ssn 123-45-6789", "part 123-45-6789", "pay DE89 3704 0044 0532 0130 00", "pay DE88 3704 0044 0532 0130 00", "mail a@b.c or +1 555 123 4567."]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    assert [r.text for r in pii.mask_pii(df).orderBy("i").collect()] == ["my ssn [SSN]", "part 123-45-6789", "pay [IBAN]", "pay DE88 3704 0044 0532 0130 00", "mail [EMAIL] or [PHONE]."]
    scores = [r[0] for r in pii.find_pii(df).where("i = 4").select(F.col("pii.email")[0]["score"]).collect()]
    assert scores == [1.0]  # 0.7 and a context word


# Quality


def rules(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("few", [0, 12])
def test_quality_rules(spark, clashing, nothing, texts, few, monkeypatch):
    monkeypatch.setattr(quality, "FEW", few)
    for r in quality.rule_counts(clashing).collect():
        expected = rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
    assert quality.rule_counts(nothing).count() == 0


def test_ratio_tells_junk_apart(spark):
    """Held-out documents: trained on some labels, right on the others."""
    import random

    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "of", "house", "sea", "green", "walks"]) for _ in range(80)) for _ in range(60)]
    junk = [" ".join(f"{rng.randint(0, 99999)}%" for _ in range(80)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, None, None), (60, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, quality.trusted_ids(labels)).collect()}
    assert not any(got[i].kept for i in range(60, 90))
    assert all(got[i].ratio > max(got[j].ratio for j in range(60, 90)) for i in range(30, 60))
    assert quality.trusted_ids(labels, limit=7).count() == 7
    empty = quality.judge(docs.where("false"), quality.trusted_ids(labels))
    assert empty.count() == 0
    alone = quality.judge(docs, quality.trusted_ids(labels.where("false")))
    assert alone.where("ratio is null").count() == 0


# Near-duplicates


def print_of(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(values, near):
    leader = {k: k for k in values}

    def top(x):
        while leader[x] != x:
            x = leader[x]
        return x

    keys = sorted(values)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(values[a], values[b]):
                x, y = top(a), top(b)
                leader[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_simhash(spark, clashing, nothing, texts):
    prints = {i: print_of(t) for i, t in enumerate(texts)}
    expected = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    rows = simhash.near_duplicates(clashing).select("doc_id", simhash.hex16(F.col("fp")).alias("h"), "component_id").collect()
    assert {r.doc_id: (r.h, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("tree,distinct", [(4096, 0), (5, 0), (5, 50_000_000_000)])
def test_bk_trees(spark, tree, distinct, monkeypatch):
    import random

    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(20):
            x = base
            for _ in range(rng.randint(0, 9)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in values}
    if distinct:
        real = simhash.routes
        monkeypatch.setattr(simhash, "routes", lambda radius, n: real(radius, distinct))
    links = simhash.hamming_links(spark.createDataFrame([(k,) for k in signed], "fp long"), 4, tree)
    got = {r.node: r.root for r in components(links).collect()}
    expected = classes(signed, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {k: got.get(k, k) for k in signed} == expected


# Mixing


def test_mixing(spark, docs, clashing, nothing, texts):
    weights = {"domain": {"domain0": 3.0}, "lang": {"en": 2.0}, "source": {"src1": 5.0}}
    rows = {r.doc_id: r for r in docs.collect()}
    leaf = defaultdict(list)
    for i, r in rows.items():
        number = re.search("[0-9]+", r.source or "")
        leaf[(f"domain{int(number[0]) % 4 if number else 0}", r.lang or "", r.source or "")].append((i, max(1, len(words(r.text)))))
    held = {k: sum(n for _, n in v) for k, v in leaf.items()}
    budgets = {}

    def share(prefix, budget):
        level = len(prefix)
        if level == 3:
            budgets[prefix] = budget
            return
        kids = sorted({k[level] for k in held if k[:level] == prefix})
        room = {c: 2 * sum(n for k, n in held.items() if k[: level + 1] == (*prefix, c)) for c in kids}
        weight = {c: weights[mixing.LEVELS[level]].get(c, 1.0) for c in kids}
        got, open_, left = {}, set(kids), budget
        while open_:
            rate = left / sum(weight[c] for c in open_)
            full = [c for c in open_ if room[c] <= rate * weight[c]]
            if not full:
                got |= {c: rate * weight[c] for c in open_}
                break
            for c in full:
                got[c] = room[c]
                left -= room[c]
                open_.discard(c)
        for c in kids:
            share((*prefix, c), got[c])

    share((), int(sum(held.values()) * 0.9))
    expected = {}
    for k, members in leaf.items():
        whole, rest = divmod(int(budgets[k] + 1e-6), held[k])
        upto, inside = 0, True
        for i, n in sorted(members, key=lambda m: (hashlib.md5(f"7:{whole}:{m[0]}".encode()).hexdigest(), m[0])):
            upto += n
            inside = inside and upto <= rest
            if whole + inside:
                expected[i] = whole + inside
    got = {r.doc_id: r.copies for r in mixing.mix(clashing, 0.9, weights).collect()}
    assert got == expected
    assert mixing.mix(nothing, 0.9, weights).count() == 0


# Passages


@pytest.mark.parametrize("hot,limit", [(1000, 1 << 25), (3, 0)])
def test_passages(spark, clashing, nothing, texts, hot, limit, monkeypatch):
    monkeypatch.setattr(passages, "HOT", hot)
    monkeypatch.setattr(passages, "SHARD", 40)
    monkeypatch.setattr(passages, "BROADCAST_BYTES", limit)
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in passages.remove_repeats(clashing).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        assert got[i] == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert passages.remove_repeats(nothing).count() == 0


# Tokens


def test_bpe(spark, clashing, nothing, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    official = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    encoded = bpe.bpe_encode(clashing, path)
    for r in encoded.collect():
        expected = official.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == expected
        data = (texts[r.doc_id] or "").encode()
        assert [data[a:b] for a, b in zip(r.offsets, [*r.offsets[1:], len(data)])] == [official.decode_single_token_bytes(i) for i in expected]
    assert {r.doc_id: bytes(r.decoded) for r in bpe.bpe_decode(encoded, path).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.bpe_digests(clashing, path).collect():
        ids, data = official.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(data).hexdigest())
    assert bpe.bpe_digests(nothing, path).count() == 0


def test_pieces_against_the_library():
    import random

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    official = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = "ab'strevlmd  \n\t 1２9é#!€日  \x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["a" * 3000, "", "'s's", "x'", " 'll"]
    got = bpe.encode_texts(texts, bpe.Pieces(ranks))
    assert [x.tolist() for x in got] == official.encode_ordinary_batch(texts)


# The pipeline


def test_pipeline(spark, tmp_path):
    """Stage by stage on the smallest given tables: decisions take effect, columns stay."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = {}
    for name, function in cp.STAGES:
        docs = cp.staged(function(spark, docs, sf))
        stage[name] = {}
        if name != "tokens":
            assert docs.columns == cp.COLUMNS
        for r in docs.collect():
            stage[name].setdefault(r.doc_id, []).append(r)
    good = stage["quality"]
    assert all(not (lambda m: m[0] < 50 or 100 * m[4] > 50 * m[0])(rules(rows[0].text)) for rows in good.values())
    from .test_whole_jobs import joined_by_jaccard

    assert set(stage["near_dedup"]) == set(joined_by_jaccard({i: rows[0].text for i, rows in good.items()}).values())
    assert set(stage["pii"]) == set(stage["near_dedup"])
    assert all(base_spans(rows[0].text) == "" and rows[0].n_chars == len(rows[0].text) for rows in stage["pii"].values())
    assert set(stage["mixing"]) <= set(stage["pii"]) and all(len(rows) in (1, 2) for rows in stage["mixing"].values())
    assert {i: len(rows) for i, rows in stage["tokens"].items()} == {i: len(rows) for i, rows in stage["mixing"].items()}
    for i, rows in stage["tokens"].items():
        assert rows[0].decoded_sha256 == hashlib.sha256(stage["mixing"][i][0].text.encode()).hexdigest()


def test_pipeline_stages_on_edge_cases(spark, docs, clashing, nothing, tmp_path):
    """Nulls, repeated rows, null ids and clashing columns in every stage; empty tables."""
    import corpus_pipeline as cp

    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = clashing.unionByName(clashing.where("doc_id in (1, 20, 21)")).unionByName(clashing.where("doc_id in (22, 23)").withColumn("doc_id", F.lit(None).cast("long")))
    rows = odd.count()
    for name, function in cp.STAGES:
        out = function(spark, odd, str(tmp_path))
        assert function(spark, nothing, str(tmp_path)).count() == 0
        if name == "tokens":
            assert out.count() == rows
            continue
        assert out.columns == cp.COLUMNS
        found = [r.doc_id for r in out.collect()]
        if name == "pii":
            assert len(found) == rows
        if name == "near_dedup":
            assert sum(i is None for i in found) == 2 and len(found) == len(set(found)) + 1


@pytest.mark.parametrize("parts", [1, 7])
def test_counts_by_hash_range(parts):
    rng = np.random.default_rng(parts)
    keys = ngrams.mixed(rng.integers(1, 200, 3000).astype(np.uint64)) | np.uint64(1)
    keys[rng.random(3000) < 0.1] = 0
    distinct = np.unique(keys[keys > 0])
    elsewhere = rng.integers(0, 400, len(distinct))
    edges = ngrams.slices(distinct, parts)
    rows = [(p, ngrams.squeezed(elsewhere[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    away = pd.DataFrame(rows, columns=["part", "others"]).sample(frac=1, random_state=1)
    known, own = dict(zip(distinct.tolist(), elsewhere.tolist())), Counter(keys.tolist())
    expected = [known[k] + own[k] if k else 0 for k in keys.tolist()]
    assert ngrams.looked_up(keys, away, parts).tolist() == expected
    assert (ngrams.unsqueezed_keys(ngrams.squeezed_keys(distinct)) == distinct).all()
    assert len(ngrams.looked_up(keys[:0], away[:0], parts)) == 0
