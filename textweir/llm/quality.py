"""Quality rules and a log-likelihood ratio of hashed n-grams, with DataFrame functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweir.functions.names import fresh

from .common import staged, words

#: Buckets of hashed n-grams, and added counts.
BUCKETS, ADDED = 16_384, 1.0
#: Trusted ids up to which they are broadcast.
BROADCAST = 1_000_000
#: Repeated windows up to which they are looked up one by one.
FEW = 12
SYMBOLS = r"[^#*$%&|<>]+"


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def following(hashes: Column, n: int) -> Column:
    """Hashes of the windows of n words, in order, from the hashes of words."""
    size = F.size(hashes)
    out = hashes
    for k in range(1, n):
        shifted = F.slice(hashes, F.lit(k + 1), F.greatest(size - k, F.lit(0)))
        out = F.zip_with(F.slice(out, F.lit(1), F.greatest(size - k, F.lit(0))), shifted, lambda a, b: F.xxhash64(a, b))
    return out


def bucket(h: Column) -> Column:
    return (F.pmod(h, F.lit(BUCKETS)) + 1).cast("int")


def buckets(hashes: Column) -> Column:
    """Buckets (from 1) of the words and word pairs of a document."""
    return F.concat(F.transform(hashes, bucket), F.transform(following(hashes, 2), bucket))


def bucket_rows(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """buckets() as rows (`keep`, bucket), made by generated code instead of functions on arrays."""
    listed = docs.select(*[F.col(c) for c in keep], words(F.col(text_col)).alias("listed"))
    zipped = F.arrays_zip(F.col("listed").alias("word"), F.slice("listed", F.lit(2), F.size("listed")).alias("next"))
    single = F.xxhash64("word")
    pair = F.when(F.col("next").isNotNull(), bucket(F.xxhash64(single, F.xxhash64("next"))))
    rows = listed.select(*keep, F.inline(zipped).alias("word", "next")).select(*keep, bucket(single).alias("single"), pair.alias("pair"))
    return rows.select(*keep, F.explode(F.array("single", "pair")).alias("bucket")).where("bucket is not null")


def repeated_places(placed: str) -> Column:
    """Places of the windows that occur at least twice, in order, from the sorted column `placed`
    of (hash, place), where equal windows stand together."""
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), placed)
    after = F.slice(placed, F.lit(2), F.size(placed))
    near = F.zip_with(before, after, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
    return F.sort_array(F.array_compact(F.zip_with(placed, near, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"]))))


#: Columns that the rules add.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def rule_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are runs without ASCII white space. Windows of three words are compared by a 64-bit
    hash. A null text has no words, so it fails; equal rows are treated alike. Added columns
    replace input columns of these names.
    """
    df, hashes = counted(docs, text_col)
    return df.drop(hashes)


def counted(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """rule_counts() with one more column, of the hashes of words, and its name."""
    words_, lines_, hashes_, windows_, sorted_, twice_, placed_, again_ = fresh(docs, "_words", "_lines", "_hashes", "_windows", "_sorted", "_twice", "_placed", "_again")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({words_: words(text), lines_: lines})
    df = df.withColumn(hashes_, F.transform(words_, lambda w: F.xxhash64(w)))
    df = df.withColumn(windows_, following(F.col(hashes_), 3))
    df = df.withColumn(sorted_, F.sort_array(windows_))
    same = F.zip_with(sorted_, F.slice(sorted_, F.lit(2), F.size(sorted_)), lambda a, b: F.when(a == b, a))
    df = df.withColumn(twice_, F.array_distinct(F.array_compact(same)))
    # Most texts repeat few windows, which a look-up finds faster than a sort of all.
    few = F.array_compact(F.transform(windows_, lambda h, i: F.when(F.array_contains(twice_, h), i)))
    several = F.size(twice_) > 0
    placed = F.sort_array(F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(placed_, F.when(F.size(twice_) > FEW, placed))
    df = df.withColumn(again_, F.when(F.size(twice_) > FEW, repeated_places(placed_)).when(several, few))
    again = F.col(again_)
    gaps = F.zip_with(F.slice(again, F.lit(2), F.size(again) - 1), F.slice(again, F.lit(1), F.size(again) - 1), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(3), lambda a, x: a + x)
    n_words = F.size(words_).cast("long")
    repeat = F.when(several, covered).otherwise(0).cast("long")
    values = (
        n_words,
        F.length(F.array_join(words_, "")).cast("long"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"),
        repeat,
        (n_words < 50) | (repeat * 100 > n_words * 50),
    )
    return df.withColumns(dict(zip(COUNTS, values, strict=True))).drop(words_, lines_, windows_, sorted_, twice_, placed_, again_), hashes_


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", limit: int | None = None) -> DataFrame:
    """Ids of all rows labelled good; with a limit, of the `limit` with the smallest hashes."""
    good = labels.where("quality = 1").select(id_col).distinct()
    return good if limit is None else good.orderBy(F.xxhash64(id_col), id_col).limit(limit)


def listed(values: list[float]) -> Column:
    """A table of doubles as one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def ratio_table(docs: DataFrame, text_col: str = "text", mark: str = "_good") -> tuple[list[float], list[float]]:
    """Of each bucket the log-likelihood ratio, trusted against raw, and the trusted count.

    The raw multinomial counts all n-grams of all documents, the trusted one those of all documents
    where the column `mark` is 1. Both are BUCKETS numbers, so only these reach the driver.
    Without trusted n-grams all ratios are 0.
    """
    parts = bucket_rows(docs.select(F.coalesce(mark, F.lit(0)).alias("good"), F.col(text_col).alias("text")), "text", "good")
    rows = parts.groupBy("bucket", "good").count().groupBy("bucket").agg(F.sum("count").alias("raw"), F.sum(F.col("count") * F.col("good")).alias("good"))
    raw, good = [ADDED] * BUCKETS, [ADDED] * BUCKETS
    for r in rows.collect():
        raw[r.bucket - 1] += r.raw
        good[r.bucket - 1] += r.good
    if sum(good) == ADDED * BUCKETS:
        return [0.0] * BUCKETS, good
    raw_log, good_log = log(sum(raw)), log(sum(good))
    return [log(g) - good_log - log(r) + raw_log for r, g in zip(raw, good, strict=True)], good


def raised(n: Column, good: Column, own: Column) -> Column:
    """What `own` of the trusted n-grams of a bucket add to its logarithm, n times."""
    return n * (F.log(good) - F.log(good - own))


def share(raised_: Column, n: Column, own: Column, whole: float) -> Column:
    """What `own` of all the trusted n-grams add to the ratio of a document of n."""
    return raised_ / n - F.lit(log(whole)) + F.log(F.lit(whole) - own)


def own_shares(sample: DataFrame, good: list[float], id_col: str, text_col: str, name: str) -> DataFrame:
    """(id, text_key, `name`): what the trusted n-grams of all rows of its id add to the ratio of a text."""
    counts = sample.sparkSession.createDataFrame([(i + 1, g) for i, g in enumerate(good) if g > ADDED], "bucket int, good double")
    rows = sample.groupBy(F.col(id_col).alias("id"), F.col(text_col).alias("text")).agg(F.count("*").alias("rows"))
    grams = bucket_rows(rows.withColumn("key", text_key("text")), "text", "id", "key", "rows")
    texts = grams.groupBy("id", "key", "rows", "bucket").agg(F.count("*").alias("n"))
    own = texts.groupBy("id", "bucket").agg(F.sum(F.col("n") * F.col("rows")).alias("own"))
    all_ = own.groupBy("id").agg(F.sum("own").alias("all_"))
    added = texts.join(own, ["id", "bucket"]).join(F.broadcast(counts), "bucket")
    sums = added.groupBy("id", "key").agg(F.sum(raised(F.col("n"), F.col("good"), F.col("own"))).alias("raised"), F.sum("n").alias("n"))
    return sums.join(all_, "id").select(F.col("id").alias(id_col), F.col("key").alias("text_key"), share(F.col("raised"), F.col("n"), F.col("all_"), sum(good)).alias(name))


def text_key(text: Column | str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def scored(docs: DataFrame, ratios: list[float], good: list[float], text_col: str, mark: str, own: str, name: str) -> DataFrame:
    """Adds the rule counts and a struct `name` (ratio, failed) to documents. Where the column
    `mark` is 1, a row's own trusted n-grams are taken off, or the share in the column `own` if any."""
    table, trusted = listed(ratios), listed(good)
    df, hashes = counted(docs, text_col)
    buckets_, sorted_, ends_, raised_ = fresh(df, "_buckets", "_sorted", "_ends", "_raised")
    df = df.withColumn(buckets_, buckets(F.col(hashes)))
    total = F.aggregate(buckets_, F.lit(0.0), lambda a, b: a + F.element_at(table, b))
    n = F.size(buckets_)
    # Own counts are the lengths of runs of equal buckets, in order.
    alone = (F.col(mark) == 1) & F.col(own).isNull() & (n > 0)
    df = df.withColumn(sorted_, F.when(alone, F.sort_array(buckets_)))
    ends = F.transform(sorted_, lambda b, i: F.when(~b.eqNullSafe(F.get(sorted_, i + 1)), i + 1))
    df = df.withColumn(ends_, F.array_compact(ends))
    begins = F.concat(F.array(F.lit(0)), F.slice(ends_, F.lit(1), F.size(ends_) - 1))
    runs = F.zip_with(ends_, begins, lambda b, a: F.struct((b - a).alias("n"), F.element_at(trusted, F.element_at(sorted_, b)).alias("good")))
    df = df.withColumn(raised_, F.when(alone, F.aggregate(runs, F.lit(0.0), lambda a, r: a + raised(r["n"], r["good"], r["n"]))))
    held = F.coalesce(own, share(F.col(raised_), n, n, sum(good)), F.lit(0.0))
    ratio = F.when(n > 0, total / n) - held
    # A generator keeps a filter on `kept` from being pushed down and evaluating all this again.
    made = F.struct(ratio.alias("ratio"), F.col("base_failed").alias("failed"))
    return df.select("*", F.explode(F.array(made)).alias(name)).drop(hashes, buckets_, sorted_, ends_, raised_)


def judge(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Adds the rule counts of rule_counts(), `ratio` and `kept`.

    ratio is the mean log-likelihood ratio of a document's hashed words and word pairs (null
    without words), that of a trusted document without its own trusted counts, which are those of
    all rows with its id; kept is whether the rules hold and ratio is at least `least`. By default
    that is the lowest ratio of the trusted documents that the rules keep: ratios shrink and
    scatter with the number of trusted documents, and held-out good documents show how far. Without
    such documents there is no verdict and the rules alone decide. Other columns stay, or those in
    `keep`.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("ratio", "kept", *COUNTS)]
    good_, own_, key_, judged = fresh(docs, "_good", "_own", "_key", "_judged")
    ids = staged(trusted.select(id_col).where(F.col(id_col).isNotNull()).distinct().withColumn(good_, F.lit(1)))
    near = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    marked = docs.select(*dict.fromkeys([id_col, text_col, *columns])).join(near, id_col, "left")
    ratios, good = ratio_table(marked, text_col, good_)
    again = staged(docs.select(id_col).join(near, id_col).groupBy(id_col).count().where("count > 1").select(id_col))
    if again.isEmpty():
        marked = marked.withColumn(own_, F.lit(None).cast("double"))
    else:
        twice = F.broadcast(again) if again.count() <= BROADCAST else again
        own = own_shares(docs.select(id_col, text_col).join(twice, id_col), good, id_col, text_col, own_).withColumnRenamed("text_key", key_)
        marked = marked.withColumn(key_, text_key(text_col)).join(own, [id_col, key_], "left").drop(key_)
    made = scored(marked, ratios, good, text_col, good_, own_, judged).select(*columns, *COUNTS, good_, judged)
    if least is None:
        made = staged(made)
        least = made.where((F.col(good_) == 1) & ~F.col(judged)["failed"]).agg(F.min(F.col(judged)["ratio"])).head()[0]
    cut = F.lit(float("-inf") if least is None else least)
    kept = ~F.col(judged)["failed"] & (F.coalesce(F.col(judged)["ratio"], F.lit(0.0)) >= cut)
    return made.withColumns({"ratio": F.col(judged)["ratio"], "kept": kept}).drop(judged, good_)
