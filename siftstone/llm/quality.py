"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import SPACE, clean_text, documents, staged

#: Hash buckets of the two multinomials, which bounds the model.
BUCKETS = 65_536
#: Labelled rows at most that the trusted multinomial is estimated on.
TRUSTED_ROWS = 20_000
#: A document passes if its mean log ratio is at least this.
THRESHOLD = -0.2
#: Lines with a word: whole lines, as only a newline ends one.
_LINE = f"(?dm)^[\\x20\\x09\\x0B-\\x0D]*+[^{SPACE}][^\\n]*+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _windows(hashes: Column, n: Column) -> Column:
    """64-bit hashes of the eight-word windows of a text that could repeat one; else null."""
    windows = F.transform(F.sequence(F.lit(0), n - 8), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(8))))
    return F.when(n >= 9, windows)


def _by_hash(windows: Column) -> Column:
    return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def features(docs: DataFrame) -> DataFrame:
    """The base counts of (doc_id, text), and the word hashes the ratio needs.

    Only a text with equal windows sorts them: neighbours in hash order give
    the starts of windows that repeat, and each covers words up to the next.
    """
    text = docs.select(F.col("doc_id"), clean_text().alias("text"))
    parts = text.select("doc_id", "text", words_of(F.col("text")).alias("words"), F.regexp_extract_all("text", F.lit(_LINE), F.lit(0)).alias("lines"))
    counted = parts.select(
        "doc_id",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = counted.withColumn("windows", _windows(F.col("hashes"), F.col("n")))
    ordered = windows.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _by_hash(F.col("windows")))).drop("windows")
    o = F.col("ordered")
    same = lambda k, j: F.coalesce(F.get(o, k)["h"] == F.get(o, j)["h"], F.lit(False))
    starts = F.array_sort(F.filter(F.transform(o, lambda x, k: F.when(((k > 0) & same(k, k - 1)) | same(k, k + 1), x["i"])), lambda i: i.isNotNull()))
    found = ordered.withColumn("starts", starts).drop("ordered")
    s = F.col("starts")
    covered = F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(s, k + 1) - x, F.lit(8)))), F.lit(0), lambda a, b: a + b)
    return found.select("doc_id", "n", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "hashes")


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of the words and word pairs of a text, from the hashes of its words."""
    pairs = F.when(F.size(hashes) > 1, F.transform(F.sequence(F.lit(0), F.size(hashes) - 2), lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(buckets)).cast("int")))
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    return F.concat(single, F.coalesce(pairs, F.array().cast("array<int>")))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of trusted rows: labelled good, at most `rows` of them, chosen by the hash of the id."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.lit(1).alias("trusted"))


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio): ln of the trusted over the raw multinomial, add-one smoothed, for every bucket.

    The raw counts are over all documents. `trusted` is bounded, so it is broadcast.
    The generator is an outer one: for the other kind Spark infers a filter that
    would hash all words of a text again for each of them.
    """
    hashed = docs.select("doc_id", F.transform(words_of(clean_text()), lambda w: F.xxhash64(w)).alias("hashes"))
    marked = hashed.join(F.broadcast(trusted), "doc_id", "left").select("trusted", F.explode_outer(ngram_buckets(F.col("hashes"), buckets)).alias("bucket"))
    counts = marked.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    every = staged(docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0), "ngrams")
    totals = every.agg(F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    share = lambda n, total: F.ln((F.col(n) + 1) / (totals.select(total).scalar() + buckets))
    return every.select("bucket", F.when(totals.select("goods").scalar() > 0, share("good", "goods") - share("raw", "raws")).otherwise(0.0).alias("ratio"))


def quality(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Base rules and the length-normalised log-likelihood ratio of every (doc_id, text).

    Each row is numbered as it is read and its n-grams are looked up in the
    model, a broadcast table of `buckets` rows; they are averaged again before
    anything is shuffled, so a row that leaves its task is one document.

    Null and empty texts have no words: they fail the base rules and have ratio
    0. Null ids and repeated rows each return a row; extra columns are ignored.
    Without trusted rows every ratio is 0 and the base rules alone decide.
    """
    seen = features(docs).withColumn("ngrams", ngram_buckets(F.col("hashes"), buckets)).drop("hashes").withColumn("row", F.monotonically_increasing_id())
    rows = [c for c in seen.columns if c != "ngrams"]
    each = seen.select(*rows, F.explode_outer("ngrams").alias("bucket")).join(F.broadcast(fit_ratio(docs, trusted, buckets)), "bucket", "left")
    scored = each.groupBy(*rows).agg(F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("log_ratio"))
    failed = (F.col("n") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n"))
    return scored.select("doc_id", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("log_ratio") >= threshold)).alias("kept"), "log_ratio")


def op10_quality_ratio(spark, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts for all documents."""
    return quality(documents(spark, sf_dir), trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
