"""Counts and rates that reports are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.stats import nearest, ranked_values, wilson


def rate(rows: DataFrame, flag: str, *by: str) -> DataFrame:
    """(by..., n, k, rate, lo, hi) of a boolean column."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("k"))
    ci = wilson("k", "n")
    return counts.select(*by, "n", "k", (F.col("k") / F.col("n")).alias("rate"), ci["lo"].alias("lo"), ci["hi"].alias("hi"))


def capped_histogram(rows: DataFrame, value: str, cap: int = 8) -> DataFrame:
    """(bucket, n) for every bucket from 0 to cap, larger values in the last."""
    buckets = rows.sparkSession.range(cap + 1).select(F.col("id").alias("bucket"))
    counts = rows.groupBy(F.least(F.col(value), F.lit(cap)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(buckets).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Totals and sizes of texts: count, characters, words, least, median, index percentile, most; sizes are counted by value."""
    size = docs.select(F.length("text").cast("long").alias("chars"), F.size(F.regexp_extract_all("text", F.lit(r"[^ \n\t\r]+"), F.lit(0))).alias("words"))
    by_size = size.groupBy("chars").agg(F.count("*").alias("times"), F.sum("words").alias("words"))
    total = by_size.agg(F.sum("times").alias("pages"), F.sum(F.col("chars") * F.col("times")).alias("chars"), F.sum("words").alias("words"), F.min("chars").alias("least"), F.max("chars").alias("most"))
    places = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p90": lambda n: F.floor((n - 1) * 0.9)}
    ranked = ranked_values(size, "chars", places).select(((F.col("low") + F.col("high")) / 2).alias("median"), "p90")
    return total.join(F.broadcast(ranked)).select("pages", "chars", "words", "least", "median", "p90", "most")


def matrix(rows: DataFrame, flag: str, *by: str) -> DataFrame:
    """(by..., yes, no): counts of a boolean by one key or more, as mode and answerable."""
    return rows.groupBy(*by).agg(F.count_if(F.col(flag)).alias("yes"), F.count_if(~F.col(flag)).alias("no"))


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., n): rows of each group, as the verdicts of each kind of probe."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def distinct_pages(questions: DataFrame) -> DataFrame:
    """How many pages the evidence of a question set stands in."""
    return questions.select(F.explode("evidence.doc_id").alias("doc_id")).agg(F.count_distinct("doc_id").alias("pages"))


def usage(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """(model, calls, input_tokens, output_tokens, cost) of the calls that missed the cache; prices are for a million tokens."""
    price = lambda k: F.create_map(*(F.lit(x) for m, p in prices.items() for x in (m, p[k])))[F.col("model")]
    sums = calls.where(~F.col("cached")).groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.withColumn("cost", (F.col("input_tokens") * price(0) + F.col("output_tokens") * price(1)) / 1e6)


def latencies(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., n, p50, p95) by nearest rank."""
    return ranked_values(rows, value, {"p50": nearest(0.5), "p95": nearest(0.95)}, *by)


def paired_catch(probes: DataFrame) -> DataFrame:
    """Of questions whose supported probe passed: n, and how many fabricated ones were caught (qid, kind, as_expected)."""
    clean = probes.where("kind = 'supported' and as_expected").select("qid")
    return probes.where("kind = 'fabricated'").join(clean, "qid").agg(F.count("*").alias("n"), F.count_if("as_expected").alias("caught"))


def claim_totals(judged: DataFrame) -> DataFrame:
    """Answers, claims, unsupported claims and wholly supported answers of (claims)."""
    bad = F.size(F.filter("claims", lambda c: ~c["supported"]))
    return judged.agg(F.count("*").alias("answers"), F.sum(F.size("claims")).alias("claims"), F.sum(bad).alias("unsupported"), F.count_if((F.size("claims") > 0) & (bad == 0)).alias("all_supported"))


def reconcile(found: DataFrame, reported: float, column: str, within: float = 1e-9) -> DataFrame:
    """The one row of `found`, or an error if its rate is not the reported one."""
    off = F.abs(F.col(column) - F.lit(reported)) > within
    return found.withColumn(column, F.when(off, F.raise_error(F.concat(F.lit(f"{column} differs from {reported}: "), F.col(column).cast("string"))).cast("double")).otherwise(F.col(column)))
