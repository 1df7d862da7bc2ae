"""Hits against evidence spans, budgets, run summaries and paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.stats import mcnemar_exact, nearest_rank, wilson

DEPTH, CUT, BUDGET = 10, 5, 2500


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def covers(c_start: Column, c_end: Column, e_start: Column, e_end: Column, fraction: float = 0.5) -> Column:
    """Whether a chunk holds the fraction of an evidence span; none or less means any overlap."""
    both = overlap(c_start, c_end, e_start, e_end)
    return both > 0 if fraction <= 0 else both >= fraction * (e_end - e_start)


def hits(ranked: DataFrame, evidence: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(qid, rank, ev_ix) where a ranked chunk (qid, rank, doc_id, start, end) covers evidence (qid, ev_ix, doc_id, e_start, e_end).

    An interval join with doc_id and qid as equality keys, so it is a hash join with a residual test.
    """
    test = covers(F.col("start"), F.col("end"), F.col("e_start"), F.col("e_end"), fraction)
    return ranked.join(evidence, ["qid", "doc_id"]).where(test).select("qid", "rank", "ev_ix").distinct()


def within_budget(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The leading rows of (qid, rank, tokens) whose running sum fits; the first always stays, and the first overflow ends it."""
    run = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("running", F.sum("tokens").over(run)).where((F.col("rank") == 1) | (F.col("running") <= budget))


def score_questions(questions: DataFrame, ranked: DataFrame, evidence: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row for each question: first hit, reciprocal rank, hits at 5 and in the budget, any overlap, all evidence at 5."""
    found = hits(ranked, evidence).groupBy("qid").agg(F.min("rank").alias("first"), F.count_distinct(F.when(F.col("rank") <= CUT, F.col("ev_ix"))).alias("met5"))
    loose = hits(ranked.where(F.col("rank") <= CUT), evidence, 0.0).select("qid").distinct().withColumn("any", F.lit(True))
    inside = within_budget(ranked, budget)
    in_budget = hits(inside, evidence).select("qid").distinct().withColumn("fits", F.lit(True))
    sizes = inside.groupBy("qid").agg(F.count("*").alias("budget_chunks"))
    wanted = evidence.groupBy("qid").agg(F.count_distinct("ev_ix").alias("n_ev"))
    rows = questions.select("qid")
    for more in (found, loose, in_budget, sizes, wanted):
        rows = rows.join(more, "qid", "left")
    first = F.when(F.col("first") <= DEPTH, F.col("first"))
    return rows.select(
        "qid",
        first.cast("long").alias("first_hit"),
        F.coalesce(1 / first, F.lit(0.0)).alias("rr"),
        F.coalesce(first <= CUT, F.lit(False)).alias("hit5"),
        F.coalesce("any", F.lit(False)).alias("hit_any_overlap"),
        F.coalesce("fits", F.lit(False)).alias("hit_budget"),
        F.coalesce("budget_chunks", F.lit(0)).cast("long").alias("budget_chunks"),
        (F.coalesce("met5", F.lit(0)) >= F.coalesce("n_ev", F.lit(0))).alias("all_evidence_top5"),
    )


def share(flag: str | Column) -> Column:
    return F.avg((F.col(flag) if isinstance(flag, str) else flag).cast("double"))


def summarise(results: DataFrame, *by: str, latency: str | None = None) -> DataFrame:
    """One row for each run: means, Wilson intervals, and nearest-rank latencies where a column is named."""
    hits5 = F.count_if("hit5")
    ci = wilson(hits5, F.count("*"))
    columns = [F.count("*").alias("n"), share("hit5").alias("recall5"), ci["lo"].alias("recall5_lo"), ci["hi"].alias("recall5_hi"), F.avg("rr").alias("mrr10"), share("all_evidence_top5").alias("all_evidence5"), share("hit_any_overlap").alias("recall5_any_overlap"), share("hit_budget").alias("recall_budget"), F.avg("budget_chunks").alias("budget_chunks_mean")]
    if latency:
        columns += [nearest_rank(latency, 0.5).alias("p50"), nearest_rank(latency, 0.95).alias("p95")]
    return results.groupBy(*by).agg(*columns)


def discordant(a: DataFrame, b: DataFrame, key: str = "qid", flag: str = "hit5") -> DataFrame:
    """fixed (b only), broken (a only) and the exact p of two runs over the same questions."""
    both = a.select(key, F.col(flag).alias("x")).join(b.select(key, F.col(flag).alias("y")), key)
    counts = both.agg(F.count_if(~F.col("x") & F.col("y")).alias("fixed"), F.count_if(F.col("x") & ~F.col("y")).alias("broken"))
    return counts.withColumn("p", mcnemar_exact("broken", "fixed"))


def compare_grid(results: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Paired tests of runs (run, qid, hit5, rr) for each row (run_a, run_b) of a comparison table."""
    a = results.select(F.col("run").alias("run_a"), "qid", F.col("hit5").alias("xa"), F.col("rr").alias("ra"))
    b = results.select(F.col("run").alias("run_b"), "qid", F.col("hit5").alias("xb"), F.col("rr").alias("rb"))
    both = F.broadcast(comparisons).join(a, "run_a").join(b, ["run_b", "qid"])
    grid = both.groupBy("run_a", "run_b").agg(F.count_if(~F.col("xa") & F.col("xb")).alias("fixed"), F.count_if(F.col("xa") & ~F.col("xb")).alias("broken"), F.avg(F.col("rb") - F.col("ra")).alias("mrr_delta"))
    return grid.withColumn("p", mcnemar_exact("broken", "fixed"))
