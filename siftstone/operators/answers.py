"""Contexts, cached model calls, answers, judges and probes around an injected callable."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import text as tx

EXPECTED = {"paraphrase": "correct", "substitution": "incorrect", "swap": "incorrect", "supported": "faithful", "fabricated": "unfaithful"}
# The failures that may pass when the same call is made again.
RETRY_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
RETRY_NAMES = ("APIConnectionError", "APITimeoutError", "RateLimitError", "InternalServerError", "ConnectionError", "Timeout")
Model = Callable[[str, str], str]


def excerpt_heading(title: Column, section: Column, level: Column, url: Column) -> Column:
    """page, or page > section below level 1, and the address on a line of its own."""
    path = F.when(section.isNull() | (level == 1), title).otherwise(F.concat(title, F.lit(" > "), section))
    return F.concat(path, F.lit("\n"), url)


def assemble(ranked: DataFrame) -> DataFrame:
    """(qid, context, chunk_ids) of ranked excerpts (qid, rank, chunk_ix, heading, text), numbered in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_ix", "heading", "text")))
    blocks = F.transform("rows", lambda r, i: F.concat(F.lit("["), i + 1, F.lit("] "), r["heading"], F.lit("\n"), F.btrim(r["text"], F.lit(" \n\t\r"))))
    return ranked.groupBy("qid").agg(rows.alias("rows")).select("qid", F.array_join(blocks, "\n\n").alias("context"), F.transform("rows", lambda r: r["chunk_ix"]).alias("chunk_ids"))


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Excerpts from the documentation:\n\n"), context, F.lit("\n\nAnswer this question from them: "), question)


def retryable(error: Exception) -> bool:
    """Whether a failed call may be tried again: by its status where it has one, else by its name."""
    status = getattr(error, "status_code", None)
    return status in RETRY_STATUS if isinstance(status, int) else type(error).__name__ in RETRY_NAMES


def with_retries(call: Callable[[], str], tries: int = 4, wait: Callable[[float], None] = time.sleep) -> str:
    for k in range(tries):
        try:
            return call()
        except Exception as error:
            if k + 1 == tries or not retryable(error):
                raise
            wait(2**k + random.random())
    raise AssertionError("no tries")


def complete(requests: DataFrame, cache: DataFrame, model: Model | None = None, name: str = "model") -> DataFrame:
    """(id, key, text, cached) for requests (id, system, prompt): from the cache (key, text), else by the model.

    Equal requests are one call. Without a model a miss is an error. Only the
    misses reach Python; the caller appends them to the cache table.
    """
    keyed = requests.withColumn("model", F.lit(name)).withColumn("key", tx.request_key("model", "system", "prompt"))
    held = keyed.select("id", "key").join(cache.select("key", F.col("text").alias("held")), "key", "left")
    hits = held.where("held is not null").select("id", "key", F.col("held").alias("text"), F.lit(True).alias("cached"))
    misses = keyed.join(cache.select("key"), "key", "left_anti").select("key", "system", "prompt").dropDuplicates(["key"])
    if model is None:
        made = misses.select("key", F.raise_error(F.concat(F.lit("not in the cache: "), "key")).cast("string").alias("text"))
    else:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"key": frame["key"], "text": [with_retries(lambda s=s, p=p: model(s, p)) for s, p in zip(frame["system"], frame["prompt"])]})

        made = misses.mapInPandas(run, "key string, text string")
    return hits.unionByName(keyed.select("id", "key").join(made, "key").select("id", "key", "text", F.lit(False).alias("cached")))


def ask(rows: DataFrame, prompt: Column, system: str, cache: DataFrame, model: Model | None, name: str = "model") -> DataFrame:
    """Rows (qid, ...) with the reply `text` to a prompt made of them, from the cache or the model."""
    requests = rows.select(F.col("qid").alias("id"), F.lit(system).alias("system"), prompt.alias("prompt"))
    return rows.join(complete(requests, cache, model, name).select(F.col("id").alias("qid"), "text"), "qid")


def grounded_answers(questions: DataFrame, ranked: DataFrame, system: str, phrase: str, cache: DataFrame, model: Model | None = None) -> DataFrame:
    """Answers to (qid, question) from ranked excerpts (qid, rank, chunk_ix, heading, text), with the facts of answer_facts."""
    rows = questions.select("qid", "question").join(assemble(ranked), "qid")
    return answer_facts(ask(rows, answer_prompt(F.col("question"), F.col("context")), system, cache, model), phrase)


def closed_book(questions: DataFrame, system: str, phrase: str, cache: DataFrame, model: Model | None = None) -> DataFrame:
    """Answers to (qid, question) without any excerpt; whatever they cite is out of range."""
    rows = questions.select("qid", "question", F.array().cast("array<string>").alias("chunk_ids"))
    return answer_facts(ask(rows, F.concat(F.lit("Question: "), "question"), system, cache, model), phrase)


def judge_correctness(answers: DataFrame, system: str, cache: DataFrame, model: Model | None = None) -> DataFrame:
    """(qid, verdict, reason) of answers (qid, question, reference, text), read from the judge's JSON reply."""
    prompt = F.concat(F.lit("Question:\n"), "question", F.lit("\n\nReference answer:\n"), "reference", F.lit("\n\nAnswer to grade:\n"), tx.strip_citations("answer"))
    judged = ask(answers.withColumnRenamed("text", "answer"), prompt, system, cache, model).withColumn("c", tx.parse_correctness("text"))
    return judged.select("qid", "c.verdict", "c.reason")


def judge_faithfulness(answers: DataFrame, system: str, cache: DataFrame, model: Model | None = None) -> DataFrame:
    """(qid, valid, faithful, claims) of answers (qid, context, text)."""
    prompt = F.concat(F.lit("Excerpts:\n"), "context", F.lit("\n\nAnswer to check:\n"), tx.strip_citations("answer"))
    judged = ask(answers.withColumnRenamed("text", "answer"), prompt, system, cache, model).withColumn("f", tx.parse_faithfulness("text"))
    return judged.select("qid", "f.valid", tx.faithful(F.col("f")).alias("faithful"), "f.claims")


def unreadable(judged: DataFrame) -> DataFrame:
    """Replies of the judge that can't be read, by question kind (verdict, valid)."""
    return judged.agg(F.count_if(F.col("verdict") == "invalid").alias("verdicts"), F.count_if(~F.col("valid")).alias("claim_lists"))


def answer_facts(answers: DataFrame, phrase: str) -> DataFrame:
    """Answers (qid, text, chunk_ids) with refusal flags, citations in and out of range, and the cited chunks."""
    split = tx.split_citations(tx.citations("text"), F.size("chunk_ids"))
    facts = answers.withColumn("refused", tx.is_refusal("text", phrase)).withColumn("partial_refusal", tx.mentions_refusal("text", phrase)).withColumn("split", split)
    return facts.select("*", F.col("split.valid").alias("citations"), F.col("split.invalid").alias("invalid_citations")).withColumn("cited_chunks", tx.cited_items(F.col("citations"), F.col("chunk_ids"))).drop("split")


def to_judge(answers: DataFrame) -> DataFrame:
    """What the judge sees of (qid, answerable, refused, text): nothing for unanswerable ones and refusals."""
    return answers.withColumn("verdict", F.when(F.col("answerable") & F.col("refused"), "incorrect")).withColumn("judged_text", F.when(F.col("answerable") & ~F.col("refused"), tx.strip_citations("text")))


def grade(probes: DataFrame) -> DataFrame:
    """Probes (kind, verdict) with what was expected, and whether it came; invalid replies never count."""
    expected = F.create_map(*(F.lit(x) for kv in EXPECTED.items() for x in kv))
    return probes.withColumn("expected", expected[F.col("kind")]).withColumn("as_expected", (F.col("verdict") == F.col("expected")) & (F.col("verdict") != "invalid"))


def swap_probes(references: DataFrame, nearest: DataFrame) -> DataFrame:
    """References (qid, text) answered by another's nearest text (qid, other, similarity), unless equal but for white space."""
    mine = references.join(nearest, "qid")
    met = mine.join(references.select(F.col("qid").alias("other"), F.col("text").alias("answer")), "other")
    return met.where(tx.squeeze("text") != tx.squeeze("answer")).select("qid", F.concat("qid", F.lit(":swap")).alias("probe_id"), "answer", "other", F.round("similarity", 3).alias("similarity"))
