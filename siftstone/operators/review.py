"""Candidates and their review: statuses, selections, drafts, progress, probes and checks on plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions import text as tx
from siftstone.operators import evalset, scoring

STATUSES = ("bad_json", "skipped_by_model", "incomplete", "evidence_not_verbatim", "ok")


def candidate_status(candidates: DataFrame, sections: DataFrame) -> DataFrame:
    """(candidate_id, status) of model replies (candidate_id, raw, keys): every quote must stand in a section the candidate names, and every section must be quoted.

    The first rule that applies decides: unreadable reply, skipped, a part
    missing, a quote not found, ok.
    """
    schema = "struct<skip:boolean,question:string,answer:string,evidence:array<string>>"
    parsed = candidates.withColumn("r", F.from_json("raw", schema)).withColumn("readable", F.try_parse_json("raw").isNotNull())
    quotes = parsed.select("candidate_id", "keys", F.explode("r.evidence").alias("quote"))
    places = quotes.select("candidate_id", "quote", F.explode("keys").alias("key")).join(sections.select("key", "text"), "key")
    met = places.withColumn("at", tx.locate("text", "quote")["start"])
    each = met.groupBy("candidate_id", "quote").agg(F.max(F.col("at").isNotNull()).alias("found"))
    all_found = each.groupBy("candidate_id").agg(F.min("found").alias("found"))
    touched = met.where("at is not null").groupBy("candidate_id").agg(F.count_distinct("key").alias("touched"))
    r = F.col("r")
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    status = (
        F.when(~F.col("readable"), "bad_json")
        .when(F.coalesce(r["skip"], F.lit(False)), "skipped_by_model")
        .when(blank(r["question"]) | blank(r["answer"]) | (F.coalesce(F.size(r["evidence"]), F.lit(0)) <= 0), "incomplete")
        .when(~F.coalesce("found", F.lit(False)) | (F.coalesce("touched", F.lit(0)) < F.size("keys")), "evidence_not_verbatim")
        .otherwise("ok")
    )
    return parsed.join(all_found, "candidate_id", "left").join(touched, "candidate_id", "left").select("candidate_id", status.alias("status"))


def selection_span(text: str | Column, start: str | Column, end: str | Column, selected: str | Column) -> Column:
    """struct(start, end) of a selection: its offsets where the text there agrees after trimming, else where the selected text is found; null if nowhere."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    there = F.substring(c(text), c(start) + 1, c(end) - c(start))
    found = tx.locate(c(text), c(selected))
    agrees = F.btrim(there) == F.btrim(c(selected))
    lead = F.length(there) - F.length(F.ltrim(there))
    kept = F.struct((c(start) + lead).cast("int").alias("start"), (c(start) + lead + F.length(F.btrim(there))).cast("int").alias("end"))
    return F.when(agrees & (F.btrim(there) != ""), kept).when(found["start"].isNotNull(), F.struct(found["start"].alias("start"), found["end"].alias("end")))


def clip_spans(spans: DataFrame, *by: str) -> DataFrame:
    """Spans (by..., start, end, lo, hi) cut to their section, relative to it, merged where they overlap."""
    cut = spans.select(*by, (F.greatest("start", "lo") - F.col("lo")).alias("start"), (F.least("end", "hi") - F.col("lo")).alias("end")).where("start < end")
    return evalset.merge_spans(cut, *by)


def decision_problems(log: DataFrame, reasons: list[str]) -> DataFrame:
    """(candidate_id, problem) of decisions (candidate_id, decision, reason, question, answer, evidence) that miss what they need."""
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    keep, none = F.col("decision") == "keep", F.coalesce(F.size("evidence"), F.lit(0)) <= 0
    problem = (
        F.when(~F.col("decision").isin("keep", "drop", "undo"), "unknown decision")
        .when((F.col("decision") == "drop") & ~F.coalesce(F.col("reason").isin(reasons), F.lit(False)), "unknown reason")
        .when(keep & (blank("question") | blank("answer")), "no question or answer")
        .when(keep & none, "no evidence")
    )
    return log.select("candidate_id", problem.alias("problem")).where("problem is not null")


def edited(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """(candidate_id, edited): whether a kept decision differs from its candidate in question, answer or evidence places."""
    kept = evalset.decided(log).where("decision = 'keep'").select("candidate_id", F.btrim("question").alias("q"), F.btrim("answer").alias("a"), F.col("evidence").alias("e"))
    changed = (F.col("q") != F.col("question")) | (F.col("a") != F.col("answer")) | ~evalset.same_spans(F.col("e"), F.col("evidence"))
    return candidates.join(kept, "candidate_id").select("candidate_id", F.coalesce(changed, F.lit(True)).alias("edited"))


def drafts(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates (candidate_id, question, answer) as a kept decision has edited them."""
    kept = evalset.decided(log).where("decision = 'keep'").select("candidate_id", F.col("question").alias("q"), F.col("answer").alias("a"))
    return candidates.join(kept, "candidate_id", "left").select("candidate_id", F.coalesce("q", "question").alias("question"), F.coalesce("a", "answer").alias("answer"))


def next_undecided(candidates: DataFrame, log: DataFrame, after: int) -> DataFrame:
    """The first candidate without a decision behind a position, round the end if need be."""
    open_ = evalset.undecided(candidates, log)
    return open_.orderBy((F.col("ix") <= after).cast("int"), "ix").limit(1)


def progress(log: DataFrame) -> DataFrame:
    """One row of counts over the decisions in force."""
    now = evalset.decided(log)
    return now.agg(F.count("*").alias("decided"), F.count_if(F.col("decision") == "keep").alias("kept"), F.count_if(F.col("decision") == "drop").alias("dropped"))


def next_handwritten(rows: DataFrame, prefix: str = "h") -> DataFrame:
    """The id after the greatest one (hid) in use."""
    number = F.coalesce(F.max(F.substring("hid", len(prefix) + 1, 9).cast("int")), F.lit(0)) + 1
    return rows.agg(F.format_string(prefix + "%03d", number).alias("hid"))


def targets(counts: DataFrame, least: dict[str, int]) -> DataFrame:
    """(target, found, met) of a one-row frame of counts against the least each should be."""
    rows = F.array(*(F.struct(F.lit(k).alias("target"), F.col(k).cast("long").alias("found"), (F.col(k) >= v).alias("met")) for k, v in least.items()))
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def extremes(docs: DataFrame, n: int = 5) -> DataFrame:
    """(end, place, doc_id, chars) of the n longest and n shortest texts; ties by id."""
    size = docs.select("doc_id", F.length("text").cast("long").alias("chars"))
    ends = []
    for name, first in (("largest", F.desc("chars")), ("smallest", F.asc("chars"))):
        some = size.orderBy(first, "doc_id").limit(n)
        ends.append(some.select(F.lit(name).alias("end"), F.row_number().over(Window.orderBy(first, "doc_id")).cast("long").alias("place"), "doc_id", "chars"))
    return ends[0].unionByName(ends[1])


def shared_phrase_shift(offered: DataFrame, final: DataFrame, least: int = 5) -> DataFrame:
    """Share of rows (overlap) whose longest shared run is at least so long, before and after review."""
    share = lambda df, name: df.agg(F.count("*").alias(f"{name}_n"), F.count_if(F.col("overlap") >= least).alias(f"{name}_long"))
    return share(offered, "offered").join(share(final, "final"))


def citation_hits(answers: DataFrame, chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """(n, hits): answered rows (qid, cited_chunks) of which a cited chunk covers some evidence (qid, doc_id, e_start, e_end)."""
    cited = answers.select("qid", F.explode("cited_chunks").alias("chunk_id")).join(chunks, "chunk_id")
    test = scoring.covers(F.col("start"), F.col("end"), F.col("e_start"), F.col("e_end"))
    hit = cited.join(evidence, ["qid", "doc_id"]).where(test).select("qid").distinct().withColumn("hit", F.lit(True))
    return answers.select("qid").join(hit, "qid", "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))


def answer_means(answers: DataFrame) -> DataFrame:
    """Answers that cite, invalid citations in all, mean context tokens and excerpts."""
    return answers.agg(F.count_if(F.size("citations") > 0).alias("citing"), F.sum(F.size("invalid_citations")).alias("invalid"), F.avg("context_tokens").alias("context_tokens"), F.avg(F.size("chunk_ids")).alias("excerpts"))


def context_facts(ranked: DataFrame, evidence: DataFrame, budget: int = scoring.BUDGET) -> DataFrame:
    """(qid, context_tokens, evidence_in_context, all_evidence_in_context) of the budget's prefix of a ranking."""
    inside = scoring.within_budget(ranked, budget)
    met = scoring.hits(inside, evidence).groupBy("qid").agg(F.count_distinct("ev_ix").alias("met"))
    wanted = evidence.groupBy("qid").agg(F.count_distinct("ev_ix").alias("wanted"))
    sums = inside.groupBy("qid").agg(F.sum("tokens").alias("context_tokens")).join(met, "qid", "left").join(wanted, "qid", "left").fillna(0, ["met", "wanted"])
    return sums.select("qid", "context_tokens", (F.col("met") > 0).alias("evidence_in_context"), (F.col("met") >= F.col("wanted")).alias("all_evidence_in_context"))


def paraphrase_probes(replies: DataFrame) -> DataFrame:
    """Probes or reasons from rewrites (qid, reference, raw)."""
    rows = replies.withColumn("answer", tx.json_text("raw", F.lit("answer"))).withColumn("problem", tx.paraphrase_verdict("reference", "answer"))
    return rows.select("qid", F.lit("paraphrase").alias("kind"), F.when(F.col("problem") == "ok", F.col("answer")).alias("answer"), F.when(F.col("problem") != "ok", F.col("problem")).alias("problem"))


def substitution_probes(replies: DataFrame) -> DataFrame:
    """Probes or reasons from substitutions (qid, reference, raw)."""
    rows = replies.withColumn("s", tx.substitute("reference", tx.json_text("raw", F.lit("original")), tx.json_text("raw", F.lit("replacement"))))
    return rows.select("qid", F.lit("substitution").alias("kind"), F.col("s.text").alias("answer"), F.col("s.problem").alias("problem"))


def fabrication_probes(replies: DataFrame) -> DataFrame:
    """Probes or reasons from made-up sentences (qid, reference, context, raw): the reference with the sentence added."""
    rows = replies.withColumn("sentence", tx.json_text("raw", F.lit("sentence"))).withColumn("problem", tx.fabrication_problem("context", "sentence"))
    return rows.select("qid", F.lit("fabricated").alias("kind"), F.when(F.col("problem").isNull(), F.concat_ws(" ", "reference", "sentence")).alias("answer"), "problem")


def assemble_probes(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable probes with ids and expected verdicts, and counts of the reasons others were rejected for."""
    from siftstone.operators.answers import EXPECTED

    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    expected = F.create_map(*(F.lit(x) for kv in EXPECTED.items() for x in kv))
    good = every.where("answer is not null").select(F.concat_ws(":", "qid", "kind").alias("probe_id"), "qid", "kind", expected[F.col("kind")].alias("expected"), "answer")
    return good, every.where("answer is null").groupBy("kind", "problem").agg(F.count("*").alias("n"))


def planted_errors(graded: DataFrame) -> DataFrame:
    """(n, rejected) of the three kinds of probes with an error planted (kind, as_expected)."""
    return graded.where(F.col("kind").isin("substitution", "swap", "fabricated")).agg(F.count("*").alias("n"), F.count_if("as_expected").alias("rejected"))


def embed(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], batch: int = 32) -> DataFrame:
    """Texts (key, text) with normalised vectors from an encoder that is loaded in each worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = np.asarray(encode(part["text"].tolist()), dtype="float32")
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"key": part["key"], "embedding": list(vectors)})

    return texts.select("key", "text").mapInPandas(run, T.StructType([texts.schema["key"], T.StructField("embedding", T.ArrayType(T.FloatType()))]))
