import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.operators import answers, review
from siftstone.sources import settings

LOG = "candidate_id int, at string, seq int, decision string, reason string, question string, answer string, evidence array<string>"


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (1, "t1", 1, "keep", None, "q", "a", ["e"]),
        (1, "t2", 2, "undo", None, None, None, None),
        (2, "t1", 3, "drop", "vague", None, None, None),
        (3, "t1", 4, "keep", None, "edited", "b", ["e"]),
        (4, "t1", 5, "keep", None, "q", "", ["e"]),
        (5, "t1", 6, "drop", "no such", None, None, None),
    ]
    return spark.createDataFrame(rows, LOG)


def test_decisions(spark, log):
    assert review.progress(log).first().asDict() == {"decided": 4, "kept": 2, "dropped": 2}
    assert sorted(map(tuple, review.decision_problems(log, ["vague"]).collect())) == [(4, "no question or answer"), (5, "unknown reason")]
    candidates = spark.createDataFrame([(i, i, "old", "old") for i in range(1, 8)], "candidate_id int, ix int, question string, answer string")
    assert {r.candidate_id: r.question for r in review.drafts(candidates, log).collect()}[3] == "edited"
    assert [review.next_undecided(candidates, log, after).first().candidate_id for after in (0, 1, 6, 7)] == [1, 6, 7, 1]
    assert review.next_handwritten(spark.createDataFrame([("h002",), ("h010",)], "hid string")).first().hid == "h011"


def test_selection_after_an_emoji(spark):
    rows = spark.createDataFrame([("👆 pick this text", 2, 6, "pick"), ("👆 pick this text", 3, 7, "pick"), ("👆 pick", 0, 1, "gone")], "text string, start int, end int, selected string")
    got = [r.s and (r.s.start, r.s.end) for r in rows.select(review.selection_span("text", "start", "end", "selected").alias("s")).collect()]
    assert got == [(2, 6), (2, 6), None]


def test_probes(spark):
    para = review.paraphrase_probes(spark.createDataFrame([(1, "Use x_y now", '{"answer": "now use x_y"}'), (2, "a", "bad")], "qid int, reference string, raw string"))
    sub = review.substitution_probes(spark.createDataFrame([(1, "port 80", '{"original": "80", "replacement": "81"}')], "qid int, reference string, raw string"))
    fab = review.fabrication_probes(spark.createDataFrame([(1, "r", "the context", '{"sentence": "The  context"}')], "qid int, reference string, context string, raw string"))
    good, rejected = review.assemble_probes(para, sub, fab)
    assert sorted((r.probe_id, r.expected, r.answer) for r in good.collect()) == [("1:paraphrase", "correct", "now use x_y"), ("1:substitution", "incorrect", "port 81")]
    assert sorted(map(tuple, rejected.collect())) == [("fabricated", "in context", 1), ("paraphrase", "no rewrite", 1)]
    graded = answers.grade(spark.createDataFrame([("swap", "incorrect"), ("swap", "correct"), ("supported", "faithful")], "kind string, verdict string"))
    assert review.planted_errors(graded).first().asDict() == {"n": 2, "rejected": 1}


def test_context_facts_and_targets(spark):
    ranked = spark.createDataFrame([(1, 1, "d", 0, 100, 10), (1, 2, "d", 100, 200, 9999)], "qid int, rank int, doc_id string, start int, end int, tokens int")
    evidence = spark.createDataFrame([(1, 1, "d", 10, 20), (1, 2, "d", 150, 160)], "qid int, ev_ix int, doc_id string, e_start int, e_end int")
    r = review.context_facts(ranked, evidence).first()
    assert (r.context_tokens, r.evidence_in_context, r.all_evidence_in_context) == (10, True, False)
    met = review.targets(spark.createDataFrame([(5, 1)], "pages int, multi int"), {"pages": 5, "multi": 2})
    assert sorted(map(tuple, met.collect())) == [("multi", 1, False), ("pages", 5, True)]


def test_embed(spark):
    texts = spark.createDataFrame([("a", "xx"), ("b", "y")], "key string, text string")
    got = {r.key: r.embedding for r in review.embed(texts, lambda batch: np.array([[len(t), 0.0] for t in batch])).collect()}
    assert got == {"a": [1.0, 0.0], "b": [1.0, 0.0]}


def test_settings(spark, tmp_path):
    assert settings.load_settings(["A=1", "# c=2", 'B="x y"', "bad"], {"A": "9"}) == {"A": "9", "B": "x y"}
    (tmp_path / "f").write_text("abc")
    settings.require_path(spark, str(tmp_path / "f"), "make it")
    assert settings.file_digest(spark, str(tmp_path / "f")) == "ba7816bf8f01cfea"
    with pytest.raises(FileNotFoundError, match="make it"):
        settings.require_path(spark, str(tmp_path / "g"), "make it")


def test_merging_of_rows(spark):
    rows = spark.createDataFrame([(5,), (2,)], "overlap int")
    assert review.shared_phrase_shift(rows, rows.where(F.col("overlap") < 3)).first().asDict() == {"offered_n": 2, "offered_long": 1, "final_n": 1, "final_long": 0}
