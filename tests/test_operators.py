import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.functions import stats, text as tx
from siftstone.operators import answers, chunking, evalset, pages, report, retrieval, scoring
from siftstone.sources import files
from siftstone.streaming import decisions


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_intervals_and_exact_test(spark):
    r = one(spark, w=stats.wilson(F.lit(80), F.lit(100)), z=stats.wilson(F.lit(0), F.lit(0)), a=stats.mcnemar_exact(F.lit(0), F.lit(0)), b=stats.mcnemar_exact(F.lit(0), F.lit(10)), c=stats.mcnemar_exact(F.lit(6), F.lit(39)), d=stats.mcnemar_exact(F.lit(3000), F.lit(3000)))
    assert 0.70 < r.w.lo < 0.8 < r.w.hi < 0.88 and (r.z.lo, r.z.hi) == (0, 0)
    assert r.a == 1 and r.b < 0.01 and r.c == pytest.approx(5.417768988991156e-07) and r.d == 1


def test_windows(spark):
    def windows(n, size, overlap):
        out, i = [], 0
        while n:
            out.append(i)
            if i + size >= n:
                return out
            i += size - overlap
        return out

    for n in (0, 1, 9, 10, 11, 18, 19, 27, 28, 29, 100):
        found = list(chunking._windows([(i, i + 1) for i in range(n)], 10, 1))
        assert [a for a, _, _ in found] == windows(n, 10, 1)


def test_packing_equals_one_item_at_a_time():
    def greedy(sizes, most):
        out, at = [], 0
        for i, n in enumerate(sizes):
            if i > at and (sum(sizes[at : i + 1]) > most or n > most or sizes[at] > most):
                out.append((at, i))
                at = i
        return out + [(at, len(sizes))] * bool(sizes)

    rng = np.random.default_rng(2)
    for _ in range(300):
        sizes = rng.integers(0, 14, rng.integers(0, 12)).tolist()
        assert chunking.pack(sizes, 10) == greedy(sizes, 10)
    assert chunking.units("# a\n# b\nx\n# c\n# d\n", [0, 4, 10, 14]) == [(0, 10, True), (10, 18, False)]
    assert chunking.paragraphs("a\n\n\nb\n \nc") == [(0, 1), (4, 5), (8, 9)] and chunking.paragraphs("") == []


def test_section_chunks(spark):
    words = " ".join(f"w{i}" for i in range(32))
    body = "# Parent\n## Child\n" + "\n\n".join([words] * 6) + "\n## Tail\nshort\n## End"
    offsets = [body.index("# Parent"), body.index("## Child"), body.index("## Tail"), body.index("## End")]
    docs = spark.createDataFrame([(1, body, [(o,) for o in offsets])], "doc_id long, text string, headings array<struct<offset:int>>")
    got = [(r.start, r.end, r.n_tokens) for r in chunking.section_chunks(docs, most=80, overlap=10).orderBy("n").collect()]
    assert got[0][0] == 0 and all(k <= 80 for *_, k in got) and len(got) == 5
    assert body[got[-2][0] : got[-2][1]].strip() == "## Tail\nshort" and body[got[-1][0] :] == "## End"


def test_fusion_ties(spark):
    rows = lambda ids: spark.createDataFrame([(1, c, float(-k), k + 1) for k, c in enumerate(ids)], "qid int, chunk_ix int, score double, rank int")
    fused = retrieval.fuse(rows([7, 3, 5]), rows([4, 3, 9])).orderBy("rank").collect()
    assert [r.chunk_ix for r in fused] == [3, 7, 4, 5, 9]


def test_top_k_is_filled_with_unscored(spark):
    corpus = spark.createDataFrame([(i, "x") for i in range(5)], "chunk_ix int, text string")
    queries = spark.createDataFrame([(1, "q")], "qid int, text string")
    scores = spark.createDataFrame([(1, 3, 2.0), (1, 0, -1.0)], "qid int, chunk_ix int, score double")
    assert [r.chunk_ix for r in retrieval.top_k(scores, corpus, queries, 4).orderBy("rank").collect()] == [3, 1, 2, 4]
    assert [r.chunk_ix for r in retrieval.top_k(scores, corpus, queries, 3).orderBy("rank").collect()] == [3, 1, 2]


def test_cover_and_budget(spark):
    cover = lambda a, b, f=0.5: one(spark, x=scoring.covers(F.lit(a), F.lit(b), F.lit(100), F.lit(200), f)).x
    assert cover(0, 150) and not cover(0, 149) and cover(0, 101, 0.0)
    ranked = spark.createDataFrame([(1, k + 1, n) for k, n in enumerate((900, 900, 900, 10))] + [(2, 1, 9999)], "qid int, rank int, tokens int")
    assert [(r.qid, r.rank) for r in scoring.within_budget(ranked, 2500).orderBy("qid", "rank").collect()] == [(1, 1), (1, 2), (2, 1)]


def test_question_scores(spark):
    ranked = spark.createDataFrame([(1, k, "d", s, e, 10) for k, s, e in ((1, 500, 600), (2, 0, 150), (3, 300, 310), (4, 380, 500))], "qid int, rank int, doc_id string, start int, end int, tokens int")
    evidence = spark.createDataFrame([(1, 1, "d", 100, 200), (1, 2, "d", 400, 420)], "qid int, ev_ix int, doc_id string, e_start int, e_end int")
    questions = spark.createDataFrame([(1,)], "qid int")
    r = scoring.score_questions(questions, ranked, evidence).first()
    assert (r.first_hit, r.rr, r.all_evidence_top5, r.hit_budget) == (2, 0.5, True, True)
    assert not scoring.score_questions(questions, ranked.where("rank < 4"), evidence).first().all_evidence_top5


def test_merge_keeps_touching_spans_apart(spark):
    spans = spark.createDataFrame([("d", 0, 10), ("d", 5, 20), ("d", 20, 30)], "doc_id string, start int, end int")
    assert sorted((r.start, r.end) for r in evalset.merge_spans(spans, "doc_id").collect()) == [(0, 20), (20, 30)]


def test_shared_run(spark):
    left = spark.createDataFrame([(1, "How do I Read the body"), (2, "a"), (3, None)], "a_id int, text string")
    right = spark.createDataFrame([(7, "we read THE body well, do I read the body"), (8, "the body"), (9, "read the rest")], "b_id int, text string")
    found = lambda n: {(r.a_id, r.b_id): r.run for r in evalset.longest_shared_run(left, right, n).collect()}
    assert found(2) == {(1, 7): 5, (1, 8): 2, (1, 9): 2} and found(3) == {(1, 7): 5}


def test_quotes_of_any_length_are_located(spark):
    docs = spark.createDataFrame([(1, "xthe quick brown\nfox jumps overy and the quick"), (2, "quick brown"), (3, None), (4, "the “quick”  brown fox jumps")], "doc_id int, text string")
    quotes = [(1, "the quick brown\nfox jumps over"), (2, "quick"), (3, "the quick brown fox jumps"), (4, "ick brown"), (5, "the quick")]
    frame = spark.createDataFrame(quotes, "qid int, quote string")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    expected = {(q, d, t.find(s), t.find(s) + len(s)) for q, s in quotes for d, t in texts.items() if s in t}
    assert {tuple(r) for r in evalset.locate_exact(docs, frame).collect()} == expected
    assert {(r.qid, r.doc_id) for r in evalset.locate_loose(docs, frame).collect()} >= {(3, 1), (3, 4), (1, 4)} - {(1, 4)}


def test_ids_past_999_stay_apart(spark):
    rows = spark.range(1001).select(F.col("id").alias("pos"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.expr("cast(array() as array<struct<doc_id:string,anchor:string>>)").alias("evidence"), F.lit("o").alias("origin"), F.lit(None).cast("string").alias("candidate_id"))
    ids = [r.id for r in evalset.build_questions(rows, rows.limit(0), rows.limit(0)).collect()]
    assert len(set(ids)) == 1001 and {"q001", "q999", "q1000", "q1001"} <= set(ids)


def test_retries_by_status_or_name():
    from siftstone.operators.answers import retryable

    class RateLimitError(Exception):
        status_code = None

    class Odd(Exception):
        def __init__(self, status):
            self.status_code = status

    assert retryable(RateLimitError()) and retryable(Odd(425)) and not retryable(Odd(529)) and not retryable(Odd(400)) and not retryable(ValueError())


def test_answers_and_judges_with_a_model(spark):
    from siftstone.operators import answers

    questions = spark.createDataFrame([(1, "why?"), (2, "how?")], "qid int, question string")
    ranked = spark.createDataFrame([(1, 1, "c1", "P\nu", " one "), (1, 2, "c2", "Q\nv", "two"), (2, 1, "c3", "R\nw", "three")], "qid int, rank int, chunk_ix string, heading string, text string")
    cache = spark.createDataFrame([], "key string, text string")
    said = {r.qid: r for r in answers.grounded_answers(questions, ranked, "sys", "No idea.", cache, lambda s, p: "Two [2] and [5]." if "why?" in p else "no idea").collect()}
    assert said[1].context == "[1] P\nu\none\n\n[2] Q\nv\ntwo" and said[1].cited_chunks == ["c2"] and said[1].invalid_citations == [5] and said[2].refused
    closed = {r.qid: r for r in answers.closed_book(questions, "sys", "No idea.", cache, lambda s, p: f"{p} [1]").collect()}
    assert closed[1].text == "Question: why? [1]" and closed[1].citations == [] and closed[1].invalid_citations == [1]
    given = spark.createDataFrame([(1, "why?", "ref", "yes [1].", "ctx")], "qid int, question string, reference string, text string, context string")
    reply = '{"verdict": "partial", "reason": "r", "claims": [{"claim": "c", "supported": true}]}'
    seen = answers.judge_correctness(given, "sys", cache, lambda s, p: reply if p.endswith("yes.") else "[1] seen").first()
    assert (seen.verdict, seen.reason) == ("partial", "r")
    checked = answers.judge_faithfulness(given, "sys", cache, lambda s, p: reply).first()
    assert checked.valid and checked.faithful


def test_paired_bootstrap(spark):
    import random

    from siftstone.functions import stats

    a, b = [0.0, 1.0, 0.5, 0.25, 1.0], [1.0, 1.0, 0.0, 0.5, 1.0]
    rows = spark.createDataFrame([("g", i, x, y) for i, (x, y) in enumerate(zip(a, b))], "g string, i int, a double, b double")
    r = stats.paired_bootstrap_delta(rows, "g", "i", "a", "b", 400, 3).first()
    rng, diffs = random.Random(3), [y - x for x, y in zip(a, b)]
    means = sorted(sum(diffs[rng.randrange(5)] for _ in range(5)) / 5 for _ in range(400))
    assert (r.delta, r.lo, r.hi) == (pytest.approx(sum(diffs) / 5), means[10], means[389])


def test_edited_decisions(spark):
    from siftstone.operators import review

    kind = "candidate_id int, question string, answer string, evidence array<struct<doc_id:string,start:int,end:int>>"
    candidates = spark.createDataFrame([(i, "q", "a", [("d", 0, 1), ("d", 5, 6)]) for i in (1, 2, 3)], kind)
    log = spark.createDataFrame([(1, 1, 1, "keep", " q ", "a", [("d", 5, 6), ("d", 0, 1)]), (2, 1, 2, "keep", "other", "a", [("d", 0, 1), ("d", 5, 6)]), (3, 1, 3, "keep", "q", "a", [("d", 0, 1)])], "candidate_id int, at int, seq int, decision string, question string, answer string, evidence array<struct<doc_id:string,start:int,end:int>>")
    assert {r.candidate_id: r.edited for r in review.edited(candidates, log).collect()} == {1: False, 2: True, 3: True}


def test_terms_begin_words(spark):
    docs = spark.createDataFrame([(1, "flaws and throttling, AWS")], "doc_id int, text string")
    terms = spark.createDataFrame([("aws",), ("throttl",), ("laws",)], "term string")
    assert sorted(r.term for r in evalset.term_hits(docs, terms).collect()) == ["aws", "throttl"]


def test_answers(spark):
    rows = spark.createDataFrame([("Yes [2] and [9], `[1]`.", ["a", "b"])], "text string, chunk_ids array<string>")
    r = answers.answer_facts(rows, "The page does not say.").first()
    assert (r.citations, r.invalid_citations, r.cited_chunks, r.refused) == ([2], [9], ["b"], False)
    assert one(spark, s=tx.strip_citations(F.lit("Use `a[1]` [1] , then  x [2][3]."))).s == "Use `a[1]`, then x."


def test_completion_uses_the_cache_and_fails_offline(spark):
    asked = spark.createDataFrame([(1, "s", "p"), (2, "s", "p"), (3, "s", "q")], "id int, system string, prompt string")
    none = spark.createDataFrame([], "key string, text string")
    first = answers.complete(asked, none, lambda s, p: p.upper())
    assert sorted((r.id, r.text, r.cached) for r in first.collect()) == [(1, "P", False), (2, "P", False), (3, "Q", False)]
    again = answers.complete(asked, first.select("key", "text").distinct())
    assert all(r.cached for r in again.collect())
    with pytest.raises(Exception, match="not in the cache"):
        answers.complete(asked, none).collect()


def test_retries():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert answers.with_retries(call, wait=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(ValueError):
        answers.with_retries(lambda: (_ for _ in ()).throw(ValueError()), wait=lambda s: None)


def test_paraphrase_and_fabrication(spark):
    r = one(
        spark,
        a=tx.paraphrase_verdict(F.lit("Use BaseThing and x_y"), F.lit("x_y is used")),
        b=tx.paraphrase_verdict(F.lit("a  b"), F.lit("a b")),
        c=tx.paraphrase_verdict(F.lit("a b"), F.lit("b a")),
        d=tx.fabrication_problem(F.lit("It Was  so."), F.lit("it was so")),
        e=tx.fabrication_problem(F.lit("x"), F.lit("y")),
        f=tx.substitute(F.lit("one two one"), F.lit("one"), F.lit("1")),
        g=tx.substitute(F.lit("one two"), F.lit("one"), F.lit("1")),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("lost: BaseThing", "unchanged", "ok", "in context", None)
    assert (r.f.problem, r.g.text) == ("found 2", "1 two")


def test_grades_and_reports(spark):
    probes = spark.createDataFrame([(1, "supported", "faithful"), (1, "fabricated", "unfaithful"), (2, "supported", "invalid"), (2, "fabricated", "unfaithful")], "qid int, kind string, verdict string")
    graded = answers.grade(probes)
    assert report.paired_catch(graded).first().asDict() == {"n": 1, "caught": 1}
    with pytest.raises(Exception, match="differs"):
        report.reconcile(spark.createDataFrame([(0.5,)], "recall double"), 0.6, "recall").collect()


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x y.md").write_text("# X\n")
    (tmp_path / "b.txt").write_text("no")
    assert [(r.doc_id, r.markdown) for r in files.read_pages(spark, str(tmp_path)).collect()] == [("a/x y.md", "# X\n")]
    names = spark.createDataFrame([("docs/a.md",), ("docs/../a.md",), ("x.py",)], "path string")
    assert [r.path for r in files.wanted_paths(names, r"\.md$").collect()] == ["docs/a.md"]
    with pytest.raises(ValueError, match="digest"):
        files.require_digest(spark.createDataFrame([("a", "b")], "path string, content string"), "0")


def test_decision_stream(spark, tmp_path):
    log = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "keep"), (1, "2024-01-01 00:00:00", 2, "drop"), (2, "2024-01-02 00:00:00", 3, "keep")], "candidate_id long, at string, seq long, decision string").withColumn("at", F.to_timestamp("at"))
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    run = decisions.latest_decisions(stream).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r.candidate_id, r.decision) for r in spark.table("latest").collect()) == [(1, "drop"), (2, "keep")]


def test_as_of_section(spark):
    h = F.expr("array(named_struct('level',1,'title','t','anchor','t','offset',5), named_struct('level',2,'title','u','anchor','u','offset',9))")
    r = one(spark, a=pages.section_at(h, F.lit(4)), b=pages.section_at(h, F.lit(9)), c=pages.cite(F.lit("p"), pages.section_at(h, F.lit(8))), d=pages.cite(F.lit("p"), pages.section_at(h, F.lit(99))))
    assert r.a is None and r.b.anchor == "u" and r.c == "p" and r.d == "p#u"
