"""Steps whose rows, tasks or memory must not grow faster than their input."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftstone.functions import arrow, stats
from siftstone.operators import chunking, pages, retrieval


def test_dense_search_by_blocks(spark):
    """Blocks of any size give the ranking of all pairs: ties by position, null scores last, NaN first as in SQL."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(40)] + [(40, None), (41, [1.0, None, 0.0, 0.0]), (42, [1.0, 2.0]), (43, [float("nan")] * 4)]
    vectors = spark.createDataFrame(rows, "chunk_ix long, embedding array<float>")
    queries = vectors.where("chunk_ix in (3, 7, 11, 40)").select(F.concat(F.lit("q"), "chunk_ix").alias("qid"), F.col("embedding").alias("query"))

    def score(a, b):
        whole = a is not None and b is not None and len(a) == len(b) and None not in b
        return sum(x * y for x, y in zip(a, b)) if whole else None

    expected = set()
    for q in queries.collect():
        scored = [(i, score(q["query"], v)) for i, v in rows]
        order = sorted(scored, key=lambda x: (x[1] is None, -np.inf if x[1] != x[1] else -x[1] if x[1] is not None else 0, x[0]))
        expected |= {(q.qid, i, str(s), k + 1) for k, (i, s) in enumerate(order)}
    for k, block in ((44, 5), (6, 3), (6, 100)):
        found = retrieval.dense_search(vectors, queries, k, block=block).select("qid", "chunk_ix", "score", "rank").collect()
        assert {(*r[:2], str(r[2]), r[3]) for r in found} == {x for x in expected if x[3] <= k} and len(found) == 4 * k
    assert "ArrayTransform" not in (plan := retrieval.dense_search(vectors, queries, 6)._jdf.queryExecution().toString()) and "zip_with" not in plan
    assert retrieval.dense_search(vectors, queries.limit(0), 6).count() == 0


def test_nearest_other_by_blocks(spark):
    """Blocks of any size give the nearest of all pairs; the least id among equals, and null only beside nulls."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-1, 3, 3) + 0.5]) for i in range(60)] + [(60, None), (61, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v}

    def nearest(i):
        s = [(round(float(unit[i] @ unit[j]), 5), -j) for j in unit if j != i and i in unit and unit[i].size == unit[j].size]
        return (-max(s)[1], max(s)[0]) if s else (0, None)

    for block in (7, 100):
        found = retrieval.nearest_other(vectors, block)
        assert {r.vec_id: (r.other, r.similarity) for r in found.collect()} == {i: nearest(i) for i, _ in rows} and found.count() == len(rows)


def test_pairs_of_blocks_are_not_shuffled(spark):
    """All that is moved of pairs is a row for each vector and pair of blocks: the products are made below any exchange."""
    vectors = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    plan = retrieval.nearest_other(vectors, 10)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "CartesianProduct" in below and "Exchange" not in below


WORDS = "the a fox dog ran over it again and slept".split()


def _texts(n):
    rng = np.random.default_rng(n)
    return [(i, " ".join(rng.choice(WORDS, rng.integers(0, 9), p=np.arange(10, 0, -1) / 55))) for i in range(n)] + [(n, None)]


def _ranked(scores, k):
    return {(c, r + 1) for r, (c, _) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k])}


@pytest.mark.parametrize("tile", [20, 2_000_000])
def test_bm25_is_scored_where_chunks_are_read(spark, monkeypatch, tile):
    """Every query has its k rows, by score and position; the same by a shuffle, where queries are many."""
    monkeypatch.setattr(retrieval, "TILE", tile)
    texts = _texts(60)
    asked = [("q1", "fox the fox Dog"), ("q2", "the a"), ("q3", "nothing like it"), ("q4", "unknown"), ("q5", None)]
    corpus, queries = spark.createDataFrame(texts, "chunk_ix long, text string").repartition(3), spark.createDataFrame(asked, "qid string, text string")
    toks = {i: Counter((t or "").split()) for i, t in texts}
    df = Counter(w for c in toks.values() for w in c)
    raw = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else retrieval.FLOOR * sum(raw.values()) / len(raw) for w, x in raw.items()}
    mean = sum(c.total() for c in toks.values()) / len(texts)
    bm25 = lambda q, c: sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w in (q or "").lower().split() if c[w])
    expected = {(q, *x) for q, t in asked for x in _ranked({i: bm25(t, c) for i, c in toks.items()}, 7)}
    assert {(r.qid, r.chunk_ix, r.rank) for r in retrieval.bm25_search(corpus, queries, 7).collect()} == expected
    monkeypatch.setattr(retrieval, "HELD_QUERIES", 4)
    assert {(r.qid, r.chunk_ix, r.rank) for r in retrieval.bm25_search(corpus, queries, 7).collect()} == expected
    assert retrieval.bm25_search(corpus, queries.limit(0), 7).count() == 0


def test_bm25_writes_no_row_a_query_and_chunk(spark, monkeypatch):
    """What is written is a row a chunk, a word, and k rows a query, however many chunks match."""
    rows = []
    real = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: (out := real(df, name), rows.append(out.count()))[0])
    corpus = spark.range(300).select(F.col("id").alias("chunk_ix"), F.lit(" ".join(WORDS)).alias("text"))
    queries = spark.createDataFrame([(i, " ".join(WORDS)) for i in range(6)], "qid int, text string")
    assert retrieval.bm25_search(corpus, queries, 3).count() == 18
    assert max(rows) <= 300 and sum(rows) <= 300 + len(WORDS) + 18


def test_leaders_are_those_of_one_sort():
    rng = np.random.default_rng(1)
    for floor in (-np.inf, 0.0):
        best, ids = retrieval._Leaders(4, 3, floor), rng.permutation(200)
        best.most = 5
        scores = rng.integers(-2, 4, (200, 4)).astype(float)
        for lo in range(0, 200, 9):
            best.add(ids[lo : lo + 9], scores[lo : lo + 9])
        query, found, score = best.rows()
        for q in range(4):
            expected = sorted(((-s, i) for s, i in zip(scores[:, q], ids) if s > floor))[:3]
            assert [(-s, i) for s, i in zip(score[query == q], found[query == q])] == expected


def test_sections_are_scored_where_they_are_read(spark, monkeypatch):
    """Positive scores only, over distinct query terms without stop words; the same by a shuffle, where queries are many."""
    texts = _texts(60)
    asked = [("q1", "fox the fox Dog"), ("q2", "the a"), ("q3", "over slept again"), ("q4", "unknown")]
    sections, queries = spark.createDataFrame(texts, "chunk_ix long, text string").repartition(3), spark.createDataFrame(asked, "qid string, text string")
    toks = {i: Counter((t or "").split()) for i, t in texts}
    df = Counter(w for c in toks.values() for w in c)
    score = lambda q, c: sum(math.log1p(c[w]) * math.log1p(len(texts) / df[w]) for w in set(q.lower().split()) - set(retrieval.STOP_WORDS) if c[w])
    scores = {q: {i: score(t, c) for i, c in toks.items()} for q, t in asked}
    expected = {(q, *x) for q in scores for x in _ranked({i: s for i, s in scores[q].items() if s > 0}, 7)}
    rows = []
    real = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: (rows.append(name), real(df, name))[1])
    assert {(r.qid, r.chunk_ix, r.rank) for r in retrieval.section_search(sections, queries, 7).collect()} == expected
    assert rows == ["tokens", "ranking"]
    monkeypatch.setattr(retrieval, "HELD_QUERIES", 3)
    assert {(r.qid, r.chunk_ix, r.rank) for r in retrieval.section_search(sections, queries, 7).collect()} == expected


def test_texts_are_not_shuffled_for_a_few_ranked_rows(spark):
    """The reranker's texts are read where they lie: a row of the ranking goes to them."""
    ranking = spark.createDataFrame([(1, c, 1.0, c + 1) for c in range(5)], "qid int, chunk_ix long, score double, rank int")
    corpus = spark.range(50).select(F.col("id").alias("chunk_ix"), F.lit("a fox").alias("text"))
    queries = spark.createDataFrame([(1, "a fox")], "qid int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.rerank(ranking, corpus, queries, retrieval.overlap_scorer, 5, 3)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert [r.chunk_ix for r in found.orderBy("rank").collect()] == [0, 1, 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 9, 1000, 70_000])
def test_samples_are_those_of_the_standard_generator(n):
    """Integers and floats, added up as Python does, from arrays of draws."""
    values = [random.Random(n).random() for _ in range(n)]
    for own in (pd.Series(values), pd.Series([int(x > 0.5) for x in values], dtype="int32")):
        rng, plain = random.Random(4), own.tolist()
        assert stats.resampled_means(own, 5, 4) == [sum(plain[rng.randrange(n)] for _ in range(n)) / n for _ in range(5)]


@pytest.mark.parametrize("held", [0, 128])
def test_hashed_draws_are_made_by_all_tasks(spark, monkeypatch, held):
    """Draws of one group are dealt out; values come from blocks, held by tasks or met by a shuffle."""
    for k, v in (("PACK", 4), ("PLACES", 3), ("HELD_BLOCKS", held)):
        monkeypatch.setattr(stats, k, v)
    values = {"a": [float(x % 7) for x in range(31)], "b": [1.0, 0.0, 4.0]}
    rows = spark.createDataFrame([(g, i, x) for g, xs in values.items() for i, x in enumerate(xs)], "g string, i int, x double")
    found = stats.bootstrap_hashed(rows, "g", "x", "i", 80)

    def interval(g, xs):
        at = lambda d, i: int(hashlib.md5(f"{g}|{d}|{i}".encode()).hexdigest()[:12], 16) % len(xs)
        means = sorted(round(sum(xs[at(d, i)] for i in range(len(xs))) / len(xs), 9) for d in range(80))
        return means[2], means[77]

    assert {r.g: (r.lo, r.hi) for r in found.collect()} == {g: interval(g, xs) for g, xs in values.items()}
    assert "RoundRobinPartitioning(12)" in found._jdf.queryExecution().toString()


def test_parts_of_batches_are_small():
    """All rows once and in order, few at a time, and no more bytes than one text has where it is long."""
    rng = np.random.default_rng(0)
    texts = [None if x < 100 else "é" * int(x) for x in rng.integers(0, 60_000, 700)] + ["x" * 5_000_000, ""] + ["y"] * 1000
    batches = pa.Table.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]).to_batches(900)
    found = list(arrow.parts(batches, "text"))
    assert [x for p in found for x in p["doc_id"].to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= arrow.ROWS and (p.num_rows == 1 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) <= arrow.BYTES) for p in found)
    assert len(found) < 60 and not list(arrow.parts([], "text"))


@pytest.mark.parametrize("step", ["fixed", "sections", "lines", "render"])
def test_pages_are_read_some_at_a_time(spark, monkeypatch, step):
    """Rows are handed on before the next pages of a batch are read, and are the same by parts of any size."""
    texts = [(f"d{i}", "# T\n" + "word " * (i % 5) + "\n\n## U\nx" * (i % 3)) for i in range(40)] + [("e", "")]
    docs = spark.createDataFrame(texts, "doc_id string, text string").coalesce(1)
    headed = docs.withColumn("headings", F.expr("array(named_struct('offset', 0))"))
    run = {"fixed": lambda: chunking.fixed_chunks(docs, 3, 1), "sections": lambda: chunking.section_chunks(headed, most=4, overlap=1), "lines": lambda: pages.line_headings(docs), "render": lambda: pages.render(docs.withColumnRenamed("text", "markdown"))}[step]
    seen = []

    def counted(self, func, schema, *rest):
        def small(batches):
            arrow.ROWS = 3
            sizes = [b["doc_id"].value_counts() for b in func(batches)]
            yield pa.RecordBatch.from_arrays([pa.array([max((len(x) for x in sizes), default=0)]), pa.array([len(sizes)])], ["most", "n"])

        seen.append(real(self, small, "most long, n long", *rest))
        return real(self, func, schema, *rest)

    kind = type(docs)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", counted)
    found = run()
    assert found.count() >= 40
    most, n = seen[-1].agg(F.max("most"), F.sum("n")).first()
    assert most <= 3 and n >= 14
