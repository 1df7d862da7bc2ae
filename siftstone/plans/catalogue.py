"""Queries over the supplied tables, one or more for each operator, with DuckDB SQL where SQL has the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import stats, text as tx
from siftstone.operators import answers, chunking, evalset, pages, report, retrieval, review, scoring
from siftstone.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_ix"), "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, whole, as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


# ------------------------------------------------------------------ retrieval

_TOK = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
_BM25 = f"""
WITH d AS (SELECT doc_id AS chunk_ix, {_TOK} AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
tf AS (SELECT chunk_ix, dl, tok, count(*) AS tf FROM (SELECT chunk_ix, len(toks) AS dl, unnest(toks) AS tok FROM d) GROUP BY ALL),
raw AS (SELECT tok, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY tok),
idf AS (SELECT tok, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT item_id AS qid, {{text}} AS text FROM benchmark),
qt AS (SELECT qid, tok, count(*) AS times FROM (SELECT qid, unnest({_TOK}) AS tok FROM q) GROUP BY ALL),
sc AS (SELECT qid, chunk_ix, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (tok) JOIN idf USING (tok), st GROUP BY ALL),
al AS (SELECT qid, d.chunk_ix, round(coalesce(score, 0), 9) AS score FROM q CROSS JOIN d LEFT JOIN sc USING (qid, chunk_ix)),
bm AS (SELECT qid, chunk_ix, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_ix) AS rank FROM al)
"""


@query(_BM25.format(text="text") + "SELECT qid, chunk_ix, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    found = retrieval.bm25_search(corpus(spark, sf_dir), items(spark, sf_dir), 10)
    return found.select("qid", "chunk_ix", F.round("score", 6).alias("score"), "rank")


_EV = "ev AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0)"


def _gold(spark, sf_dir) -> DataFrame:
    """The first document that holds each item, whole, is its evidence."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote"))
    found = evalset.locate_exact(table(spark, sf_dir, "documents"), quotes)
    return found.select("qid", "doc_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"), F.lit(0).alias("any")).withColumn("ev_ix", F.row_number().over(_by("qid", "doc_id")).cast("long")).where("ev_ix = 1").drop("any")


def _by(key, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def _ranked(ranking: DataFrame, spark, sf_dir) -> DataFrame:
    found = corpus(spark, sf_dir).join(retrieval.small(ranking), "chunk_ix")
    tokens = F.size(F.regexp_extract_all("text", F.lit(r"[^ \n\t\r]+"), F.lit(0)))
    return found.select(*ranking.columns, F.col("chunk_ix").alias("doc_id"), F.lit(0).alias("start"), F.length("text").alias("end"), tokens.alias("tokens"))


_RUN = """,
g AS (SELECT qid, min(doc_id) AS doc_id FROM ev GROUP BY qid),
tk AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\n\\t\\r]+')) AS tokens FROM documents),
rk AS (SELECT bm.qid, rank, chunk_ix, sum(tokens) OVER (PARTITION BY bm.qid ORDER BY rank) AS running FROM bm JOIN tk ON tk.doc_id = bm.chunk_ix WHERE rank <= 20),
bu AS (SELECT * FROM rk WHERE rank = 1 OR running <= 2500),
s AS (SELECT g.qid, min(CASE WHEN rk.rank <= 10 THEN rk.rank END) AS first, any_value(b.n) AS budget, bool_or(coalesce(rk.running <= 2500 OR rk.rank = 1, false)) AS fits FROM g LEFT JOIN rk ON rk.qid = g.qid AND rk.chunk_ix = g.doc_id LEFT JOIN (SELECT qid, count(*) AS n FROM bu GROUP BY qid) b ON b.qid = g.qid GROUP BY g.qid),
m AS (SELECT count(*) AS n, sum((coalesce(first, 99) <= 5)::INT)::DOUBLE AS k, avg(coalesce(1.0 / first, 0)) AS mrr, avg(fits::INT) AS fits, avg(budget) AS budget FROM s)
"""


@query(
    _BM25.format(text="text") + "," + _EV + _RUN + """
SELECT n, round(k / n, 6) AS recall5, round(greatest(0.0, (k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) AS recall5_lo,
round(least(1.0, (k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) AS recall5_hi, round(mrr, 6) AS mrr10, round(k / n, 6) AS all_evidence5,
round(k / n, 6) AS recall5_any_overlap, round(fits, 6) AS recall_budget, round(budget, 6) AS budget_chunks_mean FROM m"""
)
def bm25_recall(spark, sf_dir):
    """Whole items find the first document that holds them: every column of a run's summary."""
    gold = _gold(spark, sf_dir)
    ranked = _ranked(retrieval.bm25_search(corpus(spark, sf_dir), items(spark, sf_dir), 20), spark, sf_dir)
    scored = scoring.score_questions(gold.select("qid").distinct(), ranked, gold)
    summary = scoring.summarise(scored.withColumn("run", F.lit("bm25")), "run").drop("run")
    return summary.select("n", *(F.round(c, 6).alias(c) for c in summary.columns if c != "n"))


_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


@query(
    f"""
WITH d AS (SELECT doc_id AS chunk_ix, unnest({_TOK}) AS tok FROM documents),
tf AS (SELECT chunk_ix, tok, count(*) AS tf FROM d WHERE length(tok) > 1 AND tok NOT IN ({_STOP}) GROUP BY ALL),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
q AS (SELECT DISTINCT item_id AS qid, unnest({_TOK}) AS tok FROM benchmark),
sc AS (SELECT qid, chunk_ix, round(sum(ln(1 + tf) * ln(1 + (SELECT count(*) FROM documents) / df)), 9) AS score FROM q JOIN tf USING (tok) JOIN df USING (tok) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_ix) AS rank FROM sc WHERE score > 0)
SELECT qid, chunk_ix, round(score, 6) AS score, rank FROM r WHERE rank <= 8"""
)
def keyword_section_search(spark, sf_dir):
    found = retrieval.section_search(corpus(spark, sf_dir), items(spark, sf_dir), 8)
    return found.select("qid", "chunk_ix", F.round("score", 6).alias("score"), "rank")


_DENSE = """
dq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT qid, vec_id AS chunk_ix, round(list_dot_product(v, embedding::DOUBLE[]), 6) AS score FROM dq, embeddings),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_ix) AS rank FROM ds)
"""


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("chunk_ix"), "embedding"), rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


@query("WITH " + _DENSE + "SELECT qid, chunk_ix, score, rank FROM dr WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return retrieval.dense_search(*_vectors(spark, sf_dir), 10).select("qid", "chunk_ix", "score", "rank")


@query(
    """
WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 5) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, other, similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, other) = 1"""
)
def nearest_other(spark, sf_dir):
    return retrieval.nearest_other(table(spark, sf_dir, "embeddings"))


_FUSE = """
u AS (SELECT qid, chunk_ix, rank, 0 AS li FROM bm WHERE rank <= 50 UNION ALL SELECT qid, chunk_ix, rank, 1 FROM dr WHERE rank <= 50),
f AS (SELECT qid, chunk_ix, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(li * 1000 + rank) AS first FROM u GROUP BY ALL),
fr AS (SELECT qid, chunk_ix, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first % 1000, first // 1000) AS rank FROM f)
"""
# Vectors are not keyed to documents; vec_id is taken as doc_id, and the vector of an item's id as its query, to exercise the dataflow only.
_ITEM_DENSE = _DENSE.replace("WHERE vec_id % 50 = 0", "WHERE vec_id IN (SELECT item_id FROM benchmark)")


def _hybrid_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    queries = items(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.join(queries, F.col("vec_id") == F.col("qid"), "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return queries, vectors.select(F.col("vec_id").alias("chunk_ix"), "embedding"), asked


@query(_BM25.format(text="text") + "," + _ITEM_DENSE + "," + _FUSE + "SELECT qid, chunk_ix, round(score, 9) AS score, rank FROM fr WHERE rank <= 10")
def hybrid_topk(spark, sf_dir):
    queries, vectors, asked = _hybrid_sides(spark, sf_dir)
    return retrieval.hybrid_search(corpus(spark, sf_dir), queries, vectors, asked, 10).select("qid", "chunk_ix", F.round("score", 9).alias("score"), "rank")


@query(
    _BM25.format(text="text") + "," + _ITEM_DENSE + "," + _FUSE + f""",
qs AS (SELECT qid, list_distinct({_TOK}) AS qt FROM q),
rr AS (SELECT fr.qid, chunk_ix, fr.rank AS before, round(len(list_intersect(qt, toks)) / greatest(len(qt), 1), 9) AS score FROM fr JOIN d USING (chunk_ix) JOIN qs ON qs.qid = fr.qid WHERE fr.rank <= 20)
SELECT qid, chunk_ix, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM rr QUALIFY rank <= 10"""
)
def rerank_topk(spark, sf_dir):
    """The hybrid's first twenty, re-ordered."""
    queries, vectors, asked = _hybrid_sides(spark, sf_dir)
    return retrieval.hybrid_rerank(corpus(spark, sf_dir), queries, vectors, asked, retrieval.overlap_scorer).select("qid", "chunk_ix", "score", "rank")


# ------------------------------------------------------------- chunks, spans

_PIECES = """
p AS (SELECT doc_id, unnest(pc) AS piece, generate_subscripts(pc, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n\\t\\r]+|[ \\n\\t\\r]+') AS pc FROM documents)),
o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM p),
t AS (SELECT doc_id, stop - length(piece) AS start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS tok, count(*) OVER (PARTITION BY doc_id) AS total FROM o WHERE NOT regexp_matches(piece, '^[ \\n\\t\\r]'))
"""


@query(
    "WITH " + _PIECES + """,
w AS (SELECT doc_id, n, start, stop FROM t, range(0, 10000) r(n) WHERE tok >= n * 450 AND tok < n * 450 + 500 AND (n = 0 OR n * 450 + 50 < total))
SELECT 'fixed:' || doc_id || ':' || n AS chunk_id, doc_id, n::INT AS n, min(start)::INT AS "start", max(stop)::INT AS "end", count(*)::INT AS n_tokens FROM w GROUP BY doc_id, n""".replace("range(0, 10000)", "range(0, (SELECT 1 + max(total) // 450 FROM t))")
)
def fixed_chunks(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"))


@query()
def section_chunks(spark, sf_dir):
    """Lines as headings: every document is one level-1 heading and its lines, packed greedily."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    one = docs.withColumn("headings", F.expr("array(named_struct('level', 1, 'title', '', 'anchor', '', 'offset', 0))"))
    return chunking.section_chunks(one, most=100, overlap=10)


_LINES = """
l AS (SELECT doc_id, unnest(ln) AS line, generate_subscripts(ln, 1) - 1 AS ix FROM (SELECT doc_id, string_split(text, chr(10)) AS ln FROM documents)),
h AS (SELECT doc_id, ix, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ix) - length(line) - 1 AS "start" FROM l),
s AS (SELECT doc_id, ix, h."start", coalesce(lead(h."start") OVER (PARTITION BY doc_id ORDER BY ix), length(text)) AS "end", substr(line, 1, 40) AS title FROM h JOIN documents USING (doc_id))
"""


@query("WITH " + _LINES + """SELECT doc_id, ix::INT AS ix, 'l' || ix AS anchor, title, CASE WHEN ix = 0 THEN 1 ELSE 2 END::INT AS level, "start"::INT AS "start", "end"::INT AS "end", doc_id || '#l' || ix AS key FROM s""")
def sectionise(spark, sf_dir):
    return pages.sections(pages.line_headings(table(spark, sf_dir, "documents"))).select("doc_id", "ix", "anchor", "title", "level", "start", "end", "key")


@query(
    "WITH " + _LINES + """, e AS (SELECT item_id AS qid, d.doc_id, strpos(d.text, b.text) - 1 AS pos FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0)
SELECT qid, e.doc_id, pos::INT AS "at", 'l' || max(ix) AS anchor, 'u/' || e.doc_id || CASE WHEN max(ix) = 0 THEN '' ELSE '#l' || max(ix) END AS url FROM e JOIN s ON s.doc_id = e.doc_id AND s."start" <= pos GROUP BY qid, e.doc_id, pos"""
)
def section_at(spark, sf_dir):
    found = evalset.locate_exact(table(spark, sf_dir, "documents"), _quotes(spark, sf_dir))
    marked = found.join(pages.line_headings(table(spark, sf_dir, "documents")).drop("text"), "doc_id").withColumn("h", pages.section_at(F.col("headings"), F.col("start")))
    return marked.select("qid", "doc_id", F.col("start").cast("int").alias("at"), F.col("h.anchor").alias("anchor"), pages.cite(F.concat(F.lit("u/"), "doc_id"), F.col("h")).alias("url"))


def _quotes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote"))


@query('SELECT item_id AS qid, doc_id, (strpos(d.text, b.text) - 1)::INT AS "start", (strpos(d.text, b.text) - 1 + length(b.text))::INT AS "end" FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0')
def evidence_locate(spark, sf_dir):
    return evalset.locate_exact(table(spark, sf_dir, "documents"), _quotes(spark, sf_dir))


_LOOSE = "regexp_replace(regexp_replace({0}, '[\\x22''`*“”‘’]', '', 'g'), '\\s+', ' ', 'g')"


@query(f"WITH b AS (SELECT item_id, trim({_LOOSE.format('text')}) AS t FROM benchmark), d AS (SELECT doc_id, {_LOOSE.format('text')} AS t FROM documents) SELECT item_id AS qid, doc_id FROM b JOIN d ON strpos(d.t, b.t) > 0")
def evidence_locate_loose(spark, sf_dir):
    """Items with other white space and quotation marks are looked for in all documents."""
    altered = _quotes(spark, sf_dir).withColumn("quote", F.concat(F.lit("“"), F.regexp_replace("quote", " ", "  "), F.lit("”")))
    return evalset.locate_loose(table(spark, sf_dir, "documents"), altered).select("qid", "doc_id")


@query(
    "WITH " + _PIECES + """,
c AS (SELECT doc_id, tok // 100 AS n, min(start) AS cs, max(stop) AS ce FROM t GROUP BY ALL),
e AS (SELECT item_id AS qid, d.doc_id, strpos(d.text, b.text) - 1 AS es, length(b.text) AS len FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0)
SELECT qid, e.doc_id, n::INT AS n FROM e JOIN c USING (doc_id) WHERE least(ce, es + len) - greatest(cs, es) >= 0.5 * len"""
)
def evidence_cover(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.fixed_chunks(docs, 100, 0)
    found = evalset.locate_exact(docs, _quotes(spark, sf_dir)).select("qid", "doc_id", F.col("start").alias("es"), F.col("end").alias("ee"))
    return chunks.join(found, "doc_id").where(scoring.covers(F.col("start"), F.col("end"), F.col("es"), F.col("ee"))).select("qid", "doc_id", "n")


@query(
    """
WITH r AS (SELECT conv_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, length(text) AS tokens FROM conversations),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank) AS running FROM r)
SELECT qid, rank, running::BIGINT AS running FROM s WHERE rank = 1 OR running <= 400"""
)
def budget_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    ranked = rows.select(F.col("conv_id").alias("qid"), F.row_number().over(_by("conv_id", "turn")).cast("long").alias("rank"), F.length("text").alias("tokens"))
    return scoring.within_budget(ranked, 400).select("qid", "rank", "running")


@query(
    """
WITH s AS (SELECT qid, doc_id, "start", "start" + 40 AS "end" FROM (SELECT source AS qid, doc_id, (doc_id * 17) % 500 AS "start" FROM documents)),
m AS (SELECT *, max("end") OVER (PARTITION BY qid ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT qid, min("start") AS "start", max("end") AS "end" FROM i GROUP BY qid, island"""
)
def merge_spans(spark, sf_dir):
    start = (F.col("doc_id") * 17) % 500
    spans = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), start.alias("start"), (start + 40).alias("end"))
    return evalset.merge_spans(spans, "qid")


# ----------------------------------------------------------------- statistics


def _labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("text", "n_chars"), "doc_id")


_WILSON = "round(greatest(0.0, (k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 8) AS lo, round(least(1.0, (k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 8) AS hi"


@query(f"SELECT lang, n, k, round(k / n, 8) AS rate, {_WILSON} FROM (SELECT lang, count(*) AS n, sum(quality)::BIGINT AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def wilson_by_group(spark, sf_dir):
    rows = report.rate(_labelled(spark, sf_dir).withColumn("good", F.col("quality") == 1), "good", "lang")
    return rows.select("lang", "n", "k", *(F.round(c, 8).alias(c) for c in ("rate", "lo", "hi")))


@query(
    """
WITH c AS (SELECT lang, count(*) FILTER (quality = 0 AND toxic = 1) AS fixed, count(*) FILTER (quality = 1 AND toxic = 0) AS broken FROM labels JOIN documents USING (doc_id) GROUP BY lang),
f AS (SELECT i, sum(ln(greatest(i, 1))) OVER (ORDER BY i) AS lf FROM range(0, 100001) r(i)),
t AS (SELECT lang, fixed, broken, sum(exp(a.lf - b.lf - e.lf - (fixed + broken) * 0.6931471805599453)) AS tail FROM c JOIN f a ON a.i = fixed + broken JOIN f b ON b.i <= least(fixed, broken) JOIN f e ON e.i = fixed + broken - b.i GROUP BY ALL)
SELECT lang, fixed, broken, round(CASE WHEN fixed + broken = 0 THEN 1 ELSE least(1, 2 * tail) END, 8) AS p FROM t"""
)
def mcnemar_pairs(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    counts = rows.groupBy("lang").agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("fixed"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("broken"))
    return counts.select("lang", "fixed", "broken", F.round(stats.mcnemar_exact("broken", "fixed"), 8).alias("p"))


@query(
    """
WITH b AS (SELECT lang, quality::DOUBLE AS x, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM labels JOIN documents USING (doc_id)),
n AS (SELECT lang, count(*) AS n FROM b GROUP BY lang),
p AS (SELECT lang, d, ('0x' || substr(md5(concat_ws('|', lang, d, i)), 1, 12))::BIGINT % n AS j FROM b JOIN n USING (lang), range(0, 200) r(d)),
m AS (SELECT p.lang, d, round(avg(x), 9) AS m FROM p JOIN b ON b.lang = p.lang AND b.i = p.j GROUP BY ALL),
r AS (SELECT lang, m, row_number() OVER (PARTITION BY lang ORDER BY m, d) AS r FROM m)
SELECT lang, max(m) FILTER (r = 6) AS lo, max(m) FILTER (r = 195) AS hi FROM r GROUP BY lang"""
)
def bootstrap_ci(spark, sf_dir):
    return stats.bootstrap_hashed(_labelled(spark, sf_dir), "lang", "quality", "doc_id")


@query()
def bootstrap_ci_exact(spark, sf_dir):
    return stats.bootstrap_exact(_labelled(spark, sf_dir), "lang", "doc_id", "quality", draws=1000)


@query(
    """
WITH s AS (SELECT length(text) AS c, len(regexp_extract_all(text, '[^ \\n\\t\\r]+')) AS w FROM documents)
SELECT count(*) AS pages, sum(c)::BIGINT AS chars, sum(w)::BIGINT AS words, min(c) AS least, median(c) AS median, list_sort(list(c))[floor((count(*) - 1) * 0.9)::INT + 1] AS p90, max(c) AS most FROM s"""
)
def corpus_stats(spark, sf_dir):
    return report.corpus_stats(table(spark, sf_dir, "documents"))


@query("SELECT event_type, count(*) AS n, round(list_sort(list(value))[least(count(*), floor(count(*) * 0.5) + 1)::INT], 6) AS p50, round(list_sort(list(value))[least(count(*), floor(count(*) * 0.95) + 1)::INT], 6) AS p95 FROM events GROUP BY event_type")
def latency_ranks(spark, sf_dir):
    return report.latencies(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT b.bucket, count(h.c) AS n FROM range(0, 9) b(bucket) LEFT JOIN (SELECT least(len(regexp_extract_all(text, '[^ \\n\\t\\r]+')) // 100, 8) AS c FROM documents) h ON h.c = b.bucket GROUP BY b.bucket")
def capped_histogram(spark, sf_dir):
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \n\t\r]+"), F.lit(0)))
    return report.capped_histogram(table(spark, sf_dir, "documents").select(F.floor(words / 100).alias("v")), "v")


@query("SELECT lang, count(*) FILTER (toxic = 1) AS yes, count(*) FILTER (toxic <> 1) AS no FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def verdict_matrix(spark, sf_dir):
    return report.matrix(_labelled(spark, sf_dir).withColumn("bad", F.col("toxic") == 1), "bad", "lang")


@query("SELECT event_type AS model, count(*) AS calls, sum(user_id)::BIGINT AS input_tokens, sum(event_id)::BIGINT AS output_tokens, round((sum(user_id) * 2.0 + sum(event_id) * 8.0) / 1e6, 6) AS cost FROM events WHERE user_id % 3 <> 0 GROUP BY event_type")
def token_cost(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 3 == 0).alias("cached"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    kinds = ("click", "error", "purchase", "signup", "view")
    return report.usage(calls, dict.fromkeys(kinds, (2.0, 8.0))).withColumn("cost", F.round("cost", 6))


# ---------------------------------------------------------------- evaluation set


@query("SELECT t.term, doc_id FROM documents, (VALUES ('the'), ('hav'), ('was'), ('idiot')) t(term) WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])' || t.term)")
def term_hits(spark, sf_dir):
    terms = spark.createDataFrame([("the",), ("hav",), ("was",), ("idiot",)], "term string")
    return evalset.term_hits(table(spark, sf_dir, "documents"), terms)


@query(
    """
WITH bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents),
x AS (SELECT item_id, i, w[i:i + 3] AS g FROM bw, range(1, 100000) r(i) WHERE i + 3 <= len(w)),
y AS (SELECT doc_id, j, w[j:j + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS j FROM dw WHERE len(w) >= 4)),
m AS (SELECT item_id, doc_id, i - j AS dg, i - row_number() OVER (PARTITION BY item_id, doc_id, i - j ORDER BY i) AS run FROM x JOIN y USING (g))
SELECT item_id, doc_id, max(n) + 3 AS run FROM (SELECT item_id, doc_id, dg, run, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL""".replace("FROM bw, range(1, 100000) r(i) WHERE i + 3 <= len(w)", "FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM bw WHERE len(w) >= 4)")
)
def longest_shared_run(spark, sf_dir):
    """Every item against every document: runs of four words or more."""
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a_id"), "text")
    right = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("b_id"), "text")
    return evalset.longest_shared_run(left, right).select(F.col("a_id").alias("item_id"), F.col("b_id").alias("doc_id"), "run")


@query(
    """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) AS round FROM documents)
SELECT doc_id, source, round FROM r ORDER BY round, md5('7|' || source), source LIMIT 45"""
)
def round_robin_sample(spark, sf_dir):
    return evalset.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 45, 7).select("doc_id", "source", "round")


@query(
    "WITH " + _LINES + """,
pr AS (SELECT a.doc_id, a.ix AS a_ix, b.ix AS b_ix FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.ix - a.ix BETWEEN 1 AND 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('3|' || doc_id || '|' || a_ix || '|' || b_ix), a_ix, b_ix) AS r FROM pr)
SELECT doc_id, a_ix::INT AS a_ix, b_ix::INT AS b_ix FROM r WHERE r = 1 ORDER BY md5('3|' || doc_id), doc_id LIMIT 20"""
)
def pair_sample(spark, sf_dir):
    return evalset.neighbour_pairs(pages.sections(pages.line_headings(table(spark, sf_dir, "documents"))), 20, 3)


@query("WITH " + _LINES + """SELECT doc_id || '#l' || ix AS key FROM s WHERE "end" - "start" >= 400 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def eligible_sections(spark, sf_dir):
    found = pages.sections(pages.line_headings(table(spark, sf_dir, "documents")))
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    excluded = found.join(labelled, "doc_id", "left_semi").select("key")
    return evalset.eligible(found, excluded).select("key")


def _log(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "purchase", "keep").otherwise("drop")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("candidate_id"), F.date_trunc("second", "ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("decision"))


_LOG = "g AS (SELECT user_id AS candidate_id, date_trunc('second', ts) AS decided_at, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'keep' ELSE 'drop' END AS decision FROM events), lt AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY decided_at DESC, seq DESC) = 1)"


@query("WITH " + _LOG + " SELECT candidate_id, seq, decision FROM lt WHERE decision <> 'undo'")
def decision_latest(spark, sf_dir):
    return evalset.decided(_log(spark, sf_dir)).select("candidate_id", "seq", "decision")


@query("WITH " + _LOG + " SELECT c_custkey AS candidate_id FROM customer WHERE c_custkey NOT IN (SELECT candidate_id FROM lt WHERE decision <> 'undo')")
def undecided_anti(spark, sf_dir):
    return evalset.undecided(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id")), _log(spark, sf_dir))


@query("WITH " + _LOG + " SELECT decision, count(*) AS n FROM lt GROUP BY decision")
def status_funnel(spark, sf_dir):
    return evalset.latest(_log(spark, sf_dir), "candidate_id", "at", "seq").groupBy("decision").agg(F.count("*").alias("n"))


def _built(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    bench = table(spark, sf_dir, "benchmark")
    spans = evalset.locate_exact(docs, _quotes(spark, sf_dir)).join(bench.select(F.col("item_id").alias("qid"), F.col("text").alias("quote")), "qid")
    evidence = spans.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit("a").alias("anchor"), "quote"))).alias("evidence"))
    rows = bench.select(F.col("item_id").alias("qid"), "text").join(evidence, "qid", "left")
    shape = lambda df, origin: df.select(F.col("qid").alias("pos"), F.col("text").alias("question"), F.when(F.size("evidence") > 0, F.lit("yes")).alias("answer"), "evidence", F.lit(origin).alias("origin"), F.when(F.lit(origin == "generated"), F.concat(F.lit("c"), "qid")).alias("candidate_id"))
    empty = rows.where("evidence is null").withColumn("evidence", F.filter(F.array(F.struct(*(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "string"), ("start", "int"), ("end", "int"), ("anchor", "string"), ("quote", "string"))))), lambda e: e["doc_id"].isNotNull()))
    return evalset.build_questions(shape(rows.where("evidence is not null and qid % 2 = 0"), "generated"), shape(rows.where("evidence is not null and qid % 2 = 1"), "handwritten"), shape(empty, "written"))


@query(
    """
WITH e AS (SELECT item_id, count(*) AS n FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0 GROUP BY item_id),
r AS (SELECT b.item_id, text, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 2 ELSE b.item_id % 2 END AS src FROM benchmark b LEFT JOIN e USING (item_id))
SELECT printf('q%03d', row_number() OVER (ORDER BY src, item_id)) AS id, text AS question, n > 0 AS answerable, n::INT AS n_evidence, CASE WHEN n = 0 THEN 'unanswerable' WHEN n >= 2 THEN 'multi' ELSE 'single' END AS kind, ['generated', 'handwritten', 'written'][src + 1] AS origin FROM r"""
)
def question_build(spark, sf_dir):
    return _built(spark, sf_dir).select("id", "question", "answerable", F.size("evidence").alias("n_evidence"), "kind", "origin")


@query(
    """
WITH e AS (SELECT item_id, count(*) AS n FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0 GROUP BY item_id),
r AS (SELECT b.item_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 2 ELSE b.item_id % 2 END AS src FROM benchmark b LEFT JOIN e USING (item_id)),
q AS (SELECT printf('q%03d', row_number() OVER (ORDER BY src, item_id)) AS qid, n, (row_number() OVER (ORDER BY src, item_id)) AS k FROM r)
SELECT qid, 'quote drift' AS rule FROM q WHERE n > 0 AND k % 5 = 0 UNION ALL SELECT qid, 'missing answer' FROM q WHERE n > 0 AND k % 7 = 0"""
)
def validate_set(spark, sf_dir):
    """The built set with planted faults: shifted quotes and blank answers."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    k = F.substring("id", 2, 9).cast("int")
    shifted = F.transform("evidence", lambda e: F.struct(e["doc_id"], e["start"], e["end"], e["anchor"], F.concat(e["quote"], F.lit("x")).alias("quote")))
    built = _built(spark, sf_dir)
    planted = built.withColumn("evidence", F.when(k % 5 == 0, shifted).otherwise(F.col("evidence"))).withColumn("answer", F.when(k % 7 == 0, F.lit(" ")).otherwise(F.col("answer")))
    return evalset.validate(planted, docs)


# ------------------------------------------------------------------ texts

REFUSAL = "The documentation does not cover this."
_TURNS = "(SELECT conv_id, turn, text || ' See [' || (turn % 3 + 1) || '] and [' || (conv_id % 4 + 2) || ', 1] , not items[0] nor `x[9]`.' AS text, text AS plain, turn % 3 + 1 AS a, conv_id % 4 + 2 AS b FROM conversations)"


def _turns(spark, sf_dir) -> DataFrame:
    """Every turn, whole, with citations and code after it."""
    text = F.concat("text", F.lit(" See ["), F.col("turn") % 3 + 1, F.lit("] and ["), F.col("conv_id") % 4 + 2, F.lit(", 1] , not items[0] nor `x[9]`."))
    return table(spark, sf_dir, "conversations").withColumn("text", text)


@query(f"SELECT conv_id, turn, a || CASE WHEN b <> a THEN ',' || b ELSE '' END || CASE WHEN 1 NOT IN (a, b) THEN ',1' ELSE '' END AS cited, trim(plain, ' ' || chr(10) || chr(9) || chr(13)) || ' See and, not items[0] nor `x[9]`.' AS stripped FROM {_TURNS}")
def citations_parse(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(tx.citations("text").cast("array<string>"), ",").alias("cited"), tx.strip_citations("text").alias("stripped"))


_REPLY = "(SELECT conv_id, turn, role, CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN '**\"The documentation does not cover this\"**' WHEN 2 THEN text || ' The documentation does not cover this. ' ELSE 'THE documentation DOES not cover this...' END AS text FROM conversations)"
_WRAP = "chr(34) || chr(39) || '`* ' || chr(10) || chr(9)"
_REFUSED = f"lower(trim(rtrim(trim(text, {_WRAP}), '.'), {_WRAP})) = 'the documentation does not cover this'"


def _replies(spark, sf_dir) -> DataFrame:
    k = F.col("conv_id") % 4
    text = F.when(k == 0, F.col("text")).when(k == 1, F.lit('**"The documentation does not cover this"**')).when(k == 2, F.concat("text", F.lit(f" {REFUSAL} "))).otherwise(F.lit("THE documentation DOES not cover this..."))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))


@query(f"SELECT conv_id, turn, {_REFUSED} AS refused, contains(lower(text), 'the documentation does not cover this') AND NOT {_REFUSED} AS partial FROM {_REPLY}")
def refusal_flags(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", tx.is_refusal("text", REFUSAL).alias("refused"), tx.mentions_refusal("text", REFUSAL).alias("partial"))


@query(f"SELECT role, turn % 2 = 0 AS answerable, count(*) FILTER ({_REFUSED}) AS yes, count(*) FILTER (NOT {_REFUSED}) AS no FROM {_REPLY} GROUP BY ALL")
def refusal_matrix(spark, sf_dir):
    rows = _replies(spark, sf_dir).select("role", (F.col("turn") % 2 == 0).alias("answerable"), tx.is_refusal("text", REFUSAL).alias("refused"))
    return report.matrix(rows, "refused", "role", "answerable")


_IDENT = r"`[^`]+`|\b\w+(?:\.\w+)+\b|\b\w+\(|\b\w+=|\b[a-z0-9]+_\w+\b|--[\w-]+|@\w+|\b[A-Z][a-z0-9]+[A-Z]\w*\b|\b\d+(?:\.\d+)*\b"


@query(f"SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text || ' Call app.run( port=' || item_id || ') by `code`, --flag, @deco, BaseThing, snake_case, e.g. v1.' || item_id, '{_IDENT}')), lambda x: lower(x) NOT IN ('e.g', 'i.e'))), '|') AS tokens FROM benchmark")
def identifier_tokens(spark, sf_dir):
    text = F.concat("text", F.lit(" Call app.run( port="), "item_id", F.lit(") by `code`, --flag, @deco, BaseThing, snake_case, e.g. v1."), "item_id")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.identifiers(text), "|").alias("tokens"))


_JUDGED = "(SELECT *, (props->>'k')::INT AS k FROM events)"


def _judged(spark, sf_dir) -> DataFrame:
    """Judge replies of five kinds, made of every event's properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit('{"verdict": " Correct ", "reason": "r'), k, F.lit('", "claims": [{"claim": "a", "supported": true}]}')))
        .when(k % 5 == 1, F.concat(F.lit('{"verdict": "fine", "reason": "r'), k, F.lit('", "claims": [{"claim": "a", "supported": "yes"}]}')))
        .when(k % 5 == 2, F.concat(F.lit("not json "), k))
        .when(k % 5 == 3, F.lit('{"claims": []}'))
        .otherwise(F.lit('{"verdict": "partial", "claims": [{"claim": "a", "supported": true}, {"claim": "b", "supported": false}]}'))
    )
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.withColumn("c", tx.parse_correctness("raw")).withColumn("f", tx.parse_faithfulness("raw")).select("event_id", "c.verdict", "c.reason", "f.valid", "f.claims", tx.faithful(F.col("f")).alias("faithful"))


@query(f"SELECT event_id, CASE k % 5 WHEN 0 THEN 'correct' WHEN 4 THEN 'partial' ELSE 'invalid' END AS verdict, CASE k % 5 WHEN 0 THEN 'r' || k WHEN 1 THEN 'r' || k WHEN 2 THEN 'not json ' || k ELSE '' END AS reason, k % 5 IN (0, 3, 4) AS valid, k % 5 = 0 AS faithful FROM {_JUDGED}")
def judge_parse(spark, sf_dir):
    return _judged(spark, sf_dir).drop("claims")


@query(f"SELECT count(*) FILTER (k % 5 IN (1, 2, 3)) AS verdicts, count(*) FILTER (k % 5 IN (1, 2)) AS claim_lists FROM {_JUDGED}")
def unreadable_replies(spark, sf_dir):
    return answers.unreadable(_judged(spark, sf_dir))


@query(f"SELECT count(*) AS answers, sum(CASE k % 5 WHEN 0 THEN 1 WHEN 4 THEN 2 ELSE 0 END)::BIGINT AS claims, count(*) FILTER (k % 5 = 4) AS unsupported, count(*) FILTER (k % 5 = 0) AS all_supported FROM {_JUDGED} WHERE k % 5 IN (0, 3, 4)")
def claim_totals(spark, sf_dir):
    return report.claim_totals(_judged(spark, sf_dir).where("valid"))


@query(
    """
WITH t AS (SELECT conv_id, turn, turn % 3 + 1 AS a, conv_id % 4 + 2 AS b FROM conversations),
c AS (SELECT conv_id, turn, list_filter([a, b, CASE WHEN 1 IN (a, b) THEN NULL ELSE 1 END], lambda x: x IS NOT NULL) AS l, a = b AS same FROM t),
d AS (SELECT conv_id, turn, CASE WHEN same THEN l[1:1] || l[3:] ELSE l END AS l FROM c)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x: x <= 3), ',') AS citations, array_to_string(list_filter(l, lambda x: x > 3), ',') AS invalid, array_to_string(list_transform(list_filter(l, lambda x: x <= 3), lambda x: 'c' || x), ',') AS cited FROM d"""
)
def answer_facts(spark, sf_dir):
    """Every turn as an answer from three excerpts."""
    rows = _turns(spark, sf_dir).withColumn("chunk_ids", F.array(*(F.lit(f"c{k}") for k in (1, 2, 3))))
    facts = answers.answer_facts(rows, REFUSAL)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return facts.select("conv_id", "turn", text("citations").alias("citations"), text("invalid_citations").alias("invalid"), text("cited_chunks").alias("cited"))


@query("SELECT count(*) AS citing, count(*) FILTER (conv_id % 4 + 2 > 3) AS invalid, avg(length(text) + 1) AS context_tokens, 3.0::DOUBLE AS excerpts FROM conversations")
def answer_means(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("chunk_ids", F.array(*(F.lit(f"c{k}") for k in (1, 2, 3))))
    plain = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") + 1).alias("context_tokens"))
    return review.answer_means(answers.answer_facts(rows, REFUSAL).join(plain, ["conv_id", "turn"]))


@query(f"SELECT conv_id, turn, turn % 2 = 0 AS answerable, CASE WHEN turn % 2 = 0 AND {_REFUSED} THEN 'incorrect' END AS verdict, CASE WHEN turn % 2 = 0 AND NOT {_REFUSED} THEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) END AS judged_text FROM {_REPLY}")
def to_judge(spark, sf_dir):
    rows = _replies(spark, sf_dir).select("conv_id", "turn", (F.col("turn") % 2 == 0).alias("answerable"), tx.is_refusal("text", REFUSAL).alias("refused"), "text")
    return answers.to_judge(rows).select("conv_id", "turn", "answerable", "verdict", "judged_text")


_PROBES = "(SELECT event_id, user_id AS qid, CASE event_type WHEN 'click' THEN 'paraphrase' WHEN 'error' THEN 'substitution' WHEN 'purchase' THEN 'swap' WHEN 'signup' THEN 'supported' ELSE 'fabricated' END AS kind, CASE event_type WHEN 'click' THEN 'correct' WHEN 'error' THEN 'incorrect' WHEN 'purchase' THEN 'incorrect' WHEN 'signup' THEN 'faithful' ELSE 'unfaithful' END AS expected, ['correct', 'incorrect', 'faithful', 'unfaithful', 'invalid', 'partial'][event_id % 6 + 1] AS verdict FROM events)"


def _graded(spark, sf_dir) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for kv in {"click": "paraphrase", "error": "substitution", "purchase": "swap", "signup": "supported", "view": "fabricated"}.items() for x in kv))
    verdicts = F.array(*(F.lit(v) for v in ("correct", "incorrect", "faithful", "unfaithful", "invalid", "partial")))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("qid"), kinds[F.col("event_type")].alias("kind"), F.get(verdicts, (F.col("event_id") % 6).cast("int")).alias("verdict"))
    return answers.grade(rows)


@query(f"SELECT event_id, kind, expected, verdict, verdict = expected AS as_expected FROM {_PROBES}")
def probe_grading(spark, sf_dir):
    return _graded(spark, sf_dir).select("event_id", "kind", "expected", "verdict", "as_expected")


@query(f"SELECT count(*) AS n, count(*) FILTER (verdict = expected) AS rejected FROM {_PROBES} WHERE kind IN ('substitution', 'swap', 'fabricated')")
def planted_errors(spark, sf_dir):
    return review.planted_errors(_graded(spark, sf_dir))


@query(f"WITH p AS (SELECT *, verdict = expected AS good FROM {_PROBES}), s AS (SELECT qid FROM p WHERE kind = 'supported' AND good) SELECT count(*) AS n, count(*) FILTER (good) AS caught FROM p JOIN s USING (qid) WHERE kind = 'fabricated'")
def paired_catch(spark, sf_dir):
    return report.paired_catch(_graded(spark, sf_dir))


@query(f"SELECT kind, verdict, count(*) AS n FROM {_PROBES} GROUP BY ALL")
def probe_verdicts(spark, sf_dir):
    return report.counts(_graded(spark, sf_dir), "kind", "verdict")


_REWRITES = "(SELECT item_id AS qid, text AS reference, CASE item_id % 4 WHEN 0 THEN text || ' again' WHEN 1 THEN ' ' || text || '  ' WHEN 2 THEN 'other 9.9' END AS answer FROM benchmark)"


@query(f"SELECT qid, 'paraphrase' AS kind, CASE qid % 4 WHEN 0 THEN answer END AS answer, CASE qid % 4 WHEN 1 THEN 'unchanged' WHEN 3 THEN 'no rewrite' WHEN 2 THEN 'lost: 7' END AS problem FROM {_REWRITES}".replace("WHEN 0 THEN answer END AS answer", "WHEN 0 THEN reference || ' 7 again' END AS answer"))
def paraphrase_probes(spark, sf_dir):
    """Rewrites of every item, which is given the number 7: with it, unchanged, without it, and none."""
    reference = F.concat("text", F.lit(" 7"))
    k = F.col("item_id") % 4
    rewrite = F.when(k == 0, F.concat(reference, F.lit(" again"))).when(k == 1, F.concat(F.lit(" "), F.regexp_replace(reference, " ", "  "))).when(k == 2, F.lit("other 9.9"))
    raw = F.when(k == 3, F.lit("no json")).otherwise(F.to_json(F.struct(rewrite.alias("answer"))))
    return review.paraphrase_probes(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), reference.alias("reference"), raw.alias("raw")))


@query("SELECT item_id AS qid, 'fabricated' AS kind, CASE item_id % 4 WHEN 0 THEN text || ' A made up thing.' END AS answer, CASE item_id % 4 WHEN 1 THEN CASE WHEN contains(text, chr(10)) THEN 'several lines' ELSE 'in context' END WHEN 2 THEN 'several lines' WHEN 3 THEN 'none' END AS problem FROM benchmark")
def fabrication_probes(spark, sf_dir):
    k = F.col("item_id") % 4
    sentence = F.when(k == 0, F.lit("A made up thing.")).when(k == 1, F.upper(F.btrim("text"))).when(k == 2, F.lit("one\ntwo"))
    raw = F.to_json(F.struct(sentence.alias("sentence")))
    return review.fabrication_probes(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("reference"), F.concat(F.lit("Before. "), "text").alias("context"), raw.alias("raw")))


@query("SELECT item_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(strip_accents(replace(replace(replace(text, '`', ''), '*', ''), '_', '')), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_\\s-]', '', 'g')), '^\\s+|\\s+$', '', 'g')) AS base FROM benchmark".replace("AS base FROM benchmark", "AS base FROM benchmark").replace("SELECT item_id, trim(", "SELECT item_id, regexp_replace(trim(").replace(") AS base", "), '[-\\s]+', '-', 'g') AS slug"))
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tx.slugify("text").alias("slug"))


@query("SELECT item_id, CASE WHEN n = 1 THEN NULL ELSE 'found ' || n END AS problem, CASE WHEN n = 1 THEN replace(text, w, 'ZZ') END AS answer FROM (SELECT item_id, text, string_split(text, ' ')[2] AS w, ((length(text) - length(replace(text, w, ''))) // length(w))::INT AS n FROM benchmark)")
def probe_checks(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").withColumn("w", F.get(F.split("text", " "), 1))
    return bench.withColumn("s", tx.substitute("text", "w", F.lit("ZZ"))).select("item_id", F.col("s.problem").alias("problem"), F.col("s.text").alias("answer"))


@query("SELECT url, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("title"))


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[!/]?[A-Za-z][^<>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.html_text("html").alias("text"))


_PATHS = "(SELECT CASE WHEN doc_id = 0 THEN 'index.md' WHEN doc_id % 7 = 0 THEN source || '/' || doc_id || '/index.md' ELSE source || '/' || doc_id || '.md' END AS path, doc_id, source FROM documents)"


@query(f"SELECT path, CASE WHEN doc_id = 0 THEN 'https://docs.example/' ELSE 'https://docs.example/' || source || '/' || doc_id || '/' END AS url, CASE WHEN doc_id = 0 THEN 'home' WHEN source = 'src1' THEN 'generated' WHEN doc_id % 7 = 0 AND doc_id = 14 THEN 'one folder' END AS reason FROM {_PATHS}")
def page_urls(spark, sf_dir):
    """Every document as a page below its source; rules exclude a folder, a deeper folder and a page."""
    docs = table(spark, sf_dir, "documents")
    stem = F.concat("source", F.lit("/"), "doc_id")
    paths = docs.select(F.when(F.col("doc_id") == 0, "index.md").when(F.col("doc_id") % 7 == 0, F.concat(stem, F.lit("/index.md"))).otherwise(F.concat(stem, F.lit(".md"))).alias("doc_id"))
    folders = docs.where("doc_id = 14").select(F.lit(1).alias("rule_ix"), F.concat(stem, F.lit("/")).alias("prefix"), F.lit("one folder").alias("reason"))
    rules = spark.createDataFrame([(0, "src1/", "generated"), (2, "src1/1.md", "later"), (3, "index.md", "home")], "rule_ix int, prefix string, reason string")
    return pages.exclude(paths, rules.unionByName(folders)).select(F.col("doc_id").alias("path"), tx.page_url("doc_id", "https://docs.example/").alias("url"), "reason")


@query()
def page_render(spark, sf_dir):
    """Pages made of the supplied articles: a heading, their text with markup, and an include."""
    docs = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".md")).alias("doc_id"), F.concat(F.lit("# Page "), "doc_id", F.lit("\n\n/// note\n<b>"), F.regexp_replace("text", "[`~{<>/#]", ""), F.lit("</b>\n///\n\n## More\n\n{* src/a.py ln[1:2] *}\n")).alias("markdown"))
    held = spark.createDataFrame([("src/a.py", "a = 1\nb = 2\nc = 3\n")], "path string, content string")
    return pages.render(docs, held, "https://docs.example/").select("doc_id", "title", "text", F.to_json("headings").alias("headings"), "includes", "included_chars", "url")


@query(
    """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ln FROM documents), n AS (SELECT *, len(ln) AS n FROM l)
SELECT doc_id, CASE WHEN n < 4 THEN text ELSE array_to_string(['# Code above omitted 👆', '', ln[2], ln[3], '', '# Code here omitted 👈', '', ln[n - 1]] || ['', '# Code below omitted 👇'], chr(10)) END AS picked FROM n"""
)
def line_ranges(spark, sf_dir):
    """Of every document of four lines or more: the second and third line, and the last but one."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    n = F.size("lines")
    return lines.select("doc_id", F.array_join(tx.pick_lines(F.col("lines"), F.when(n >= 4, F.concat(F.lit("2:3, "), n - 1))), "\n").alias("picked"))


@query(
    _BM25.format(text="text") + "SELECT qid, string_agg('[' || rank || '] doc ' || chunk_ix || CASE chunk_ix % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE ' > part' END || chr(10) || 'u/' || chunk_ix || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) ORDER BY rank) AS context FROM bm JOIN documents ON doc_id = chunk_ix WHERE rank <= 3 GROUP BY qid"
)
def context_assembly(spark, sf_dir):
    """Whole documents as excerpts; every third has a section below level 1."""
    docs = corpus(spark, sf_dir)
    ranked = docs.join(retrieval.small(retrieval.bm25_search(docs, items(spark, sf_dir), 3)), "chunk_ix")
    section, level = F.when(F.col("chunk_ix") % 3 != 0, F.lit("part")), F.when(F.col("chunk_ix") % 3 == 1, 1).otherwise(2)
    heading = answers.excerpt_heading(F.concat(F.lit("doc "), "chunk_ix"), section, level, F.concat(F.lit("u/"), "chunk_ix"))
    return answers.assemble(ranked.select("qid", "rank", "chunk_ix", heading.alias("heading"), "text")).select("qid", "context")


@query("SELECT sha256(string_agg(path || ' ' || sha, chr(10) ORDER BY path)) AS digest, count(*) AS n FROM (SELECT lpad(doc_id::VARCHAR, 9, '0') AS path, sha256(text) AS sha FROM documents)")
def content_digest(spark, sf_dir):
    return files.content_digest(table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content")))


@query("SELECT conv_id, turn, turn % 2 = 0 AS cached, 'echo ' || length(text) AS text FROM conversations")
def cached_completion(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.concat("conv_id", F.lit(":"), "turn").alias("system"), F.col("text").alias("prompt"))
    held = turns.where("id.turn % 2 = 0").withColumn("model", F.lit("model")).select(tx.request_key("model", "system", "prompt").alias("key"), F.concat(F.lit("echo "), F.length("prompt")).alias("text"))
    done = answers.complete(turns, held, lambda s, p: f"echo {len(p)}")
    return done.select("id.conv_id", "id.turn", "cached", "text")


# -------------------------------------------------------------------- review


@query("SELECT 'largest' AS \"end\", place, doc_id, chars FROM (SELECT doc_id, length(text) AS chars, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS place FROM documents) WHERE place <= 5 UNION ALL SELECT 'smallest', place, doc_id, chars FROM (SELECT doc_id, length(text) AS chars, row_number() OVER (ORDER BY length(text), doc_id) AS place FROM documents) WHERE place <= 5")
def page_extremes(spark, sf_dir):
    return review.extremes(table(spark, sf_dir, "documents"))


@query(
    """
WITH s AS (SELECT source AS qid, greatest((doc_id * 17) % 500, 100) - 100 AS "start", least((doc_id * 17) % 500 + 40, 300) - 100 AS "end" FROM documents),
m AS (SELECT *, max("end") OVER (PARTITION BY qid ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE "start" < "end"),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT qid, min("start") AS "start", max("end") AS "end" FROM i GROUP BY qid, island"""
)
def clip_spans(spark, sf_dir):
    start = (F.col("doc_id") * 17) % 500
    spans = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), start.alias("start"), (start + 40).alias("end"), F.lit(100).cast("long").alias("lo"), F.lit(300).cast("long").alias("hi"))
    return review.clip_spans(spans, "qid")


@query("SELECT 'c' || item_id AS candidate_id, CASE item_id % 5 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'skipped_by_model' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'evidence_not_verbatim' ELSE 'ok' END AS status FROM benchmark")
def candidate_funnel(spark, sf_dir):
    """Items as sections, with replies made for each status."""
    bench = table(spark, sf_dir, "benchmark")
    quote = F.when(F.col("item_id") % 5 == 3, F.lit("nowhere to be found")).otherwise(F.substring("text", 1, 40))
    reply = F.to_json(F.struct((F.col("item_id") % 5 == 1).alias("skip"), F.lit("q").alias("question"), F.when(F.col("item_id") % 5 != 2, F.lit("a")).alias("answer"), F.array(quote).alias("evidence")))
    candidates = bench.select(F.concat(F.lit("c"), "item_id").alias("candidate_id"), F.when(F.col("item_id") % 5 == 0, F.lit("{oops")).otherwise(reply).alias("raw"), F.array(F.col("item_id").cast("string")).alias("keys"))
    return review.candidate_status(candidates, bench.select(F.col("item_id").cast("string").alias("key"), "text"))


@query("WITH " + _LOG + " SELECT count(*) AS decided, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'drop') AS dropped FROM lt WHERE decision <> 'undo'")
def review_progress(spark, sf_dir):
    return review.progress(_log(spark, sf_dir))


@query("WITH e AS (SELECT item_id FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0 GROUP BY item_id) SELECT count(*) AS n, count(*) FILTER (item_id % 2 = 0) AS hits FROM e")
def citation_hits(spark, sf_dir):
    """Every found item is answered; the even ones cite the document that holds them, the others one that doesn't."""
    docs = table(spark, sf_dir, "documents")
    gold = _gold(spark, sf_dir).select("qid", "doc_id", "e_start", "e_end")
    cited = gold.select("qid", F.array(F.when(F.col("qid") % 2 == 0, F.col("doc_id")).otherwise(F.lit(-1))).alias("cited_chunks"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("start"), F.length("text").alias("end"))
    return review.citation_hits(cited, chunks, gold)


@query("SELECT item_id, (strpos(text, ' '))::INT AS \"start\", (strpos(text, ' ') + 10)::INT AS \"end\" FROM benchmark WHERE substr(text, strpos(text, ' ') + 1, 10) = trim(substr(text, strpos(text, ' ') + 1, 10), ' ' || chr(10))")
def selection_spans(spark, sf_dir):
    """Ten characters selected after the first space; odd items give offsets that are one off."""
    bench = table(spark, sf_dir, "benchmark").withColumn("at", F.instr("text", " "))
    rows = bench.withColumn("selected", F.substring("text", F.col("at") + 1, F.lit(10))).where(F.col("selected") == F.btrim("selected", F.lit(" \n")))
    off = F.col("at") + F.when(F.col("item_id") % 2 == 1, 1).otherwise(0)
    return rows.withColumn("s", review.selection_span("text", off, off + 10, "selected")).select("item_id", "s.start", "s.end")


# ------------------------------------------------------------- paired runs

_LF = "f AS (SELECT i, sum(ln(greatest(i, 1))) OVER (ORDER BY i) AS lf FROM range(0, 100001) r(i))"
_P = "round(CASE WHEN fixed + broken = 0 THEN 1 ELSE least(1, 2 * sum(exp(a.lf - b.lf - e.lf - (fixed + broken) * 0.6931471805599453))) END, 8) AS p"
_ON = "JOIN f a ON a.i = fixed + broken JOIN f b ON b.i <= least(fixed, broken) JOIN f e ON e.i = fixed + broken - b.i"


def _runs(spark, sf_dir) -> DataFrame:
    """Three runs over the labelled documents: by quality, by the lack of toxicity, and by both."""
    rows = table(spark, sf_dir, "labels")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    parts = [rows.select(F.lit(name).alias("run"), F.col("doc_id").alias("qid"), hit.alias("hit5"), (1 / (1 + F.col("doc_id") % k)).alias("rr")) for name, hit, k in (("q", good, 3), ("t", clean, 4), ("m", good & clean, 5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH c AS (SELECT count(*) FILTER (quality <> 1 AND toxic = 0) AS fixed, count(*) FILTER (quality = 1 AND toxic <> 0) AS broken FROM labels), {_LF} SELECT fixed, broken, {_P} FROM c {_ON} GROUP BY fixed, broken")
def discordant_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return scoring.discordant(runs.where("run = 'q'"), runs.where("run = 't'")).select("fixed", "broken", F.round("p", 8).alias("p"))


@query(
    f"""
WITH r AS (SELECT 'q' AS run, doc_id, quality = 1 AS hit, 1.0::DOUBLE / (1 + doc_id % 3) AS rr FROM labels UNION ALL SELECT 't', doc_id, toxic = 0, 1.0::DOUBLE / (1 + doc_id % 4) FROM labels UNION ALL SELECT 'm', doc_id, quality = 1 AND toxic = 0, 1.0::DOUBLE / (1 + doc_id % 5) FROM labels),
c AS (SELECT x.run AS run_a, y.run AS run_b, count(*) FILTER (NOT x.hit AND y.hit) AS fixed, count(*) FILTER (x.hit AND NOT y.hit) AS broken, avg(y.rr - x.rr) AS d FROM r x JOIN r y USING (doc_id) WHERE (x.run, y.run) IN (('q', 't'), ('m', 'q')) GROUP BY ALL), {_LF}
SELECT run_a, run_b, fixed, broken, round(d, 8) AS mrr_delta, {_P} FROM c {_ON} GROUP BY run_a, run_b, fixed, broken, d"""
)
def comparison_grid(spark, sf_dir):
    chosen = spark.createDataFrame([("q", "t"), ("m", "q")], "run_a string, run_b string")
    return scoring.compare_grid(_runs(spark, sf_dir), chosen).select("run_a", "run_b", "fixed", "broken", F.round("mrr_delta", 8).alias("mrr_delta"), F.round("p", 8).alias("p"))


@query()
def paired_delta_exact(spark, sf_dir):
    """The mean difference of two runs with its interval, by the generator of Python; tested on a small case."""
    runs = _runs(spark, sf_dir)
    pairs = runs.where("run = 'q'").select("qid", F.col("rr").alias("a")).join(runs.where("run = 't'").select("qid", F.col("rr").alias("b")), "qid")
    return stats.paired_bootstrap_delta(pairs.withColumn("run", F.lit("q/t")), "run", "qid", "a", "b", draws=200)


# ----------------------------------------------------------- chunks, decisions


@query("SELECT c.chunk_id, md5(substr(d.text, c.\"start\" + 1, c.\"end\" - c.\"start\")) AS digest FROM (" + SQL["fixed_chunks"] + ") c JOIN documents d USING (doc_id)")
def chunk_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return chunking.with_text(chunking.fixed_chunks(docs), docs).select("chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("WITH " + _LINES + """, e AS (SELECT item_id AS qid, d.doc_id, strpos(d.text, b.text) - 1 AS pos, length(b.text) AS n, b.text AS quote FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0)
SELECT qid, e.doc_id, 'l' || max(ix) AS anchor, quote FROM e JOIN s ON s.doc_id = e.doc_id AND s."start" <= pos GROUP BY qid, e.doc_id, quote""")
def evidence_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    spans = evalset.locate_exact(docs, _quotes(spark, sf_dir))
    return evalset.evidence_of(spans, pages.line_headings(docs)).select("qid", "doc_id", "anchor", "quote")


@query(
    """SELECT event_id AS candidate_id, CASE WHEN event_type = 'view' THEN 'unknown decision' WHEN event_type = 'click' AND user_id % 2 = 1 THEN 'unknown reason'
WHEN event_type = 'purchase' AND (event_id % 3 = 0 OR event_id % 5 = 0) THEN 'no question or answer' WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'no evidence' END AS problem FROM events
WHERE event_type = 'view' OR event_type = 'click' AND user_id % 2 = 1 OR event_type = 'purchase' AND (event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0)"""
)
def decision_checks(spark, sf_dir):
    """Every event as a decision, some of which miss what they need."""
    k, kind = F.col("event_id"), F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        k.alias("candidate_id"),
        F.when(kind == "purchase", "keep").when(kind == "click", "drop").when(kind == "view", "what").otherwise("undo").alias("decision"),
        F.when(F.col("user_id") % 2 == 0, "duplicate").otherwise("no reason").alias("reason"),
        F.when(k % 3 != 0, "q").otherwise(" ").alias("question"),
        F.when(k % 5 != 0, "a").alias("answer"),
        F.when(k % 7 != 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence"),
    )
    return review.decision_problems(rows, list(tx.DROP_REASONS))


@query("WITH " + _LOG + " SELECT c_custkey AS candidate_id, CASE WHEN decision = 'keep' THEN 'q' || seq ELSE c_name END AS question FROM customer LEFT JOIN (SELECT * FROM lt WHERE decision = 'keep') k ON k.candidate_id = c_custkey")
def review_drafts(spark, sf_dir):
    log = _log(spark, sf_dir).withColumns({"question": F.concat(F.lit("q"), "seq"), "answer": F.lit("a")})
    candidates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("question"), F.lit("b").alias("answer"))
    return review.drafts(candidates, log).select("candidate_id", "question")


@query("WITH " + _LOG + ", o AS (SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT candidate_id FROM lt WHERE decision <> 'undo')) SELECT coalesce(min(k) FILTER (k > 40), min(k)) AS candidate_id FROM o")
def next_candidate(spark, sf_dir):
    candidates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_custkey").alias("ix"))
    return review.next_undecided(candidates, _log(spark, sf_dir), 40).select("candidate_id")


@query("WITH " + _LOG + """, c AS (SELECT count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'drop') AS dropped FROM lt WHERE decision <> 'undo')
SELECT 'kept' AS target, kept AS found, kept >= 10 AS met FROM c UNION ALL SELECT 'dropped', dropped, dropped >= 1000000 FROM c""")
def review_targets(spark, sf_dir):
    return review.targets(review.progress(_log(spark, sf_dir)), {"kept": 10, "dropped": 1_000_000})


@query("WITH " + SQL["longest_shared_run"].replace("WITH ", "", 1).rsplit("SELECT item_id, doc_id, max(n) + 3", 1)[0].strip() + """, r AS (SELECT item_id, doc_id, max(n) + 3 AS overlap FROM (SELECT item_id, doc_id, dg, run, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL)
SELECT count(*) AS offered_n, count(*) FILTER (overlap >= 5) AS offered_long, count(*) FILTER (doc_id % 2 = 0) AS final_n, count(*) FILTER (doc_id % 2 = 0 AND overlap >= 5) AS final_long FROM r""")
def shared_phrase_shift(spark, sf_dir):
    runs = longest_shared_run(spark, sf_dir).withColumnRenamed("run", "overlap")
    return review.shared_phrase_shift(runs, runs.where("doc_id % 2 = 0"))


@query("SELECT count(DISTINCT d.doc_id) AS pages FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0")
def evidence_pages(spark, sf_dir):
    return report.distinct_pages(_built(spark, sf_dir))
