"""Question sets: sampling, evidence spans, decisions, building and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.operators.retrieval import small

MIN_SECTION = 400


def eligible(sections: DataFrame, excluded: DataFrame | None = None, least: int = MIN_SECTION) -> DataFrame:
    """Sections (key, start, end) that are long enough and not in an exclusion table (key)."""
    long = sections.where(F.col("end") - F.col("start") >= least)
    return long if excluded is None else long.join(excluded.select("key"), "key", "left_anti")


def draw_key(seed: int, *parts: str) -> Column:
    """A repeatable random order: md5 of the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts)))


def round_robin(rows: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, one of each group a round, groups and rows in seeded order."""
    ranked = rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(draw_key(seed, key), key)).cast("long"))
    # No group needs more than n rounds, so the ranked limit is pushed below the shuffle.
    return ranked.where(F.col("round") <= n).orderBy("round", draw_key(seed, group), group).limit(n)


def neighbour_pairs(sections: DataFrame, n: int, seed: int = 0, reach: int = 3, avoid: DataFrame | None = None) -> DataFrame:
    """One seeded pair (doc_id, a_ix, b_ix) a page of sections at most `reach` apart, n in all.

    A band join on the page: each section is copied to the places it can be
    met from, so pages with many sections make reach rows each, not all pairs.
    """
    own = sections.select("doc_id", "ix", "key") if avoid is None else sections.select("doc_id", "ix", "key").join(avoid.select("key"), "key", "left_anti")
    before = own.select("doc_id", F.col("ix").alias("a_ix"), F.explode(F.sequence(F.col("ix") + 1, F.col("ix") + reach)).alias("b_ix"))
    pairs = before.join(own.select("doc_id", F.col("ix").alias("b_ix")), ["doc_id", "b_ix"])
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(draw_key(seed, "doc_id", "a_ix", "b_ix"), "a_ix", "b_ix"))).where("r = 1")
    return first.orderBy(draw_key(seed, "doc_id"), "doc_id").limit(n).select("doc_id", "a_ix", "b_ix")


def merge_spans(spans: DataFrame, *by: str) -> DataFrame:
    """(by..., start, end) with overlapping spans joined; spans that only touch stay apart."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    islands = flagged.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _grams(rows: DataFrame, key: str, text: Column, n: int, pattern: str) -> DataFrame:
    """(key, grams): 64-bit hashes of the runs of n words of a text, in order. Words are hashed in a column of their own, once."""
    hashed = rows.select(key, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.xxhash64(w)).alias("hashes"))
    places = F.sequence(F.lit(0), F.size("hashes") - n)
    # Generated with `outer` by the callers: the filter Spark infers for the other kind would make the grams again for each word.
    return hashed.where(F.size("hashes") >= n).select(key, F.transform(places, lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(n)))).alias("grams"))


def longest_shared_run(left: DataFrame, right: DataFrame, least: int = 4) -> DataFrame:
    """(a_id, b_id, run): the longest run of words, in any case, that texts (a_id, text) and (b_id, text) share, where it has `least` words.

    Only texts that share a run of so many words meet, by an equi-join on it;
    matches on one diagonal with consecutive places are longer runs.
    """
    a = _grams(left, "a_id", F.lower("text"), least, "[a-z0-9_]+").select("a_id", F.posexplode_outer("grams").alias("i", "g"))
    b = _grams(right, "b_id", F.lower("text"), least, "[a-z0-9_]+").select("b_id", F.posexplode_outer("grams").alias("j", "g"))
    met = b.join(small(a), "g").select("a_id", "b_id", (F.col("i") - F.col("j")).alias("d"), "i")
    place = F.row_number().over(Window.partitionBy("a_id", "b_id", "d").orderBy("i"))
    runs = met.withColumn("run", F.col("i") - place).groupBy("a_id", "b_id", "d", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("a_id", "b_id").agg((F.max("n") + least - 1).cast("long").alias("run"))


def term_hits(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id) where a literal term begins a word; terms are a short stated list."""
    from siftstone.functions.text import whole_word_start

    return docs.select("doc_id", "text").join(F.broadcast(terms.select("term")), whole_word_start("text", "term")).select("term", "doc_id")


#: Words of a quotation that documents are looked up by; they stand between its first and last, which may be parts of words.
ANCHOR = 3
_WORD = r"[^ \n\t\r]+"


def candidates(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, qid) where a document (doc_id, text) has the inner words of a quotation (qid, quote) of ANCHOR + 2 words or more."""
    inner = F.slice(F.regexp_extract_all("quote", F.lit(_WORD), F.lit(0)), 2, ANCHOR)
    anchors = quotes.select("qid", F.xxhash64(*(F.xxhash64(F.get(inner, k)) for k in range(ANCHOR))).alias("g"))
    grams = _grams(docs, "doc_id", F.col("text"), ANCHOR, _WORD).select("doc_id", F.explode_outer(F.array_distinct("grams")).alias("g"))
    return grams.join(small(anchors), "g").select("doc_id", "qid").distinct()


def locate_exact(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(qid, doc_id, start, end) of the first exact place of each quote (qid, quote) in each document that holds it.

    Quotes of five words or more meet documents by an equi-join on inner words,
    and only those pairs are searched. Shorter ones, if there are any, are a
    stated list that every text is searched for.
    """
    at = F.expr("instr(text, quote)")
    place = ["qid", "doc_id", (at - 1).alias("start"), (at - 1 + F.length("quote")).alias("end")]
    long = F.size(F.regexp_extract_all("quote", F.lit(_WORD), F.lit(0))) >= ANCHOR + 2
    texts = docs.select("doc_id", "text")
    met = texts.join(candidates(texts, quotes.where(long)), "doc_id").join(small(quotes.where(long)), "qid").where(at > 0).select(*place)
    short = quotes.where(~long)
    return met if short.isEmpty() else met.unionByName(texts.join(small(short), at > 0).select(*place))


#: What a quotation may have in another form, or not at all.
_MARKS = "[\"'`*“”‘’]"


def locate_loose(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(qid, doc_id, start, end) of each quote in each document that holds it but for white space and quotation marks.

    Both sides are put in the loose form and met like exact quotes; only the
    documents found are searched again for the place in the text as it is.
    """
    from siftstone.functions.text import locate

    loose = lambda c: F.regexp_replace(F.regexp_replace(c, _MARKS, ""), r"(?U)\s+", " ")
    found = locate_exact(docs.select("doc_id", loose("text").alias("text")), quotes.select("qid", F.btrim(loose("quote")).alias("quote"))).select("qid", "doc_id")
    met = found.join(docs.select("doc_id", "text"), "doc_id").join(small(quotes), "qid").withColumn("at", locate("text", "quote"))
    return met.where("at.start is not null").select("qid", "doc_id", "at.start", "at.end")


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in an append-only log."""
    newest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("newest", F.row_number().over(newest)).where("newest = 1").drop("newest")


def decided(log: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Decisions in force: the last row of each candidate, unless it takes the decision back."""
    return latest(log, key, "at", "seq").where("decision <> 'undo'")


def undecided(candidates: DataFrame, log: DataFrame, key: str = "candidate_id") -> DataFrame:
    return candidates.join(decided(log, key).select(key), key, "left_anti")


def kind_of(evidence: Column) -> Column:
    """unanswerable, single or multi, by the distinct (doc_id, anchor) of an evidence array."""
    places = F.size(F.array_distinct(F.transform(evidence, lambda e: F.struct(e["doc_id"], e["anchor"]))))
    return F.when(F.size(evidence) <= 0, "unanswerable").when(places >= 2, "multi").otherwise("single")


def evidence_of(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Evidence rows (qid, doc_id, start, end, anchor, quote) of spans (qid, doc_id, start, end) in rendered pages: the section a span begins in, and what stands there."""
    from siftstone.operators.pages import section_at

    met = spans.join(docs.select("doc_id", "text", "headings"), "doc_id").withColumn("h", section_at(F.col("headings"), F.col("start")))
    return met.select("qid", "doc_id", "start", "end", F.coalesce("h.anchor", F.lit("")).alias("anchor"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("quote"))


def same_spans(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def build_questions(kept: DataFrame, handwritten: DataFrame, unanswerable: DataFrame) -> DataFrame:
    """The three sources (pos, question, answer, evidence, origin, candidate_id) in order, numbered q001 on."""
    columns = ["pos", "question", "answer", "evidence", "origin", "candidate_id"]
    every = None
    for k, part in enumerate((kept, handwritten, unanswerable)):
        own = part.select(*columns).withColumn("src", F.lit(k))
        every = own if every is None else every.unionByName(own)
    numbered = every.withColumn("n", F.row_number().over(Window.orderBy("src", "pos")))  # a reviewed set is small
    return numbered.select(F.format_string("q%03d", "n").alias("id"), "question", "answer", (F.size("evidence") > 0).alias("answerable"), "evidence", kind_of(F.col("evidence")).alias("kind"), "origin", "candidate_id")


def validate(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, rule) for every rule that a question breaks; an empty result is a valid set."""
    plain = F.lower(F.btrim(F.regexp_replace("question", r"\s+", " ")))
    q = questions.withColumn("plain", plain)
    repeats = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    n = F.size("evidence")
    flagged = q.select(
        F.col("id").alias("qid"),
        F.filter(
            F.array(
                F.when(repeats("id"), "duplicate id"),
                F.when(F.col("plain") == "", "empty question"),
                F.when(repeats("plain"), "duplicate question"),
                F.when(F.col("answerable") & (n <= 0), "answerable without evidence"),
                F.when(~F.col("answerable") & (n > 0), "unanswerable with evidence"),
                F.when(F.col("answerable") & (F.coalesce(F.btrim("answer"), F.lit("")) == ""), "missing answer"),
                F.when(F.col("kind") != kind_of(F.col("evidence")), "wrong kind"),
            ),
            lambda x: x.isNotNull(),
        ).alias("rules"),
    ).select("qid", F.explode("rules").alias("rule"))
    spans = questions.select(F.col("id").alias("qid"), F.explode("evidence").alias("e")).select("qid", "e.*")
    met = spans.join(docs.select("doc_id", "text"), "doc_id", "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    drift = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("quote")
    rule = F.when(F.col("text").isNull(), "unknown page").when(~inside, "span out of range").when(drift, "quote drift")
    return flagged.unionByName(met.select("qid", rule.alias("rule")).where("rule is not null")).distinct()
