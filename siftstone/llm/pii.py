"""Personal data: base patterns, and terms that the corpus shows to reveal protected entities."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import clean_text, documents, in_turn, new_names, session_of, staged

#: Kinds of entity, in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")
#: Distinct texts in which a term must stand with an entity.
SUPPORT = 2
#: A term that reveals a kind of entity must be rarer by chance than once in so many corpora.
CHANCE = 20
#: Keys of repeated texts and repeated entities that may be broadcast, and revealing terms of one table that is.
BROADCAST_KEYS, TERM_BLOCK = 1_000_000, 300_000
_FLUSH = 300_000
_NO_ID = -(2**63)
#: A term is removed if it reveals this share of an entity's information, and generalised from the lower share on.
REMOVE, GENERALISE = 0.95, 0.8

# The base patterns of the contract, with runs made possessive and
# anchored where no other match can begin, so that they take linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @, as far left as its local part goes."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base entities, by start and then kind; failing matches are dropped without a retry."""
    found = []
    if "@" in text:
        found += [(a, b, 0) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _DIGITS.sub("", m.group())) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def entity_of(text: str, span: tuple[int, int, str]) -> str:
    """What an entity is counted as: its kind and its value, without case and separators."""
    value = text[span[0] : span[1]].lower()
    return f"{span[2]}:{value if span[2] in ('email', 'ip') else _DIGITS.sub('', value)}"


def terms_of(text: str) -> set[str]:
    """The terms of a text, entities included: runs of three letters or more, lower-cased."""
    return set(map(str.lower, _TERM.findall(text)))


def _outside(spans: list[tuple[int, int, str]], matches: Iterable[re.Match]) -> Iterator[re.Match]:
    """The matches that touch no entity."""
    starts, ends = [a for a, _, _ in spans], list(accumulate((b for _, b, _ in spans), max))
    for m in matches:
        before = bisect_left(starts, m.end())  # spans that begin before the match ends
        if not before or ends[before - 1] <= m.start():
            yield m


def own_terms(text: str, spans: list[tuple[int, int, str]]) -> set[str]:
    """The terms of a text that stand outside its entities."""
    return {m.group().lower() for m in _outside(spans, _TERM.finditer(text))} if spans else terms_of(text)


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(key, text) with each text once, whatever the id, and their number; key is a hash of the text.

    Only keys with their first id are shuffled. Keys that repeat tell which rows
    to leave out: they are broadcast up to a checked number and merged beyond it.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("row_id"), F.xxhash64(clean_text()).alias("key"), clean_text().alias("text"))
    counts = staged(rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("row_id").alias("first")), "texts")
    n, repeats = counts.agg(F.count("*"), F.count_if(F.col("copies") > 1)).first()
    repeated = counts.where("copies > 1").select("key", "first")
    repeated = F.broadcast(repeated) if repeats <= BROADCAST_KEYS else repeated.hint("merge")
    once = rows.join(repeated, "key", "left_anti").select("key", "text")
    firsts = rows.join(repeated, "key").where("row_id = first").select("key", "text").dropDuplicates(["key"])
    return once.union(firsts), n


_SCANNED = f"term string, seen long, {', '.join(f'in_{k} long' for k in KINDS)}, key long, entities array<string>, terms array<string>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts hold each term, in all and beside each kind of entity, counted by task; and the entities and terms of each text with entities."""
    seen: Counter = Counter()
    beside = [Counter() for _ in KINDS]
    texts = []

    def out() -> pa.RecordBatch:
        more = [None] * len(texts)
        columns = [[*seen, *more], [*seen.values(), *more], *([*(c[t] for t in seen), *more] for c in beside)]
        columns += [[*([None] * len(seen)), *(x[k] for x in texts)] for k in range(3)]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
        for x in (seen, texts, *beside):
            x.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    long, strings = pa.int64(), pa.list_(pa.string())
    schema = pa.schema([("term", pa.string()), ("seen", long), *((f"in_{k}", long) for k in KINDS), ("key", long), ("entities", strings), ("terms", strings)])
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)):
            spans = base_spans(text)
            own = own_terms(text, spans)
            seen.update(own)
            if spans:
                texts.append((key, sorted({entity_of(text, s) for s in spans}), list(own)))
                for kind in {k for _, _, k in spans}:
                    beside[KINDS.index(kind)].update(own)
        if len(seen) + sum(len(x[2]) for x in texts) > _FLUSH:
            yield out()
    if seen or texts:
        yield out()


def revealing(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, share, action) of the terms whose disclosure of an entity, or of a kind of entity, exceeds a threshold.

    The disclosure is the pointwise mutual information of term and entity over
    all distinct texts, as a share of the entity's own information: 1 means
    that whoever sees the term knows the entity. Terms stand with an entity
    anywhere in a text; equal texts count once. A kind (entity `email:`) is held
    by every text with an entity of that kind, so entities of a single text
    count there; such a term must also be too one-sided for chance, by a
    likelihood ratio that pays for as many tests as there are terms.

    One pass over the texts counts terms by task; pairs are made only of
    entities in two texts or more and added up before they are shuffled.
    """
    session_of(docs)
    texts, n = distinct_texts(docs)
    scanned = staged(texts.mapInArrow(_scanned, _SCANNED), "scanned")
    counts = scanned.where("term is not null").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("seen", *(f"in_{k}" for k in KINDS))))
    seen = staged(counts.where(F.col("seen") >= support), "seen")
    with_entity = scanned.where("key is not null").select("key", "entities", "terms")
    each = with_entity.select("key", "terms", F.explode("entities").alias("entity"))
    held = staged(each.groupBy("entity").agg(F.count("*").alias("held")), "held")
    kinds = dict(held_by_kind(with_entity))

    repeated = held.where(F.col("held") >= support)
    # Without a shuffle where they are few; a merge splits an entity of very many texts as a skewed key.
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated.hint("merge")
    pairs = each.join(repeated, "entity").select("entity", "held", F.explode("terms").alias("term"))
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("held").alias("held")).where(F.col("both") >= support)
    single = both.join(seen.select("term", "seen").hint("merge"), "term").select("entity", "term", "both", "held", "seen")
    wide = F.array(*(F.struct(F.lit(f"{k}:").alias("entity"), F.col(f"in_{k}").alias("both"), F.lit(kinds.get(k, 0)).cast("long").alias("held")) for k in KINDS))
    by_kind = seen.select("term", "seen", F.explode(wide).alias("x")).where(F.col("x.both") >= support).select("x.entity", "term", "x.both", "x.held", "seen")

    def shared(rows: DataFrame) -> DataFrame:
        bits = F.log2(F.col("both") * n / (F.col("held") * F.col("seen")))
        # An entity of every text carries no information, so nothing can disclose it.
        return rows.withColumn("share", F.try_divide(bits, F.log2(n / F.col("held")))).where(F.col("share") >= generalise)

    tests = seen.count()
    rate, prior = F.col("both") / F.col("seen"), F.col("held") / n
    gain = F.col("both") * F.ln(rate / prior) + F.when(F.col("both") < F.col("seen"), (F.col("seen") - F.col("both")) * F.ln((1 - rate) / (1 - prior))).otherwise(0.0)
    scored = shared(single).unionByName(shared(by_kind).where(gain >= math.log(CHANCE * max(1, tests))))
    return scored.select("entity", "term", "share", F.when(F.col("share") >= remove, "removed").otherwise("term").alias("action"))


def held_by_kind(with_entity: DataFrame) -> list[tuple[str, int]]:
    """How many texts hold each kind of entity."""
    kinds = F.array_distinct(F.transform("entities", lambda e: F.substring_index(e, ":", 1)))
    return [(r[0], r[1]) for r in with_entity.select(F.explode(kinds).alias("kind")).groupBy("kind").count().collect()]


def _term_blocks(terms: DataFrame, most: int) -> Iterator[dict[str, str]]:
    """What becomes of each revealing term, in tables of about `most` terms, one after another."""
    actions = terms.groupBy("term").agg(F.min("action").alias("action"))
    parts = max(1, -(-actions.count() // most))
    for k in range(parts):
        own = actions if parts == 1 else actions.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k)
        yield {r["term"]: r["action"] for r in own.collect()}


_SPAN = "array<struct<start:int,stop:int,kind:string>>"


def _found(shared, text: str, base: str, more: str):
    """Fill the columns of base spans, and add the places of a block of terms to those of the terms."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        actions = shared.value
        for batch in batches:
            at, was = (batch.schema.get_field_index(c) for c in (base, more))
            old, bases, mores = batch.column(was).to_pylist(), [], []
            for value, had in zip(batch.column(batch.schema.get_field_index(text)).to_numpy(zero_copy_only=False), old):
                value = value or ""
                spans, new = base_spans(value), had or []
                if not actions.keys().isdisjoint(terms_of(value)):
                    new = new + [{"start": m.start(), "stop": m.end(), "kind": actions[t]} for m in _outside(spans, _TERM.finditer(value)) if (t := m.group().lower()) in actions]
                bases.append([{"start": a, "stop": b, "kind": k} for a, b, k in spans])
                mores.append(new)
            yield batch.set_column(at, base, pa.array(bases, kind)).set_column(was, more, pa.array(mores, kind))

    return run


def mark(docs: DataFrame, terms: DataFrame, base: str, more: str, most: int = TERM_BLOCK, then=iter, schema=None) -> DataFrame:
    """The rows of a frame with two columns: the base spans of `text`, and the places of the revealing terms outside them.

    Texts pass through one table of at most about `most` terms after another,
    without a shuffle; `then` turns the marked batches into ones of `schema`.
    """
    spark = session_of(docs)
    none = F.expr(f"cast(array() as {_SPAN})")
    out = docs.withColumns({base: none, more: none})
    found = [_found(spark.sparkContext.broadcast(block), "text", base, more) for block in _term_blocks(terms, most)]
    return out.mapInArrow(in_turn(*found, then), schema or out.schema)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): the base spans of every row of (doc_id, text), and those with the revealing terms.

    A revealing term is marked wherever it stands, with an entity or alone; only
    the tables of terms are sent to the tasks. Null and empty texts have no
    spans; null ids and repeated rows each return a row; extra columns are
    ignored; an empty table gives none.
    """
    terms = staged(revealing(docs), "terms")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text().alias("text"))
    return mark(rows, terms, "base", "more").select("doc_id", "base", F.concat("base", "more").alias("spans"))


def _replaced(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
        if s["start"] >= at:
            parts += [text[at : s["start"]], "" if s["kind"] == "removed" else f"[{s['kind'].upper()}]"]
        at = max(at, s["stop"])
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of a frame with their texts sanitised, all other columns as they are.

    Base entities become their kind in brackets; revealing terms are removed or
    become [TERM]. Null texts stay null; columns may have any name.
    """
    terms = staged(revealing(docs), "terms")
    base, more = new_names(docs, "base", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            found = zip(batch.column(k).to_pylist(), batch.column(batch.schema.get_field_index(base)).to_pylist(), batch.column(batch.schema.get_field_index(more)).to_pylist())
            out = [_replaced(t, a + b) if a or b else t for t, a, b in found]
            yield batch.set_column(k, "text", pa.array(out, pa.string())).drop_columns([base, more])

    return mark(docs, terms, base, more, then=run, schema=docs.schema)


def _listed(spans: str) -> str:
    """SQL for kind:start:end of spans, by start and then kind, comma-joined."""
    rank = ", ".join(f"'{k}'" for k in (*KINDS, "term", "removed"))
    return f"array_join(transform(array_sort(transform({spans}, s -> struct(s.start as a, array_position(array({rank}), s.kind) as k, s.stop as b, s.kind as kind))), s -> concat(s.kind, ':', s.a, ':', s.b)), ',')"


def op5_disclosure_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents: the base spans and the terms that reveal them."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return detect(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))
