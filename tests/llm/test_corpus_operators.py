"""The corpus operators against brute force, on odd rows and on the smallest tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, text_key string"
BASE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, BASE),
    (2, BASE),
    (2, BASE),
    (3, BASE.replace("word30", "other")),
    (4, None),
    (5, ""),
    (6, "  \n\t "),
    (None, BASE),
    (None, "a null id of its own"),
    (7, "one two"),
    (8, "ONE two"),
    (9, "x" * 5000 + " " + "long text\n" * 3000),
    (10, "é你😀 <|endoftext|> it's 3.5  \n\n end"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "k") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """The odd rows as the tables of a folder, with labels and benchmark items."""
    at = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (7, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(10, 25))), (2, None), (3, ""), (None, "x")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# ------------------------------------------------------------------ every query


def test_every_query_survives_odd_rows(spark, folder):
    from siftstone.llm.queries import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, folder).count() == len(ODD), name


def test_every_operator_survives_an_empty_table(spark, empty):
    from siftstone.llm import bpe, decontaminate, lm, minhash, pii, quality, sharding, token_count, token_index, toxicity
    from siftstone.llm.common import shared_dir

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    path, pattern = bpe.vocabulary()
    import public_tokenizers as P

    results = [
        toxicity.with_scores(empty, toxicity.fit(empty, labels)),
        token_count.count_tokens(empty, P.path("piece_bpe_32k.model")),
        bpe.digests(bpe.encode_texts(empty, path, pattern), path, pattern),
        sharding.assign(empty),
        pii.detect(empty),
        pii.sanitise(empty),
        decontaminate.decontaminate(empty, bench),
        minhash.near_duplicates(empty),
        minhash.representatives(empty),
        lm.score(empty, "true"),
        token_index.read_index(token_index.write_index(empty, shared_dir(spark) + "/none", P.path("byte_bpe_50k.json"))),
        quality.quality(empty, quality.trusted_ids(labels)),
    ]
    assert [r.count() for r in results] == [0] * len(results)


# --------------------------------------------------------------------- toxicity


def test_grammar_weighs_clauses_not_words():
    from siftstone.llm.toxicity import Model, Scorer

    s = Scorer(Model())
    weight = lambda t: max(s.clauses(t), default=0)
    plain = weight("what an idiot")
    assert weight("you are an idiot") > plain > weight("he is not an idiot") > 0
    assert weight("she said that is an idiot") < plain and weight("he called it “idiot”") < plain
    assert weight("i will kill you") > 0 == weight("kill the process") == weight("a clean text") == weight("")
    assert weight("not bad. idiot") == plain
    assert s.score("you idiot, you moron") > s.score("an idiot") > s.score("") == s.score("fine words")


TOXIC_CASES = {
    "insult": ("a total noddy", "a noddy"),
    "threat": ("i will kill you", "i will kill the process"),
    "negation": ("he is an idiot", "he is not an idiot"),
    "reported": ("what an idiot", "they quoted idiot as a word"),
    "target": ("you noddy", "noddy"),
}


@pytest.mark.parametrize("name", TOXIC_CASES)
def test_every_transducer_decides(name):
    from siftstone.llm.toxicity import PARTS, Model, Scorer

    model = Model(words={"noddy": 1.9, "kill": -1.0, "hurt": 1.2}, scale=(-2.5, 1.0, 0.2))
    whole, without = Scorer(model), Scorer(model, [p for p in PARTS if p.__name__ != name])
    toxic, fine = TOXIC_CASES[name]
    assert whole.score(toxic) >= 0.5 > whole.score(fine)
    assert (without.score(toxic) >= 0.5) == (without.score(fine) >= 0.5)


def test_transducers_read_what_the_one_before_hands_on():
    from siftstone.llm.toxicity import Model, Scorer

    s = Scorer(Model(words={"kill": -1.0, "hurt": 1.2}))
    weight = lambda t: max(s.clauses(t), default=0)
    assert weight("i will kill you") == weight("i will hurt you") > weight("i would never kill you") > weight("he said i would never kill you") > 0
    assert weight("kill the process") == weight("hurt feelings") == 0
    assert weight("you piece of garbage") > weight("you really are garbage") > weight("you garbage")
    assert weight("you are not an idiot") == pytest.approx(0.4 * weight("an idiot"))  # a denied insult has no target


def test_toxicity_learns_on_training_folds_only(spark):
    from siftstone.llm import toxicity as T

    docs = spark.createDataFrame([(i, f"some text {i} " + ("zorgled thing" if i % 4 == 0 else "plain thing")) for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in T.training_labels(labels).collect())
    model = T.fit(docs, T.training_labels(labels))
    assert "zorgled" in model.words
    out = rows_of(T.with_scores(docs, model))
    assert all((out[i].toxicity >= 0.5) == (i % 4 == 0) for i in range(400))


# ----------------------------------------------------------------- token counts


def test_viterbi_counts_equal_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer, models

    from siftstone.llm.token_count import Counter as Count
    from siftstone.llm.token_count import vocabulary

    pieces, has_bytes = vocabulary(P.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False)).model
    count = Count(pieces, has_bytes).count
    for text in [t for _, t in ODD if t] + ["  two  spaces ", "▁mark", "ñandú ŭ́ 漢字 𝔘", "a" * 300]:
        marked = "▁" + text.replace(" ", "▁")
        assert count(text) == sum(len(t.value.encode()) if t.id == 0 else 1 for t in library.tokenize(marked)), text[:40]


def test_viterbi_ties_and_unknown_runs():
    from siftstone.llm.token_count import Counter as Count

    tied = Count([("a", -1.0), ("b", -1.0), ("ab", -2.0)], False, prefix=False)
    assert tied.count("ab") == 1  # the piece that begins first stays
    assert Count([("a", -1.0)], False, prefix=False).count("xxaxx") == 3
    assert Count([("a", -1.0)], True, prefix=False).count("éa") == 3
    assert Count([], False, prefix=False).count("abc") == 1


# -------------------------------------------------------------------------- BPE


@pytest.mark.parametrize("long, chunk, overlap", [(32_768, 16_384, 512), (200, 100, 30)])
def test_bpe_equals_the_library_and_round_trips(odd, long, chunk, overlap):
    import tiktoken

    from siftstone.llm import bpe

    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    encoded = bpe.encode_texts(odd, path, pattern, long, chunk, overlap)
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(encoded, path, pattern).collect())
    expected = []
    for _, t in ODD:
        ids = library.encode_ordinary(t or "")
        expected.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected)
    assert sorted(bytes(r.raw) for r in bpe.decode_ids(encoded, path, pattern).collect()) == sorted((t or "").encode() for _, t in ODD)


@pytest.mark.parametrize("long, chunk, overlap", [(32_768, 16_384, 512), (200, 100, 30)])
def test_arrays_are_the_ids_of_the_texts(odd, long, chunk, overlap):
    from siftstone.llm import bpe

    args = odd, *bpe.vocabulary(), long, chunk, overlap
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(bpe.encode_arrays(*args)) == rows(bpe.id_arrays(bpe.encode_texts(*args)))


def test_the_pipeline_takes_one_worker_a_task(spark, odd):
    import corpus_pipeline
    from siftstone.llm import bpe, pii

    def chained(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        nodes = [n for n in re.findall(r"^[\s:+-]*(\w+)", plan, re.M) if n not in ("Project", "Filter", "Union")]
        return ("MapInArrow", "MapInArrow") in zip(nodes, nodes[1:])

    assert chained(bpe.id_arrays(bpe.encode_texts(odd, *bpe.vocabulary())))
    assert not chained(corpus_pipeline.encode(spark, odd, ""))
    assert not chained(corpus_pipeline.sanitise(spark, odd, ""))
    terms = spark.createDataFrame([("alpha", "term"), ("beta", "term"), ("gamma", "removed")], "term string, action string")
    assert not chained(pii.mark(odd, terms, "base", "more", most=1))


def test_units_split_as_the_pattern_does():
    import public_tokenizers
    import regex
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from siftstone.llm.pretokens import head_and_tail, units

    find = regex.compile(public_tokenizers.PATTERN).findall

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.sampled_from("ab1é' \n\t,.! 　\x1c你s"), max_size=24))
    def check(text):
        cut = units(text)
        if cut is not None:
            parts = [p for u in cut for p in (head_and_tail(u) or (u,))]
            assert [m for p in parts for m in find(p)] == find(text)

    check()


def test_stitch_falls_back_to_one_piece():
    from siftstone.llm.bpe import stitch

    assert stitch([(0, 0, [0], [8, 10]), (1, 8, [8, 10], [18]), (2, 16, [17], [])]) == [(0, 8), (8, None)]


# ---------------------------------------------------------------------- sharding


def test_sharding(spark, odd):
    from siftstone.llm import sharding as S

    out = S.assign(odd).collect()
    assert len(out) == len(ODD) and {r.law for r in out} == {"key"}
    for shard, group in ((s, [r for r in out if r["shard"] == s]) for s in {r["shard"] for r in out}):
        assert sorted(r.slot for r in group) == list(range(len(group)))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), *(S.shard_of("id", S.tree(n)).alias(f"s{n}") for n in (15, 16, 17, 18)))
    rows = many.collect()
    for n in (16, 17):
        assert all(r[f"s{n}"] == r[f"s{n + 1}"] or r[f"s{n + 1}"] == n for r in rows)
    counts = Counter(r.s16 for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) < 1.15 * min(counts.values())

    def descend(key, leaves, levels):
        groups = defaultdict(list)
        for leaf in leaves:
            groups[getattr(leaf, levels[0])].append(leaf)
        bits = lambda a: int(hashlib.md5(f"{key}|{levels[0]}{a}".encode()).hexdigest()[:13], 16)
        at = min(groups, key=lambda a: -math.log((bits(a) + 0.5) / 2**52) / sum(x.weight for x in groups[a])) if len(groups) > 1 else next(iter(groups))
        return descend(key, groups[at], levels[1:]) if levels[1:] else at

    assert all(r.s16 == descend(r.doc_id, S.tree(16), ("region", "rack", "shard")) for r in rows[:300])


def test_weight_change_moves_rows_only_between_changed_subtrees(spark):
    from dataclasses import replace

    from siftstone.llm import sharding as S

    before = S.tree(16)
    after = [replace(x, weight=2.0) if x.shard == 0 else replace(x, weight=0.5) if x.shard == 1 else x for x in before]  # rack 0 grows by a half
    rows = spark.range(5000).select(S.shard_of("id", before).alias("a"), S.shard_of("id", after).alias("b")).collect()
    assert all(r.a == r.b or r.b < 8 for r in rows)


# --------------------------------------------------------------------------- PII


def brute_spans(text):
    from siftstone.llm.pii import luhn

    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), "card"))
    found += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def test_base_spans_equal_plain_patterns():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from siftstone.llm.pii import base_spans

    @settings(max_examples=600, deadline=None)
    @given(st.one_of(st.text(st.sampled_from("a@._-1 9+()25"), max_size=40), st.lists(st.sampled_from(["a@b.c", "_d@e.f", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (434) 555-2368", "é", " ", "000.1.1.1"]), max_size=8).map("".join)))
    def check(text):
        assert base_spans(text) == brute_spans(text)

    check()


def test_long_runs_take_linear_time():
    from siftstone.llm.pii import base_spans

    assert base_spans("1" * 200_000 + " " + "a" * 200_000 + " " + "1." * 100_000) is not None


def test_terms_that_reveal_an_entity(spark):
    from siftstone.llm import pii

    docs = [(i, f"common words here number {i} filler{i}") for i in range(60)]
    docs += [(100 + i, f"common words zanzibari baker mail joe@x.org note{i}") for i in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = rows_of(pii.detect(frame))
    text = dict(docs)[100]
    found = {(s.kind, text[s.start : s.stop]) for s in out[100].spans}
    assert ("email", "joe@x.org") in found and ("removed", "zanzibari") in found and not any(w == "common" for _, w in found)
    assert out[5].spans == []
    clean = rows_of(pii.sanitise(frame))[100].text
    assert "[EMAIL]" in clean and "zanzibari" not in clean and clean.startswith("common words")


def test_revealing_terms_are_marked_far_from_an_entity_and_without_it(spark):
    from siftstone.llm import pii

    far = " ".join(f"word{i}" for i in range(300))
    docs = [(i, f"common words here number {i} filler{i} {far}") for i in range(2000)]
    docs += [(3000 + i, f"common zanzibari {far} mail joe@x.org {far} quuxley {i}") for i in range(2)]
    docs += [(3002, f"common zanzibari alone {far}"), (3003, docs[-1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out, text = rows_of(pii.detect(frame)), dict(docs)
    found = {i: {(s.kind, text[i][s.start : s.stop]) for s in out[i].spans} for i in out}
    assert {("email", "joe@x.org"), ("term", "zanzibari"), ("removed", "quuxley")} <= found[3000]
    assert found[3002] == {("term", "zanzibari")} and found[3003] == found[3001] and found[5] == set()
    assert rows_of(pii.sanitise(frame))[3002].text.startswith("common [TERM] alone")


def plain_disclosure(texts, support=2, generalise=0.8, remove=0.95):
    """Shares of every (entity, term) by counting over sets of distinct texts."""
    from siftstone.llm import pii

    held, seen, both = Counter(), Counter(), Counter()
    distinct = set(texts)
    for t in distinct:
        spans = pii.base_spans(t)
        entities = {pii.entity_of(t, s) for s in spans}
        terms = {m.group().lower() for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(a < m.end() and m.start() < b for a, b, _ in spans)}
        kinds = {f"{e.split(':')[0]}:" for e in entities}
        held.update(entities | kinds)
        seen.update(terms)
        both.update((e, w) for e in entities | kinds for w in terms)
    n, out, tests = len(distinct), {}, sum(c >= support for c in seen.values())
    for (e, w), c in both.items():
        if c >= support and held[e] < n:
            share = math.log2(c * n / (held[e] * seen[w])) / math.log2(n / held[e])
            if e.endswith(":"):
                rate, prior = c / seen[w], held[e] / n
                gain = c * math.log(rate / prior) + ((seen[w] - c) * math.log((1 - rate) / (1 - prior)) if c < seen[w] else 0)
                if gain < math.log(pii.CHANCE * tests):
                    continue
            if share >= generalise:
                out[e, w] = (pytest.approx(share), "removed" if share >= remove else "term")
    return out


def test_every_share_equals_plain_mutual_information(spark, monkeypatch):
    from siftstone.llm import pii

    draw = np.random.default_rng(5)
    names = [f"{a}{b}{c}" for a in "klmnprst" for b in "aeiou" for c in "xyzvw"]
    texts = []
    for i in range(400):
        text = " ".join(draw.choice(names, 12))
        if i % 20 == 0:
            text += f" contact kontakt u{i % 60}@x.org"
        if i % 25 == 0:
            text += f" secretword{'abc'[i % 3]} 10.0.{i % 50}.7"
        texts += [text] * (1 + (i % 7 == 0) * 3)
    docs = spark.createDataFrame([(None if i % 11 == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    expected = plain_disclosure(texts)
    assert any(e == "email:" for e, _ in expected) and any(not e.endswith(":") for e, _ in expected)
    got = {(r.entity, r.term): (r.share, r.action) for r in pii.revealing(docs).collect()}
    assert got == expected
    marked = [(r.doc_id, sorted(map(tuple, r.spans))) for r in pii.detect(docs).collect()]
    monkeypatch.setattr(pii, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(pii, "_FLUSH", 10)
    assert {(r.entity, r.term): (r.share, r.action) for r in pii.revealing(docs).collect()} == expected
    terms = pii.revealing(docs)
    blocks = pii.mark(docs, terms, "base", "more", 2).select("doc_id", F.concat("base", "more").alias("spans")).collect()
    assert sorted(((r.doc_id, sorted(map(tuple, r.spans))) for r in blocks), key=str) == sorted(marked, key=str)


def test_sanitise_keeps_columns_of_any_name(spark):
    from siftstone.llm import pii

    docs = spark.createDataFrame([(1, "write to a@b.org", "x", 2, "y"), (None, None, None, None, None)], "doc_id long, text string, base string, BASE_ int, more string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {(1, "write to [EMAIL]", "x", 2, "y"), (None, None, None, None, None)}


# --------------------------------------------------------------- decontamination


def test_wand_equals_exhaustive_search_and_screening_loses_nothing(spark):
    from siftstone.llm.decontaminate import Index

    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    index = Index(items + [(999, items[0][1])])
    for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect():
        terms = r.text.encode().lower().split()
        ids = np.array([index.memo[w] for w in terms])
        plausible = {min(max(0, k), len(index.windows(len(terms))) - 1) for k in index.plausible(ids).tolist()}
        for k, (a, b) in enumerate(index.windows(len(terms))):
            known = np.unique(ids[a:b][ids[a:b] >= 0]).tolist()
            shares = np.zeros(len(index.items))
            for t in known:
                shares[index.at[t]] += index.impact[t]
            expected = np.flatnonzero(shares >= index.threshold - 1e-9).tolist()
            assert sorted(i for i, _ in index.search(known)) == expected
            assert not expected or k in plausible


def test_leaks(spark):
    from siftstone.llm.decontaminate import find_leaks

    item = "what is the tallest of all the grey mountains in the far north answer it is the lonely iron peak"
    bench = spark.createDataFrame([(1, item), (2, "some quite different question about rivers and lakes answer blue water")], "item_id long, text string")
    noise = " ".join(f"noise{i}" for i in range(300))
    docs = spark.createDataFrame([(1, f"{noise} {item.upper()}. {noise}"), (2, noise), (3, item.rsplit(" ", 8)[0]), (4, None)], "doc_id long, text string")
    for limit in (1 << 20, 60):
        got = {r.doc_id: [x.item for x in r.leaks] for r in find_leaks(docs, bench, limit=limit).collect()}
        assert got == {1: [1], 2: [], 3: [], 4: []}


def test_any_number_of_indexes_finds_the_same(spark):
    """Passages with parts of items, so that shares lie on both sides of the threshold."""
    from siftstone.llm.decontaminate import find_leaks

    draw, names = np.random.default_rng(3), [f"t{i}" for i in range(400)]
    texts = [" ".join(draw.choice(names, n)) for n in draw.integers(8, 60, 40)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = []
    for i in range(300):
        own = texts[i % 40].split()
        kept = [w if draw.random() < 0.85 else "other" for w in own[: int(len(own) * draw.uniform(0.6, 1))]]
        docs.append((i, " ".join([*draw.choice(names, 90), *kept, *draw.choice(names, 90)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    size = sum(map(len, texts))
    found = [{r.doc_id: sorted((x.item, round(x.share, 9)) for x in r.leaks) for r in find_leaks(frame, bench, limit=size // k + 1).collect()} for k in (1, 4, 16)]
    assert found[0] == found[1] == found[2]
    assert 30 < sum(map(bool, found[0].values())) < 300


def test_leaks_keep_columns_of_any_name(spark):
    from siftstone.llm.decontaminate import decontaminate

    docs = spark.createDataFrame([(1, "some text", "a", "b")], "doc_id long, text string, leaks string, Leaks_ string")
    bench = spark.createDataFrame([(1, "one thing or another")], "item_id long, text string")
    assert decontaminate(docs, bench).collect() == docs.collect()


# ---------------------------------------------------------------- near duplicates


def brute_components(docs, n=4, percent=80):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    from siftstone.llm.minhash import op7_circulant_minhash

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op7_circulant_minhash(spark, DATA).collect()}
    assert got == brute_components(docs)


def test_near_duplicates_on_odd_rows(odd):
    from siftstone.llm.minhash import near_duplicates, representatives

    out = near_duplicates(odd, words=4).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert len(out) == len(ODD) and [r.component_id for r in by[2]] == [1, 1] and by[3][0].component_id == 1
    assert by[8][0].component_id == 7 and by[4][0].n_shingles == 0 and by[4][0].kept and by[5][0].component_id == 5
    assert sorted((r.component_id, r.kept) for r in by[None] if r.component_id) == [(1, False)]
    kept = representatives(odd, words=4).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 6, 7, 9, 10] and kept[0].source == "s"


def test_two_texts_under_one_id(spark):
    from siftstone.llm.minhash import near_duplicates, representatives

    a, b = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    docs = spark.createDataFrame([(1, a, "k"), (2, a + " more", "k"), (2, b, "k"), (3, b + " more", "k"), (None, b + " more", "k"), (None, "alone in the world", "k")], "doc_id long, text string, text_key string")
    out = near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False)]
    assert sorted(((r.component_id, r.kept) for r in out if r.doc_id is None), key=str) == [(1, False), (None, True)]
    kept = representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, a), (2, b), (None, "alone in the world")]


def test_a_large_group_of_chained_copies(spark, monkeypatch):
    from siftstone.llm import minhash
    from siftstone.llm.minhash import near_duplicates

    monkeypatch.setattr(minhash, "_PART", 16)
    rng, docs = np.random.default_rng(5), []
    for i in range(150):
        w = [f"w{k}" for k in range(120)]
        for k in rng.integers(0, 120, 6):
            w[k] = f"x{rng.integers(0, 10**6)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=4).collect()}
    assert got == brute_components(docs)


def test_star_rounds_write_only_pairs_and_classes(spark, monkeypatch):
    from siftstone.llm import minhash

    names, staged = [], minhash.staged
    monkeypatch.setattr(minhash, "staged", lambda df, name: names.append(name) or staged(df, name))
    minhash.text_classes(spark.createDataFrame(ODD[:4], "doc_id long, text string"), 4, 80, 6, 40, 3)
    assert names.count("pairs") == 4 and names.count("open") == 1 and "links" not in names


def test_odd_sketches_never_reject():
    from siftstone.llm.minhash import odd_sketch

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in rng.integers(1, 4000, 2))
        differ = int(np.bitwise_count(odd_sketch(a) ^ odd_sketch(b)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_components_of_a_long_path(spark):
    from siftstone.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (None, 3), (7, 7)], "u long, v long")
    assert {(r.node, r.label) for r in components(edges).collect()} == {(i, 0) for i in range(301)} | {(500, 500), (501, 500)}


# ----------------------------------------------------------------- language model


LM_TEXTS = ["a b a b c", "a b", "", None, "rare pair once", "once rare a b", "q unseen a c", "b c a", " A\tb\x0bc ", "a b a b c"]


def plain_backoff(texts, train, give):
    """Scores by a dictionary automaton: one token at a time, failing from state to state."""
    runs = [["\n", *words(t), "\n"] for t in train]
    reads = Counter(w for run in runs for w in run[1:])
    n, v = sum(reads.values()), len(reads)
    grams = {k: Counter(tuple(run[i - k + 1 : i + 1]) for run in runs for i in range(max(1, k - 1), len(run))) for k in (2, 3)}
    held = {(w,): c for w, c in reads.items()} | dict(grams[2])
    held[("\n",)] = len(runs)

    def read(state, word):
        if not state:
            return math.log10((reads[word] + 0.1) / (n + 0.1 * (v + 1)))
        k, size = give[len(state) - 1], held.get(state, 0)
        lower, arc = read(state[1:], word), grams[len(state) + 1][(*state, word)]
        return math.log10((arc + k * 10**lower) / (size + k)) if arc else math.log10(k / (size + k)) + lower

    out = []
    for t in texts:
        total, state = 0.0, ("\n",)
        for w in [*words(t), "\n"]:
            total += read(state, w)
            state = (*state, w)[-2:]
        out.append(total)
    return out, reads, n, v, read


@pytest.mark.parametrize(("tokens", "part"), [(1 << 22, 8 << 20), (4, 16), (1, 1)])
def test_blocks_and_parts_score_like_a_plain_automaton(spark, tokens, part):
    from siftstone.llm import lm

    docs = spark.createDataFrame(list(enumerate(LM_TEXTS)), "doc_id long, text string").repartition(3)
    found = rows_of(lm.score(docs, "doc_id <> 6", block_tokens=tokens, part_bytes=part))
    scores, reads, n, v, _ = plain_backoff(LM_TEXTS, [t for i, t in enumerate(LM_TEXTS) if i != 6], lm.BACKOFF)
    for i, t in enumerate(LM_TEXTS):
        toks, r = [*words(t), "\n"], found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks), sum(reads[w] > 0 for w in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((reads[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks))
        assert r.score == pytest.approx(scores[i]), t


def test_every_state_is_a_distribution():
    from siftstone.llm import lm

    *_, reads, n, v, read = plain_backoff([], LM_TEXTS, lm.BACKOFF)
    for state in [(), ("a",), ("\n",), ("a", "b"), ("unseen", "c")]:
        assert sum(10 ** read(state, w) for w in [*reads, "a new word"]) == pytest.approx(1)


def test_texts_that_change_between_reads_are_told():
    from siftstone.llm import lm

    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (lm.unpack(lm.pack(keys)) == keys).all() and lm.unpack(lm.pack(keys[:0])).size == 0
    back, times = lm._unpack_keys(lm._pack_keys(keys, keys % np.uint64(300)))
    assert (back == keys).all() and (times == keys % np.uint64(300)).all()
    assert lm._mark(keys) != lm._mark(keys[1:])
    assert [len(keys[a:b]) for p in (1, 7) for a, b in zip(lm._bounds(keys, p), lm._bounds(keys, p)[1:])][0] == 1000


def test_without_training_texts_every_token_is_new(spark):
    from siftstone.llm import lm

    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(docs, "false").first()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


# ------------------------------------------------------------------- token index


def test_minimal_perfect_hash():
    from siftstone.llm.token_index import build_hash

    for n in (0, 1, 2, 5, 1000):
        _, slots = build_hash(np.random.default_rng(n).choice(10**9, n, replace=False))
        assert sorted(slots.tolist()) == list(range(n))


def test_index_round_trip(spark, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from siftstone.llm import token_index as X
    from siftstone.llm.common import shared_dir

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = X.write_index(odd, shared_dir(spark) + "/index", path, shard_rows=4)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in X.read_index(manifest).collect()]
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in ODD]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((i, ids) for i, _, ids in got), key=order) == sorted(expected, key=order)
    place = 0
    for _, start, ids in sorted(got, key=lambda x: x[1]):
        assert start == place
        place += len(ids)
    asked = spark.createDataFrame([(3,), (2,), (77,), (None,)], "doc_id long")
    assert sorted(r.doc_id or 0 for r in X.fetch(asked, manifest).collect()) == [0, 0, 2, 2, 3]


# ------------------------------------------------------------------------ quality


def test_quality_counts_equal_brute_force(spark, folder):
    from siftstone.llm.quality import op10_quality_ratio

    for where in (DATA, folder):
        docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()
        expected = []
        for r in docs:
            text = r.text or ""
            w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
            windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
            times, covered = Counter(windows), set()
            for k, x in enumerate(windows):
                if times[x] > 1:
                    covered.update(range(k, k + 8))
            failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
            expected.append((r.doc_id or -1, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed))
        out = op10_quality_ratio(spark, where).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == sorted(expected)
        assert not any(r.kept and r.base_failed for r in out)


def test_ratio_tells_trusted_words_from_others(spark):
    from siftstone.llm.quality import quality

    good = " ".join(f"fine{i}" for i in range(30))
    bad = " ".join(f"junk{i}" for i in range(30))
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)], "doc_id long, text string")
    trusted = docs.where("doc_id % 2 = 1").select("doc_id", F.lit(1).alias("trusted"))
    assert all(r.kept == bool(r.doc_id % 2) for r in quality(docs, trusted, buckets=512).collect())


# ----------------------------------------------------------------------- pipeline


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
    out = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) + ids.count(None) - (1 if None in ids else 0)
    assert 2 not in ids and 3 not in ids and all(r.n_tokens == len(r.ids) for r in out)


def test_texts_are_cut_into_units_alike_one_by_one_and_in_arrow():
    import public_tokenizers as P
    import pyarrow as pa

    from siftstone.llm.pretokens import have_lone_spaces, lone_spaces
    from siftstone.llm.token_index import Tokens

    texts = ["", " ", "a", "a b", "a  b", " a", "a\n", "a\nb", "a\n b", "a b", "a  b", "a\x1cb", "it's, 'it' x'y*** don't!! (a) [b].\n#c 1,2. é,ü! ¿no? a_b_ **", "<|endoftext|> a", "x\x85y", "日本 語。", "a\tb c", "THE!! END***"]
    assert have_lone_spaces(pa.array(texts)).to_pylist() == [lone_spaces(t) for t in texts]
    own = Tokens(P.path("byte_bpe_50k.json"), 2)
    assert own.encode(pa.array(texts)) == [own._pack([*own._of.encode(t, add_special_tokens=False).ids, 2]) for t in texts]
    assert own.encode(pa.array([], pa.string())) == []
