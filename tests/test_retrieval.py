import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.filters import Condition, Filter
from millrace.operators import context, fusion, lexical, vectors
from millrace.plans import retrieval

HIT = "query_id string, chunk_id string, score double, rank int, retriever string"


def corpus(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, content string")


def ask(spark, text):
    return spark.createDataFrame([("q", text)], "query_id string, query string")


def test_bm25_matches_only_what_shares_terms(spark):
    chunks = corpus(spark, [("a", "river stones under clear water"), ("b", "Lantern oil, lantern wick: trimmed"), ("c", "paper boats drift slowly"), ("e", None)])
    hits = lexical.bm25(ask(spark, "lantern WICK lantern"), lexical.build_index(chunks), 2).collect()
    assert [(h.chunk_id, h.rank, h.retriever, h.explanation) for h in hits] == [("b", 1, "bm25", "matched_terms=lantern,wick")]
    assert lexical.bm25(ask(spark, "harbour"), lexical.build_index(chunks)).count() == 0
    assert lexical.bm25(ask(spark, "é!"), lexical.build_index(chunks)).count() == 0
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    average = (5 + 5 + 4 + 0) / 4
    part = lambda tf: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 5 / average))
    assert hits[0].score == pytest.approx(part(2) + part(1), abs=1e-6)


def test_bm25_in_small_cells_agrees_with_the_formula(spark, monkeypatch, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"c{i}", " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randrange(1, 30)))) for i in range(120)] + [("c1", "w0 w29 w29")]
    asked = [(f"q{i}", " ".join(rng.sample(words, 4))) for i in range(15)]
    texts = [(c, t.split()) for c, t in rows]
    average = sum(len(t) for _, t in texts) / len(texts)
    df = {w: sum(w in t for _, t in texts) for w in words}
    want = {}
    for q, text in asked:
        score, held = {}, {}
        for c, t in texts:
            for w in set(text.split()) & set(t):
                tf = t.count(w)
                score[c] = score.get(c, 0) + math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / average))
                held.setdefault(c, set()).add(w)
        best = sorted((-round(x, 9), c) for c, x in score.items())[:5]
        want[q] = [(c, i + 1, "matched_terms=" + ",".join(sorted(held[c]))) for i, (_, c) in enumerate(best)]
    monkeypatch.setattr(lexical, "CHUNK_BLOCK", 17)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 4)
    lexical.build_index(corpus(spark, rows + rows[:5])).write(str(tmp_path))
    found = lexical.bm25(spark.createDataFrame(asked, "query_id string, query string"), lexical.LexicalIndex.read(spark, str(tmp_path)), 5).collect()
    assert {q: [(h.chunk_id, h.rank, h.explanation) for h in sorted(found, key=lambda h: h.rank) if h.query_id == q] for q, _ in asked} == want


def test_bm25_length_ties_and_filter(spark):
    chunks = corpus(spark, [("long", "hybrid search " + "filler " * 40), ("short", "hybrid search"), ("z", "tie word"), ("y", "tie word")])
    index = lexical.build_index(chunks)
    assert [h.chunk_id for h in lexical.bm25(ask(spark, "hybrid search"), index).orderBy("rank").collect()] == ["short", "long"]
    assert [h.chunk_id for h in lexical.bm25(ask(spark, "tie"), index).orderBy("rank").collect()] == ["y", "z"]
    allowed = spark.createDataFrame([("z",)], "chunk_id string")
    whole = {h.chunk_id: h.score for h in lexical.bm25(ask(spark, "tie"), index).collect()}
    assert [(h.chunk_id, h.score) for h in lexical.bm25(ask(spark, "tie"), index, allowed=allowed).collect()] == [("z", whole["z"])]
    with pytest.raises(ValueError):
        lexical.bm25(ask(spark, "x"), index, 0)


def test_rrf(spark):
    one = spark.createDataFrame([("q", "north", 0.9, 1, "dense"), ("q", "both", 0.4, 3, "dense")], HIT)
    two = spark.createDataFrame([("q", "south", 7.0, 1, "bm25"), ("q", "both", 5.0, 2, "bm25")], HIT)
    out = fusion.rrf([one, two], 10).orderBy("rank").collect()
    assert [o.chunk_id for o in out] == ["both", "north", "south"]
    assert out[0].score == pytest.approx(1 / 63 + 1 / 62) and out[0].explanation == "rrf_sources=dense#3,bm25#2"
    assert [o.chunk_id for o in fusion.rrf([one, two], 1, rank_constant=1000).collect()] == ["both"]


def test_rrf_counts_a_chunk_once_in_a_channel(spark):
    one = spark.createDataFrame([("q", "twice", 0.9, 1, "dense"), ("q", "twice", 0.2, 4, "dense")], HIT)
    two = spark.createDataFrame([("q", "once", 3.0, 1, "bm25")], HIT)
    out = fusion.rrf([one, two]).orderBy("rank").collect()
    assert [(o.chunk_id, round(o.score, 9)) for o in out] == [("once", round(1 / 61, 9)), ("twice", round(1 / 61, 9))]
    with pytest.raises(ValueError):
        fusion.rrf([])


def test_rerank_orders_by_raw_score(spark):
    hits = spark.createDataFrame([("q", c, 1.0, i, "x") for i, c in enumerate("abc", 1)], HIT)
    raw = {"a text": -2.0, "b text": 1.0, "c text": 0.0}
    chunks = corpus(spark, [(c, f"{c} text") for c in "abc"])
    out = fusion.rerank(hits, ask(spark, "q"), chunks, 2, score=lambda q, c: fusion.model_score(q, c, lambda pairs: [raw[p[1]] for p in pairs])).orderBy("rank").collect()
    assert [(o.chunk_id, o.rank, o.explanation) for o in out] == [("b", 1, "cross_encoder_raw_score=1.0"), ("c", 2, "cross_encoder_raw_score=0.0")]
    assert out[0].score == pytest.approx(0.7310585786)


def test_sigmoid_does_not_overflow(spark):
    row = spark.createDataFrame([(-1000.0,), (1000.0,), (0.0,)], "x double").select(fusion.sigmoid(F.col("x")).alias("y")).collect()
    assert [r.y for r in row] == [0.0, 1.0, 0.5]


def test_search_agrees_with_the_definition(spark):
    rows = [(f"c{i}", [math.cos(i), math.sin(i), 0.1 * i]) for i in range(60)] + [("nan", [float("nan"), 1.0, 1.0]), ("zero", [0.0] * 3), ("short", [1.0]), ("null", None), ("c1", [math.cos(1), math.sin(1), 0.1])]
    store = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([("q1", [1.0, 0.5, 0.2]), ("q2", [-1.0, 0.0, 0.0]), ("bad", None)], "query_id string, embedding array<float>")
    found = vectors.search(asked, store, 4, size=3).collect()
    pairs = asked.join(store, F.size(store.embedding) == 3).select("query_id", "chunk_id", vectors.cosine(asked.embedding, store.embedding).alias("s")).where("s is not null and not isnan(s)").distinct().collect()
    for q in ("q1", "q2"):
        want = sorted({(-round(p.s, 9), p.chunk_id) for p in pairs if p.query_id == q})[:4]
        assert [(h.chunk_id, h.rank) for h in sorted(found, key=lambda h: h.rank) if h.query_id == q] == [(c, i + 1) for i, (_, c) in enumerate(want)]
    assert not [h for h in vectors.search(asked, store, 60, min_score=0.0, size=3).collect() if h.score < 0]


def test_blocks_do_not_change_a_search(spark, monkeypatch):
    rows = [(f"c{i}", [math.cos(i), math.sin(i), 0.1 * i]) for i in range(60)]
    store = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    asked = store.select(F.col("chunk_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, vectors.search(asked, store, 3, size=3).collect()))
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 11)
    assert sorted(map(tuple, vectors.search(asked, store, 3, size=3).collect())) == whole


def test_upsert_delete_dimension(spark):
    store = spark.createDataFrame([("chunk-1", "tenant-a", 1), ("chunk-2", "tenant-b", 1)], "chunk_id string, tenant_id string, version int")
    changed = vectors.upsert(store, spark.createDataFrame([("chunk-1", "tenant-c", 1), ("chunk-3", "tenant-b", 1)], store.schema))
    assert sorted((r.chunk_id, r.tenant_id) for r in changed.collect()) == [("chunk-1", "tenant-c"), ("chunk-2", "tenant-b"), ("chunk-3", "tenant-b")]
    spec = Filter.exact(tenant_id="tenant-b")
    assert [r.chunk_id for r in vectors.delete(store, spec).collect()] == ["chunk-1"] and vectors.deleted_count(store, spec).first().deleted == 1
    with pytest.raises(ValueError):
        vectors.delete(store, Filter())
    bad = spark.createDataFrame([("a", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    with pytest.raises(Exception, match="embedding dimension must be 3"):
        vectors.check_dimension(bad, 3).collect()
    assert Filter((Condition("a", "eq", 1),)).is_empty is False


def test_embedding_by_model_and_by_hash(spark):
    df = corpus(spark, [("a", "x y"), ("b", None), ("c", "x y")])
    rows = {r.chunk_id: r.embedding for r in vectors.embed(df, lambda ts: [[3.0, 4.0] for _ in ts]).collect()}
    assert rows["a"] == pytest.approx([0.6, 0.8])
    hashed = {r.chunk_id: r.embedding for r in vectors.embed(df, size=8).collect()}
    assert hashed["a"] == hashed["c"] and sum(x * x for x in hashed["a"]) == pytest.approx(1.0) and set(hashed["b"]) == {0.0}


def test_two_stage_and_limits(spark):
    chunks = corpus(spark, [("chunk-1", "alpha"), ("chunk-2", "alpha beta"), ("chunk-3", "alpha beta gamma")])
    out = retrieval.two_stage(ask(spark, "beta gamma"), lambda n: lexical.bm25(ask(spark, "alpha"), lexical.build_index(chunks), n), chunks, 2, 3).orderBy("rank").collect()
    assert [o.chunk_id for o in out] == ["chunk-3", "chunk-2"]
    with pytest.raises(ValueError):
        retrieval.two_stage(ask(spark, "x"), lambda n: chunks, chunks, 5, 3)


def test_context_dedupes_and_stops(spark):
    hits = spark.createDataFrame([("q", "chunk-2", 1.0, 2, "x"), ("q", "chunk-1", 1.0, 1, "x"), ("q", "chunk-1", 1.0, 3, "x")], HIT)
    chunks = corpus(spark, [("chunk-1", "Alpha"), ("chunk-2", "Beta")])
    row = context.build_context(hits, chunks, 1000).first()
    assert (row.chunk_ids, row.deduplicated, row.truncated) == (["chunk-1", "chunk-2"], 1, False) and row.text == "[chunk-1]\nAlpha\n\n[chunk-2]\nBeta"
    row = context.build_context(hits, chunks, 18).first()
    assert (row.chunk_ids, row.truncated, row.character_count) == (["chunk-1"], True, 15)
    assert context.build_context(hits, chunks, 3).first().text == ""


def test_context_strictness_counts_every_separator(spark):
    hits = spark.createDataFrame([("q", f"c{i}", 1.0, i, "x") for i in (1, 2, 3)], HIT)
    chunks = corpus(spark, [(f"c{i}", "x") for i in (1, 2, 3)])
    assert len(context.build_context(hits, chunks, 20).first().chunk_ids) == 3 and len(context.build_context(hits, chunks, 20, strict=True).first().chunk_ids) == 2


def test_context_agrees_with_taking_one_by_one(spark):
    rng = random.Random(2)
    texts = {f"c{i:02}": "x" * rng.randrange(0, 40) for i in range(30)}
    hits = [(f"q{i % 7}", f"c{rng.randrange(34):02}", rng.choice([0.5, 0.7, None, float("nan")]), rng.randrange(1, 9), "r") for i in range(300)]
    df = spark.createDataFrame(hits, HIT)
    for strict in (False, True):
        found = {r.query_id: r for r in context.build_context(df, corpus(spark, list(texts.items())), 150, strict).collect()}
        for q in {h[0] for h in hits}:
            score = lambda s: float("inf") if s is None else float("-inf") if s != s else -s
            mine = sorted((h[3], score(h[2]), h[1]) for h in hits if h[0] == q and h[1] in texts)
            taken, copies, size, over = [], 0, 0, False
            for _, _, c in mine:
                if c in taken:
                    copies += 1
                    continue
                part = len(f"[{c}]\n{texts[c]}")
                gaps = 2 * len(taken) if strict else 2 * bool(taken)
                if size + part + gaps > 150:
                    over = True
                    break
                taken.append(c)
                size += part
            r = found[q]
            assert (r.chunk_ids, r.deduplicated, r.truncated) == (taken, copies, over) and r.text == "\n\n".join(f"[{c}]\n{texts[c]}" for c in taken)


def test_prompts(spark):
    r = context.PromptRegistry().register("answer", "1.0.0", "s", "u", activate=True).register("answer", "1.1.0", "s", "u2")
    assert r.get("answer")["version"] == "1.0.0" and r.activate("answer", "1.1.0").get("answer")["version"] == "1.1.0" and r.versions("answer") == ("1.0.0", "1.1.0")
    with pytest.raises(ValueError):
        r.register("answer", "1.0.0", "s", "u")
    with pytest.raises(ValueError):
        r.register("b", "1", " ", "u")
    with pytest.raises(LookupError):
        r.get("missing")
    p = spark.createDataFrame([("a", "1", "s"), ("a", "2", "s")], "name string, version string, system string")
    assert context.active_prompts(p, spark.createDataFrame([("a", "2")], "name string, version string")).first().version == "2"
