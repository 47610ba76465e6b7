import random
import re

import numpy as np
import pytest

from millrace.llm import neardup
from millrace.llm.queries import QUERIES

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, threshold=0.7):
    sets = {}
    for key, text in rows:
        tokens = [t.lower() for t in re.findall(r"[A-Za-z0-9_]+|[一-鿿]", text or "")]
        if key is not None and len(tokens) >= 30:
            sets[key] = set(zip(tokens, tokens[1:]))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = [rng.choice(WORDS)]
    return words


def records(seed=5):
    rng = random.Random(seed)
    rows = []
    for f in range(30):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(40, 160))]
        for v in range(4):
            rows.append((f"k{f}-{v}", " ".join(edited(rng, base, v * 4))))
        if f % 5 == 0:
            rows.append((f"k{f}-up", " ".join(base).upper() + " !"))
    rows += [("null", None), ("blank", "  "), ("short", "a b c"), (None, rows[0][1]), rows[0], ("zh", "检索构建器在写入之前会校验每一批记录因此多语言路径的延迟能够稳定" * 2)]
    return rows


@pytest.mark.parametrize("block", [4096, 2])
def test_all_pairs_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = records()
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "chunk_id string, content string, cls string")
    found = {(r.a, r.b) for r in neardup.near_pairs(df).collect()}
    assert found == brute(rows) and found


def test_many_copies_make_a_star_and_groups(spark):
    base = " ".join(WORDS[:60])
    rows = [(f"c{i:03}", base) for i in range(100)] + [("near", base + " tail")] + [("far", " ".join(WORDS[100:160]))]
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    found = {(r.a, r.b) for r in neardup.near_pairs(df).collect()}
    assert found == {("c000", f"c{i:03}") for i in range(1, 100)} | {("c000", "near")}
    groups = {r.id: r for r in neardup.near_groups(df).collect()}
    assert {g.group_id for k, g in groups.items() if k != "far"} == {"c000"} and groups["far"].group_id == "far"
    assert groups["c005"].copies == 100 and groups["near"].copies == 1


@pytest.mark.parametrize("page,fan", [(8, 2), (8, 3), (4, 8), (32, 8), (1000, 8)])
def test_pages_lose_no_pair(page, fan):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 3, (40, neardup.GROUPS))
    counts = np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < p), 0) for p in (0, 0.1, 0.3)]).astype(np.uint8)
    n = counts.sum(1).astype(int)
    x, y = neardup.page_pairs(n, counts, 0.7, page=page, fan=fan)
    assert len(set(zip(x.tolist(), y.tolist()))) == len(x)
    fits = {(i, j) for i in range(len(n)) for j in range(i) if np.minimum(counts[i], counts[j]).sum() >= 0.7 / 1.7 * (n[i] + n[j]) - 1e-9}
    assert {(max(a, b), min(a, b)) for a, b in zip(x.tolist(), y.tolist())} == fits


def test_empty_table_and_bad_threshold(spark):
    df = spark.createDataFrame([], "chunk_id string, content string")
    assert neardup.near_pairs(df).count() == 0 and neardup.near_groups(df).count() == 0
    with pytest.raises(ValueError):
        neardup.near_pairs(df, threshold=0)


@pytest.mark.parametrize("block", [4096, 8])
def test_query_gives_all_pairs_of_large_classes(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    base = " ".join(WORDS[:60])
    rows = [(f"c{i:03}", (base, base.upper() + " !", base.replace(" ", ",  "))[i % 3]) for i in range(40)]
    rows += [("near", base + " tail"), ("far", " ".join(WORDS[100:160]))]
    spark.createDataFrame(rows, "chunk_id string, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    found = [(r.chunk_id_a, r.chunk_id_b) for r in QUERIES["p7_found"](spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) == 41 * 40 // 2 and set(found) == brute(rows)


def test_one_key_with_two_contents(spark):
    one, two = WORDS[:60], WORDS[100:160]
    rows = [("a", " ".join(one)), ("a", " ".join(two)), ("b", " ".join([*one, "tail"])), ("c", " ".join([*two, "tail"]))]
    df = spark.createDataFrame(rows * 2, "chunk_id string, content string").coalesce(1)
    assert {(r.a, r.b) for r in neardup.near_pairs(df).collect()} == {("a", "b"), ("a", "c")}


def test_groups_are_the_components_of_all_pairs(spark, monkeypatch):
    rows = records(8)
    rng = random.Random(1)
    chain = [[rng.choice(WORDS) for _ in range(100)]]
    while len(chain) < 25:  # each only like its neighbours
        chain.append(edited(rng, chain[-1], 6))
    rows += [(f"chain{i:02}", " ".join(w)) for i, w in enumerate(chain)]
    group = {k: k for k, t in rows if k is not None and len((t or "").split()) >= 30 or k == "zh"}
    links = brute(rows)
    for _ in range(len(group)):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    found = neardup.near_groups(spark.createDataFrame(rows, "chunk_id string, content string")).collect()
    assert {r.id: r.group_id for r in found} == group and len(found) == len(group)
    assert len({g for k, g in group.items() if k.startswith("chain")}) < 6


@pytest.mark.parametrize("popular", [50_000, 0])
def test_a_family_of_many_near_copies(spark, monkeypatch, popular):
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "MOST_POPULAR", popular)
    base = [f"{w}" for w in WORDS[:120]]
    rows = [(f"f{i:04}", " ".join([*base, f"n{i}"])) for i in range(600)]
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    assert {r.group_id for r in neardup.near_groups(df).collect()} == {"f0000"}
    assert neardup.near_pairs(df).count() == 600 * 599 // 2


@pytest.mark.parametrize("most", [1 << 27, 0])
def test_texts_are_sieved_or_joined(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "MOST_BITS", most)
    rows = records(3)
    found = {(r.a, r.b) for r in neardup.near_pairs(spark.createDataFrame(rows, "chunk_id string, content string")).collect()}
    assert found == brute(rows)
