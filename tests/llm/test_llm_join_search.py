"""Forest join and block-max search against all-pairs versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import blockmax_search, forest_join
from tidemark.llm.common import WORD_BYTES, hashed_words


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(800)]
    docs = []
    for base in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        docs.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 1, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    seed = [rng.choice(words) for _ in range(150)]
    for i in range(90):  # one large group of near copies
        copy = list(seed)
        copy[rng.randrange(150)] = f"X{i}-é, (y)"
        docs.append(" ".join(copy))
    docs += ["short one", "short one", "", None, None, "  ", docs[0], docs[0], docs[-1]]
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@pytest.mark.parametrize("block", [384, 16])
def test_join_equals_all_pairs(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, class_id int, rep string").repartition(4)
    got = {r.doc_id: r for r in forest_join.jaccard_join(docs, block=block).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links, root = defaultdict(set), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a].add(b), links[b].add(a)
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for i in ids:
        copies = [j for j in ids if sets[i] and sets[j] == sets[i]] or [i]
        texts = {frozenset(sets[j]) for j in links[i]} - {frozenset(sets[i])}
        assert (got[i].class_id, got[i].text_class, got[i].n_copies, got[i].n_text_links, got[i].n_links) == \
            (find(i), min(copies), len(copies), len(texts), len(links[i])), i
    kept = sorted(r.doc_id for r in forest_join.keep_first(docs, block=block).collect())
    assert kept == sorted({find(i) for i in ids})


def test_join_edges(spark):
    schema = "doc_id bigint, text string"
    assert forest_join.jaccard_join(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "q " * 30000)], schema)
    got = sorted((r.doc_id or 0, r.class_id, r.n_copies, r.n_links) for r in forest_join.jaccard_join(docs).collect())
    assert got == [(0, None, None, None), (7, 7, 2, 1), (7, 7, 2, 1), (9, 9, 1, 0)]
    assert sorted((r.doc_id or 0) for r in forest_join.keep_first(docs).collect()) == [0, 7, 9]


def test_low_thresholds_get_more_trees(spark):
    assert forest_join.forest_shape() == (forest_join.TREES, forest_join.prefix_depth())
    for threshold in (0.05, 0.1, 0.2, 0.3, 0.4):
        trees, depth = forest_join.forest_shape(threshold)
        assert 1 - (1 - threshold ** depth) ** trees >= forest_join.TARGET
    # pairs with 6 of 30 words in common: 0.11
    rows = [(2 * i + j, " ".join([f"c{i}x{w}" for w in range(6)] + [f"o{i}y{j}z{w}" for w in range(24)])) for i in range(40) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = forest_join.jaccard_join(docs, size=1, threshold=0.1).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_prefix_depth_meets_the_target():
    for threshold in (0.5, 0.8, 0.95):
        d = forest_join.prefix_depth(threshold, 0.999)
        assert d == 1 or 1 - (1 - threshold ** d) ** forest_join.TREES >= 0.999


def test_recall_of_candidates():
    rng = np.random.default_rng(3)
    sign, met, n = forest_join.signer(forest_join.TREES, forest_join.prefix_depth()), 0, 600
    for _ in range(n):
        common = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 10, dtype=np.uint64)])) for _ in range(2))
        met += bool((sign(a) == sign(b)).any())
    assert met >= n - 3


def bm25(rows, queries, k):
    cut = re.compile(r"[^\x09-\x0d\x20-/:-@\[-`{-~]+")
    vectors = [(i, Counter(cut.findall((t or "").lower()))) for i, t in rows]
    n, mean = len(vectors), sum(sum(v.values()) for _, v in vectors) / len(vectors)
    df = Counter(t for _, v in vectors for t in v)
    out = {}
    for q, text in queries:
        wanted = Counter(cut.findall((text or "").lower()))
        scored = []
        for i, v in vectors:
            length = sum(v.values())
            parts = [v[t] * 2.2 / (v[t] + 1.2 * (0.25 + 0.75 * length / mean)) * (f * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)))
                     for t, f in wanted.items() if t in v]
            if parts:
                scored.append((-round(math.fsum(parts), 9), i))
        out[q] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("shard_docs", [1 << 14, 40])
def test_search_equals_scoring_everything(spark, shard_docs):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id bigint, text string, score double, rank int").repartition(3)
    queries = [(i, t) for i, t in rows if i % 4 == 0]
    got = defaultdict(list)
    for r in blockmax_search.top_k(docs, docs.filter("doc_id % 4 = 0"), k=5, shard_docs=shard_docs).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q, best in bm25(rows, queries, 5).items():
        assert [i for i, _ in got[q]] == [i for _, i in best]
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in best], rtol=1e-12)


def test_search_in_groups_of_queries(spark, monkeypatch):
    """Tasks that hold a group of queries and read several shards in turn give the same results."""
    monkeypatch.setattr(blockmax_search, "PARTS", 2)
    monkeypatch.setattr(blockmax_search, "GROUP_QUERIES", 9)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = defaultdict(list)
    for r in blockmax_search.top_k(docs, docs.filter("doc_id % 4 = 0"), k=5, shard_docs=30).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    assert dict(got) == {q: [i for _, i in best] for q, best in bm25(rows, [(i, t) for i, t in rows if i % 4 == 0], 5).items() if best}


def test_search_does_not_copy_documents_per_group_of_queries(spark, monkeypatch):
    """However many groups there are, documents are read where they are; a query id with two texts is ranked once."""
    monkeypatch.setattr(blockmax_search, "PARTS", 2)
    monkeypatch.setattr(blockmax_search, "GROUP_QUERIES", 9)
    plans, real = [], blockmax_search._found

    def found(*given):
        plans.append(real(*given))
        return plans[-1]

    monkeypatch.setattr(blockmax_search, "_found", found)
    rows = corpus()
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id bigint, text string")
    asked = spark.createDataFrame([(i % 20, t) for i, t in rows[:40]], "doc_id bigint, text string")
    got = blockmax_search.top_k(docs, asked, k=3, shard_docs=30).collect()
    texts = {(i % 20, t) for i, t in rows[:40]}
    assert len(plans) == -(-len(texts) // 9) > 1
    assert not any("Exchange" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert Counter(r.query_id for r in got) == dict.fromkeys(range(20), 3) and {r["rank"] for r in got} == {1, 2, 3}


def test_search_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "a"), (4, "..."), (1, "a b")], "doc_id bigint, text string")
    assert blockmax_search.top_k(empty, empty).count() == 0 and blockmax_search.top_k(some, empty).count() == 0
    assert [(r.query_id, r.doc_id) for r in blockmax_search.top_k(some, some).collect()] == [(1, 1), (1, 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té\x0b.x漢", max_size=60))
def test_word_hashes_tell_words_apart(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    hashes = hashed_words(text, WORD_BYTES).tolist()
    assert len(hashes) == len(words) and len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))


def test_hash_of_a_very_long_word():
    assert len(hashed_words("x" * 100_000 + " y", WORD_BYTES)) == 2


def test_ids_that_repeat_with_other_texts_lose_no_link_and_no_row(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (5, a), (8, None), (8, ""), (None, a)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.class_id, r.n_text_links) for r in forest_join.jaccard_join(table).collect() if r.doc_id is not None)
    assert got == [(5, 5, 1), (5, 5, 1), (5, 5, 1), (6, 5, 1), (7, 5, 1), (8, 8, 0), (8, 8, 0)]
    kept = sorted(((r.doc_id or 0, r.text or "") for r in forest_join.keep_first(table).collect()))
    assert kept == [(0, a), (5, a), (5, b), (8, ""), (8, "")]
