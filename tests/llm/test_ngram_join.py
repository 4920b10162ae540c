import random

import numpy as np
import pytest

from fernmark.llm import components, ngram_join
from fernmark.llm.shingles import Sets
from tests.llm.fixtures import component_ids, documents, empty, plain, rows_of, shingles


def check(spark, by_id):
    docs = spark.createDataFrame(sorted(by_id.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(ngram_join.jaccard_components(docs))}
    assert got == component_ids(by_id)


def edited(rng, words, share):
    return [rng.choice("qrst") + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed, monkeypatch):
    """Sets of every size with edits around the threshold, in small chunks and blocks."""
    rng = random.Random(seed)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    docs = {}
    for k, n in enumerate([1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 20, 21, 24, 40, 70, 130, 260, 300]):
        base = [f"w{rng.randint(0, 300)}" for _ in range(n)]
        for j in range(12):
            words = edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))
            docs[100 * k + j] = " ".join(words[: max(1, int(len(words) * rng.choice([1, 1, 0.9, 0.8, 0.76])))])
    check(spark, docs)


def test_passages_shared_by_many(spark):
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(40)]
    check(spark, {k: " ".join(passage + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.choice([0, 4, 8, 12, 40, 90]))]) for k in range(80)})


@pytest.mark.parametrize("tokens", [1 << 23, 60])
def test_blocks_by_centre(spark, monkeypatch, tokens):
    """A large group whose members are near its centre but for some, which link with each other or with few; chunks by sets or by shingles."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "TOKENS", tokens)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    docs = {k: " ".join(edited(rng, base, 0.01)) for k in range(40)}
    far = edited(rng, base, 0.04)  # half of its edits make a chain from the centre to texts that are unlike it
    for k in range(40, 70):
        docs[k] = " ".join(edited(rng, far, 0.02))
    check(spark, docs)
    alike = spark.createDataFrame([(None, docs[0])] * 30 + sorted(docs.items()), "doc_id long, text string")
    assert ngram_join.jaccard_components(alike).count() == 30 + len(docs)


def test_unlinked():
    assert ngram_join._unlinked(6, [(0, 1), (1, 2), (3, 4)], 2) == [3, 4, 5]


def test_keep_one(spark):
    """Rows that share an id are told apart by their texts; of rows alike one stays; names of columns don't matter."""
    a, b, near = (" ".join(f"{c}{k}" for k in range(50)) for c in "abn")
    near = a.replace("a25", "other")
    rows = [(3, a, "x"), (7, a, "x"), (7, b, "x"), (9, near, "x"), (None, b + " more", "x"), (5, "", "x"), (5, "", "x"), (6, None, "x"), (1, "solo one two three four five", "q"), (1, "solo one two three four five", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `fernmark` string").selectExpr("doc_id", "text", "fernmark as key", "fernmark as copies", "fernmark as component", "fernmark as rid")
    got = sorted(((r["doc_id"], r["text"], r["key"]) for r in rows_of(ngram_join.keep_one(docs))), key=str)
    want = sorted([(3, a, "x"), (7, b, "x"), (5, "", "x"), (5, "", "x"), (6, None, "x"), (1, "solo one two three four five", "p")], key=str)
    assert got == want and ngram_join.keep_one(docs).columns == docs.columns
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_frequent_short_texts(spark, monkeypatch):
    """Sets of 3 to 6 shingles whose shingles are hot, each with a variant that has one word more."""
    monkeypatch.setattr(ngram_join, "HOT", 16)
    docs = {}
    for n in (7, 8, 9):
        words = [f"w{n}_{k}" for k in range(n)]
        docs |= {1000 * n + k: " ".join(words) for k in range(60)}
        docs[1000 * n + 900] = " ".join([*words, "more"])
    check(spark, docs)


def test_cost_is_of_the_key():
    small, large = np.array([11, 12, 13, 14], np.uint64), np.array([11, 12, 13, 14, 15], np.uint64)
    sets = Sets(np.concatenate([small, large]), np.array([0, 4, 9]))
    for costs in ([5, 5, 5, 5, 0], [7, 2, 3, 4, 1], [0, 9, 9, 9, 9], [3, 1, 1, 2, 8]):
        of = dict(zip(large.tolist(), costs))
        owner, keys, cost = ngram_join.signatures(sets, 75, lambda tokens: np.array([of[t] for t in tokens.tolist()]))
        own = {k: c for o, k, c in zip(owner.tolist(), keys.tolist(), cost.tolist()) if o == 0}
        met = {k: c for o, k, c in zip(owner.tolist(), keys.tolist(), cost.tolist()) if o == 1 and k in own}
        assert met and all(own[k] == c for k, c in met.items())


def test_awkward_rows(spark, monkeypatch):
    docs = plain(spark)
    by_id = {r["doc_id"]: r["text"] for r in rows_of(docs)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(ngram_join.jaccard_components(docs))}
    assert got == component_ids(by_id)
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_ROWS", 0)
    odd = documents(spark)
    rows = rows_of(ngram_join.jaccard_components(odd))
    assert len(rows) == odd.count()
    assert sorted(r["n_shingles"] for r in rows) == sorted(len(shingles(r["text"])) for r in rows_of(odd))
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in rows_of(components.components(spark.createDataFrame(pairs, "u long, v long")))}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def test_linked_across_sides():
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 1, 100, 2)]
    assert {frozenset(p) for p in ngram_join.linked(sets, None, 75)} == {frozenset((0, 1)), frozenset((0, 3))} or len(ngram_join.linked(sets, None, 75)) == 2
    assert all({a, b} & {3} for a, b in ngram_join.linked(sets, np.array([0, 0, 0, 1]), 75))
