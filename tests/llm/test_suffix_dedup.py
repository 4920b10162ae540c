import random

import pytest

from fernmark.llm import suffix_dedup
from fernmark.llm.deep_shallow import common_prefix, sort_group
from tests.llm.fixtures import documents, empty, repeated_bytes, rows_of, sha


def check(df, docs, **options):
    rows = rows_of(docs)
    kept = repeated_bytes([r["text"] for r in rows], options.get("length", 400))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len((r["text"] or "").encode()) - len(k), n, sha(k)) for r, (k, n) in zip(rows, kept)), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(df)), key=str) == want


@pytest.mark.parametrize("length", [100, 400])
def test_against_brute_force(spark, length):
    docs = documents(spark)
    check(suffix_dedup.remove_repeats(docs, length=length), docs, length=length)


@pytest.mark.parametrize("most", [1, 3])
def test_split_groups(spark, most, monkeypatch):
    """Groups over the bound are split down to ranges of one offset."""
    monkeypatch.setattr(suffix_dedup, "MAX_BROADCAST_ROWS", 0)
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    docs = spark.createDataFrame([(k, "".join(rng.choices("xyz ", k=rng.randint(0, 80))) + passage[rng.choice([0, 10]) :] + "".join(rng.choices("uvw ", k=80))) for k in range(25)], "doc_id long, text string")
    check(suffix_dedup.remove_repeats(docs, length=120, max_group=most), docs, length=120)


def test_frequent_grams_and_contexts(spark, monkeypatch):
    """Anchors of a gram dealt to several tasks; of the repeated contexts the frequent ones are broadcast, the others joined."""
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    rng = random.Random(5)
    passages = ["".join(rng.choices("abcdefgh ", k=500)) for _ in range(3)]
    docs = spark.createDataFrame([(k, "".join(rng.choices("xyz ", k=rng.randint(0, 50))) + passages[0 if k < 20 else 1 + k % 2] + f"own {k} " * 9) for k in range(26)], "doc_id long, text string")
    for most in (1_000_000, 6):
        monkeypatch.setattr(suffix_dedup, "MAX_BROADCAST_ROWS", most)
        check(suffix_dedup.remove_repeats(docs, length=120), docs, length=120)


def test_text_ids_and_no_bytes(spark):
    docs = spark.createDataFrame([("a", "long " * 300), ("b", "long " * 300), (None, "c")], "doc_id string, text string")
    got = suffix_dedup.remove_repeats(docs, with_bytes=False)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r["doc_id"]: r["n_removed"] for r in rows_of(got)} == {"a": 1500, "b": 1500, None: 0}


def test_empty(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_long_texts_by_pieces(monkeypatch):
    rng = random.Random(0)
    text = bytes(rng.choices(b"abc", k=5000))
    whole = [(p.tolist(), h.tolist()) for _, p, h in suffix_dedup.anchors_of([text], 200)]
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    parts = [(p.tolist(), h.tolist()) for _, p, h in suffix_dedup.anchors_of([text], 200)]
    assert whole == parts


def test_sorting():
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice([b"a", b"ab", b"abc"])
        base = bytes(rng.choices(letters, k=rng.choice([0, 5, 100, 200])))
        strings = [base + bytes(rng.choices(letters, k=rng.choice([0, 1, 3, 9, 90]))) for _ in range(rng.randint(1, 12))]
        got = list(sort_group(strings, list(range(len(strings)))))
        assert [strings[i] for i, _ in got] == sorted(strings)
        assert all(lcp == common_prefix(strings[a], strings[b]) for (a, _), (b, lcp) in zip(got, got[1:]))
