"""Importance resampling against a plain version with dictionaries."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from fernmark.llm import postings, resampling
from tests.llm.fixtures import documents, empty, lower, rows_of


def features(text, n=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return [" ".join(w[k : k + m]) for m in range(1, n + 1) for k in range(len(w) - m + 1)], len(w)


def brute(docs, target, n=1, buckets=10_000, percent=10, min_words=20):
    """doc_id, n_features, weight, score, of which the highest are drawn; ties by what comes first."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, n)[0])
    t = Counter(bucket(f) for x in target for f in features(x, n)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, text in docs:
        f, words = features(text, n)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= min_words))
    able = sorted(x[3] for x in out if x[4])[::-1]
    return sorted(str(x[:4]) for x in out), able[: percent * len(able) // 100]


@pytest.mark.parametrize("hot, n", [(10_000, 1), (1 << 40, 1), (10_000, 3)])
def test_awkward_rows(spark, monkeypatch, hot, n):
    """Small blocks and pieces, keys salted or not, runs of up to three words."""
    monkeypatch.setattr(postings, "HOT_KEYS", hot)
    monkeypatch.setattr(postings, "BLOCK_BYTES", 3000)
    docs = documents(spark).repartition(3)
    target = spark.createDataFrame([("alpha3 beta7 gamma1",), (None,), ("",), ("All RIGHTS reserved",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in rows_of(docs)]
    got = rows_of(resampling.resample(docs, target, max_n=n, percent=30).select("row.doc_id", "n_features", "weight", "score", "rank"))
    want, drawn = brute(rows, [r["text"] for r in rows_of(target)], n, percent=30)
    assert sorted(str((r["doc_id"], r["n_features"], r["weight"], r["score"])) for r in got) == want
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [r["score"] for r in ranked] == drawn
    places = [(-r["score"], r["doc_id"] is not None, r["doc_id"] or 0) for r in ranked]
    assert places == sorted(places)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(resampling, "_PIECE", 7)
    text = "Ein wort, und noch-eins Ä日 " * 20 + "x" * 50
    for n in (1, 2, 3):
        keys, texts, fields = resampling._inverter(n, 97)()([text, None, "a b"])
        want = Counter((zlib.crc32(f.encode()) % 97, k) for k, t in enumerate([text, None, "a b"]) for f in features(t, n)[0])
        assert Counter(zip(keys.tolist(), texts.tolist())) == want
        assert fields["n_words"] == [features(text)[1], 0, 2]


def test_no_target_and_no_rows(spark):
    docs = documents(spark)
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(docs, nothing).count() == docs.count()
    assert rows_of(resampling.resample(empty(spark), nothing)) == []


def test_carried_columns(spark):
    docs = documents(spark)
    got = rows_of(resampling.resample(docs, docs, carry=("text", "key")).select("row.*", "rank"))
    assert sorted(str((r["doc_id"], r["text"], r["key"])) for r in got) == sorted(str((r["doc_id"], r["text"], r["key"])) for r in rows_of(docs))
