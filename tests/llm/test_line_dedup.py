import numpy as np
import pyarrow as pa
import pytest

from fernmark.llm import line_dedup, repeats
from tests.llm.fixtures import WHITE, documents, empty, lower, rows_of, sha


def brute(rows, least):
    keys = [[lower(x.strip(WHITE)) for x in (r["text"] or "").split("\n")] for r in rows]
    count = {}
    for k in keys:
        for key in set(k):
            count[key] = count.get(key, 0) + 1
    out = []
    for r, k in zip(rows, keys):
        kept = [x for x, key in zip((r["text"] or "").split("\n"), k) if not (key and count[key] >= least)]
        out.append((r["doc_id"], len(k), len(k) - len(kept), sha("\n".join(kept).encode())))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows_of(df)), key=str)


def test_against_brute_force(spark):
    docs = documents(spark)
    for least in (2, 10, 100):
        assert result(line_dedup.dedup_lines(docs, min_docs=least)) == brute(rows_of(docs), least)


@pytest.mark.parametrize("most", [0, 5])
def test_beyond_the_broadcast(spark, monkeypatch, most):
    """Filters are probed by shard, and all repeated keys, or all but the most frequent, are joined."""
    monkeypatch.setattr(repeats, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_ROWS", most)
    docs = documents(spark)
    for least in (2, 10):
        assert result(line_dedup.dedup_lines(docs, min_docs=least)) == brute(rows_of(docs), least)
    same = spark.createDataFrame([(k, "Same line\nown %d" % k) for k in range(4)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in rows_of(line_dedup.dedup_lines(same, min_docs=2, keep_first=True))} == {0: 0, 1: 1, 2: 1, 3: 1}


def test_long_lines_and_text_ids(spark):
    docs = spark.createDataFrame([(f"d{k}", "x" * 1_000_000 + "\n" + f"own {k}\n" * 50_000) for k in range(2)], "doc_id string, text string")
    assert sorted(r["n_dropped"] for r in rows_of(line_dedup.dedup_lines(docs, min_docs=2))) == [1, 1]


def test_repeated_hashes_pass_a_crowded_filter(monkeypatch):
    """With one bit a hash filters err often, but never against a repeated hash."""
    monkeypatch.setattr(repeats, "BLOOM_BITS", 1)
    h = np.arange(1, 5001, dtype=np.int64)
    parts = [h[k : k + 500] for k in range(0, len(h), 500)] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(p), np.int32)), pa.array(p), pa.array(np.zeros(len(p), bool))], ["shard", "h", "twice"]) for p in parts]
    bits = [b.column(2)[0].as_py() for b in repeats._filter(iter(batches))]
    assert repeats.opened({}, {0: bits}, np.zeros(len(h), np.int64), h.view(np.uint64)).all()


def test_keep_first_and_empty(spark):
    docs = spark.createDataFrame([(k, "Same line\nown %d" % k) for k in range(4)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in rows_of(line_dedup.dedup_lines(docs, min_docs=2, keep_first=True))}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_bloom_has_no_false_negatives():
    h = np.random.default_rng(0).integers(0, 1 << 63, 200_000, np.uint64)
    bloom = repeats.Bloom()
    bloom.add(h[:100_000])
    assert bloom.has(h[:100_000]).all()
    assert bloom.has(h[100_000:]).mean() < 0.02
