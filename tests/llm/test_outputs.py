"""Token files, Elias-Fano codes and media."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fernmark.llm import elias_fano, media, piece_encoder, token_output
from tests.llm.fixtures import documents, empty, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 10**12), (1000, 10**6), (1000, 900), (513, 10**10)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top, n))
    data = elias_fano.encode(values)
    code = elias_fano.EliasFano(data)
    assert np.array_equal(code.decode(), values)
    assert [code.select(i) for i in range(0, n, 7)] == values[::7].tolist()
    some = np.random.default_rng(1).integers(0, max(n, 1), 50 if n else 0)
    assert np.array_equal(code.select_many(some), values[some]) and np.array_equal(code.select_many(np.arange(n)), values)
    with pytest.raises(IndexError):
        code.select_many([n])
    if n == 1000:
        assert len(data) * 8 < n * (3.2 + np.log2(top / n + 1)) + 600


def test_pieces_equal_the_library(monkeypatch):
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(0)
    texts = ["", None, " ", "\n", "it's 'tis ''s 're'll  don't '", "x  \n y\t\tz ", "<|endoftext|> a", "naïve 12½ ①a　b", " " * 3000 + "a", "b" * 2000 + " c", "\x1c\x1da", "日本 語!! 😀😀"]
    texts += ["".join(rng.choices(" \n'\tas tre1½!é日", k=rng.randint(0, 40))) for _ in range(2000)]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = piece_encoder.PieceEncoder(PATH)
    for chunk in (1 << 20, 50):
        monkeypatch.setattr(piece_encoder, "_CHUNK", chunk)
        ids, n = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_pieces_whose_hashes_collide():
    """With all hashes of a length alike, texts still get the library's ids."""
    tok = Tokenizer.from_file(PATH)
    encoder = piece_encoder.PieceEncoder(PATH)
    encoder._mult[:] = 0
    texts = ["one two six ten", "ten one", "", "two two", " odd\n"]
    ids, n = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Long texts fill blocks of their own; rows without an id are dealt by their texts."""
    monkeypatch.setattr(token_output, "_BYTES_AT_ONCE", 50_000)
    docs = spark.createDataFrame([(None, f"{k} " + "word " * 20_000) for k in range(12)], "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_output.write_token_files(docs, str(tmp_path / "t"), PATH, block_ids=10_000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = rows_of(spark.read.parquet(str(tmp_path / "t")))
    assert len(blocks) == 12 and len({b["shard"] for b in blocks}) > 1
    got = rows_of(token_output.read_token_files(spark, str(tmp_path / "t")))
    assert sum(r["n_tokens"] for r in got) == sum(len(Tokenizer.from_file(PATH).encode(r["text"]).ids) + 1 for r in rows_of(docs))


def test_fetch(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text number {k} " * (k % 50)) for k in range(2000)], "doc_id long, text string")
    token_output.write_token_files(docs, str(tmp_path / "t"), PATH, block_ids=5000)
    tok = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r["ids"] for r in rows_of(token_output.fetch(spark, str(tmp_path / "t"), [0, 700, 701, 1999, 5000]))}
    assert got == {k: [*tok.encode(f"text number {k} " * (k % 50)).ids, 0] for k in (0, 700, 701, 1999)}


def test_token_files_round_trip(spark, tmp_path):
    docs = documents(spark)
    token_output.write_token_files(docs, str(tmp_path / "t"), PATH, block_ids=500)
    got = sorted(rows_of(token_output.read_token_files(spark, str(tmp_path / "t"), with_ids=True)), key=lambda r: r["start"])
    tok = Tokenizer.from_file(PATH)
    rows = sorted(rows_of(docs), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    start = 0
    for g, r in zip(got, rows):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        assert (g["start"], g["n_tokens"], g["ids"], g["ids_crc32"]) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_output.token_output(empty(spark), PATH).count() == 0


def test_media_round_trip(spark, monkeypatch):
    for most in (64 << 20, 0):  # by a filter, and by a join
        monkeypatch.setattr(media, "MAX_FILTER_BYTES", most)
        docs = documents(spark)
        got = sorted((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows_of(media.media_column(docs)) if r["doc_id"] is not None)
        want = []
        for r in rows_of(docs):
            b = (r["text"] or "").encode()
            p = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
            if r["doc_id"] is not None:
                want.append((r["doc_id"], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
        assert got == sorted(want)
    assert media.media_column(empty(spark)).count() == 0


def test_each_shared_chunk_is_stored_once(spark, tmp_path):
    passage = " ".join(str(k) for k in range(4000))
    docs = spark.createDataFrame([(k, ("" if k % 2 else f"own {k} " * 400) + passage) for k in range(12)] + [(99, "alone")], "doc_id long, text string").repartition(5)
    path = str(tmp_path / "m")
    media.write_media(docs, path)
    chunks = [bytes(r["bytes"]) for r in rows_of(spark.read.parquet(f"{path}/chunks"))]
    assert len(chunks) == len(set(chunks)) and sum(map(len, chunks)) > len(passage) * 0.8
    own = [bytes(c) for r in rows_of(spark.read.parquet(f"{path}/documents")) for c in r["own"]]
    assert len(own) == len(set(own)) and not set(own) & set(chunks)


@pytest.mark.parametrize("what", ["chunks", "documents"])
def test_changed_bytes_are_found(spark, tmp_path, what):
    """One byte of a moved chunk, or of one kept with its document, differs."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, "shared by both " * 300 + f"and {k} " * 300) for k in range(2)], "doc_id long, text string")
    path = str(tmp_path / "m")
    media.write_media(docs, path)
    assert media.read_media(spark, path).count() == 2
    flip = lambda b: F.unhex(F.concat(F.substring(F.hex(b), 1, 20), F.lit("00"), F.substring(F.hex(b), 23, 1 << 20)))
    table = spark.read.parquet(f"{path}/{what}")
    table = table.withColumn("bytes", flip(F.col("bytes"))) if what == "chunks" else table.withColumn("own", F.transform("own", flip))
    rows = table.collect()
    spark.createDataFrame(rows, table.schema).write.mode("overwrite").parquet(f"{path}/{what}")
    with pytest.raises(Exception, match="differ from their digests"):
        media.read_media(spark, path).collect()


def test_media_of_long_texts_and_text_ids(spark):
    docs = spark.createDataFrame([("a", "long " * 400_000), ("b", None), (None, "c")], "doc_id string, text string")
    got = {r["doc_id"]: r["n_bytes"] for r in rows_of(media.media_column(docs))}
    assert got == {"a": 2_000_000, "b": 0, None: 1}


def test_equal_texts_have_equal_media(spark):
    docs = spark.createDataFrame([(k, "same text " * 500) for k in range(4)], "doc_id long, text string")
    assert len({tuple(v for k, v in r.items() if k != "doc_id") for r in rows_of(media.media_column(docs))}) == 1


def test_cuts():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 100_000, np.uint8)
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= media.MIN and sizes.max() <= media.MAX
    moved = media.cuts(np.concatenate([rng.integers(0, 256, 100, np.uint8), data]))
    assert len({e - 100 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert media.cuts(np.zeros(20_000, np.uint8))[-1] == 20_000
