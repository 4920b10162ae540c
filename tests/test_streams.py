"""Streams against their batch forms, cut anywhere and started again; sources that page; filters in chunks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernmark.operators import filters, segments
from fernmark.sources import paged
from fernmark.streaming import closing


@pytest.fixture
def rocksdb(spark):
    closing.with_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def flagged(seed, n=160, keys=4):
    rng = np.random.default_rng(seed)
    out, flag = [], {k: False for k in range(keys)}
    for i in range(n):
        k = int(rng.integers(keys))
        flag[k] = flag[k] ^ bool(rng.random() < 0.35)
        out.append((k, i, flag[k], 1000 + i * 10))
    return out


SCHEMA = "key long, at long, flag boolean, seconds long"


def run_stream(spark, source, out, log, per=1):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per).json(source)
    rows = rows.withColumn("ts", F.timestamp_seconds("seconds"))
    found = closing.closed_events(rows, "key", "at", "flag", "ts", least=2, gap=1, silence="3 hours")
    found.writeStream.option("checkpointLocation", log).foreachBatch(closing.append_once(out)).trigger(availableNow=True).start().awaitTermination()


def write_chunk(folder, number, rows):
    import os

    folder.mkdir(exist_ok=True)
    path = folder / f"{number:03}.json"
    path.write_text("".join(json.dumps(dict(zip(("key", "at", "flag", "seconds"), r))) + "\n" for r in rows))
    os.utime(path, (1_700_000_000 + number,) * 2)  # files are taken in the order of their times


@pytest.mark.parametrize("seed, cuts", [(1, [160]), (2, [1, 2, 50, 51, 120]), (3, [40, 80])])
def test_events_of_a_stream_cut_anywhere(spark, tmp_path, rocksdb, seed, cuts):
    rows = flagged(seed)
    want = segments.events(spark.createDataFrame(rows, SCHEMA), "key", "at", "flag", least=2, gap=1)
    source, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    edges = [0, *cuts, len(rows)]
    parts = [rows[a:b] for a, b in zip(edges, edges[1:]) if b > a]
    half = len(parts) // 2 + 1
    for number, part in enumerate(parts[:half]):
        write_chunk(source, number, part)
    run_stream(spark, str(source), out, log)  # stops here, and goes on after a restart
    for number, part in enumerate(parts[half:]):
        write_chunk(source, half + number, part)
    # Later rows of a key without flags move the watermark on, and so the timers of the keys that end.
    write_chunk(source, 900, [(99, 10_000, False, 100_000)])
    write_chunk(source, 901, [(99, 10_001, False, 200_000)])
    run_stream(spark, str(source), out, log)
    got = closing.appended(spark, out)
    assert sorted(map(tuple, got.select("key", "first", "last", "n").collect())) == sorted(map(tuple, want.select("key", "first", "last", "n").collect()))


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    write = closing.append_once(str(tmp_path / "t"))
    for number, n in ((0, 3), (1, 2), (1, 2), (2, 0)):
        write(spark.range(n), number)
    assert closing.appended(spark, str(tmp_path / "t")).count() == 5


def pages_of(folder, sizes):
    k = 0
    for number, n in enumerate(sizes, 1):
        rows = [{"id": str(k + i), "gen": "g", "q": "A" if i % 2 else None, "other": 1} for i in range(n)]
        (folder / f"p{number}.json").write_text(json.dumps({"numPages": len(sizes), "page": number, "recordings": rows}))
        k += n
    return f"file://{folder}/p{{page}}.json"


def test_pages_in_a_batch(spark, tmp_path):
    url = pages_of(tmp_path, [4, 4, 2])
    rows = paged.pages(spark, url)
    assert rows.rdd.getNumPartitions() == 3
    got = sorted(rows.collect(), key=lambda r: int(r.id))
    assert [r.id for r in got] == [str(k) for k in range(10)] and got[0].q is None and got[1].q == "A" and got[0].sp is None
    assert paged.pages(spark, pages_of(tmp_path, [0])).count() == 0


def test_pages_as_a_stream(spark, tmp_path):
    """Three pages, a restart, then the last page grows and a fourth comes."""
    (tmp_path / "in").mkdir()
    url, out, log = pages_of(tmp_path / "in", [4, 4, 2]), str(tmp_path / "out"), str(tmp_path / "log")

    def go(batches):
        query = paged.page_stream(spark, url).writeStream.option("checkpointLocation", log).foreachBatch(closing.append_once(out)).trigger(processingTime="100 milliseconds").start()
        query.processAllAvailable()
        query.stop()

    go(3)
    assert sorted(int(r.id) for r in closing.appended(spark, out).collect()) == list(range(10))
    pages_of(tmp_path / "in", [4, 4, 4, 3])
    go(2)
    assert sorted(int(r.id) for r in closing.appended(spark, out).collect()) == list(range(15))


def test_offsets_of_pages(tmp_path):
    url = pages_of(tmp_path, [3, 2])
    reader = paged.PagesStreamReader(["id"], url)
    start, ids = reader.initialOffset(), []
    for _ in range(4):
        rows, end = reader.read(start)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(start, end)) == rows
        ids, start = ids + rows, end
    assert ids == [(str(k),) for k in range(5)] and list(reader.readBetweenOffsets(reader.initialOffset(), start)) == ids


def test_filters_against_their_definition():
    """Gains by the analog formula at warped frequencies; half the power at the edges; recursion as written."""
    rate = 8000.0
    warp = lambda f: np.tan(np.pi * f / rate)
    for order in (1, 2, 3, 5):
        low, high, band = filters.butterworth(order, rate, high=900.0), filters.butterworth(order, rate, low=900.0), filters.butterworth(order, rate, 500.0, 1500.0)
        for f in (50.0, 400.0, 900.0, 1300.0, 3100.0):
            assert abs(filters.response(low, rate, f) - 1 / np.sqrt(1 + (warp(f) / warp(900)) ** (2 * order))) < 1e-6
            assert abs(filters.response(high, rate, f) - 1 / np.sqrt(1 + (warp(900) / warp(f)) ** (2 * order))) < 1e-6
            q = (warp(f) ** 2 - warp(500) * warp(1500)) / (warp(f) * (warp(1500) - warp(500)))
            assert abs(filters.response(band, rate, f) - 1 / np.sqrt(1 + q ** (2 * order))) < 1e-6
    x = np.random.default_rng(0).normal(size=200)
    sections = filters.butterworth(3, rate, 500.0, 1500.0)
    y = x.copy()
    for b0, b1, b2, a1, a2 in sections:
        out = np.zeros(len(y))
        for n in range(len(y)):
            past = lambda s, k, n=n: s[n - k] if n >= k else 0.0
            out[n] = b0 * y[n] + b1 * past(y, 1) + b2 * past(y, 2) - a1 * past(out, 1) - a2 * past(out, 2)
        y = out
    assert np.allclose(filters.run(sections, x)[0], y, atol=1e-12)
    for bad in ((None, None), (900.0, 500.0), (0.0, None), (None, 4000.0)):
        with pytest.raises(ValueError):
            filters.butterworth(2, rate, *bad)


def test_filters_in_chunks_and_rows(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=1000)
    sections = filters.butterworth(2, 8000.0, 500.0, 1500.0)
    whole = filters.run(sections, x)[0]
    state, parts = None, []
    for part in np.split(x, [1, 2, 400, 400, 999]):
        y, state = filters.run(sections, part, state)
        parts.append(y)
    assert np.array_equal(np.concatenate(parts), whole)
    got = spark.createDataFrame([(1, x.tolist()), (2, None), (3, [])], "id long, s array<double>").select("id", filters.filtered(F.col("s"), sections).alias("y")).orderBy("id").collect()
    assert np.array_equal(got[0].y, whole) and got[1].y is None and got[2].y == []
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k, part in enumerate(np.split(x, [10, 500])):
        (source / f"{k}.json").write_text("".join(json.dumps({"id": i, "seq": k, "samples": (part * i).tolist()}) + "\n" for i in (1, 2)))
    rows = spark.readStream.schema("id long, seq long, samples array<double>").json(str(source))
    filters.streamed(rows, sections).writeStream.option("checkpointLocation", str(tmp_path / "log")).foreachBatch(closing.append_once(out)).trigger(availableNow=True).start().awaitTermination()
    found = closing.appended(spark, out).orderBy("id", "seq").collect()
    assert np.allclose(np.concatenate([r.samples for r in found if r.id == 2]), 2 * whole)
