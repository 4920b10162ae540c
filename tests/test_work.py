"""Plans of work, views and collected values on small awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernmark.operators import collected, sampling, signal, views, worklists


def test_transcode_plan(spark):
    rows = [("raw/a.wav", 22050, 1, 16), ("raw/b.mp3", 44100, 2, 16), ("cache/c.wav", 44100, 1, 16), ("cache/d.wav", 22050, 1, 16), ("cache/e.mp3", 22050, 1, 16), ("cache/f.mp3", None, None, None)]
    recs = spark.createDataFrame(rows, "audio string, rate int, channels int, bits int")
    files = spark.createDataFrame([("cache/d.wav",), ("cache/d.wav",), ("cache/e.mp3.enc(wav)",)], "audio string")
    got = {r.audio: (r.output, r.resample, r.write, r.refused) for r in worklists.transcode_plan(recs, files, worklists.Target(22050, 1, 16, "wav")).collect()}
    assert got == {
        "raw/a.wav": ("raw/a.wav", False, True, "outside the cache"),
        "raw/b.mp3": ("raw/b.mp3.resample(22050,1,16).enc(wav)", True, True, "outside the cache"),
        "cache/c.wav": ("cache/c.wav.resample(22050,1,16).enc(wav)", True, True, "resampled before"),
        "cache/d.wav": ("cache/d.wav", False, False, None),
        "cache/e.mp3": ("cache/e.mp3.enc(wav)", False, False, None),
        "cache/f.mp3": ("cache/f.mp3.resample(22050,1,16).enc(wav)", True, True, "resampled before"),
    }
    assert worklists.Target(22050, 1, 16, "mp4", "64k", "aac").encoding == "enc(mp4,aac,64k)"
    twice = recs.where("audio = 'cache/e.mp3'").unionByName(recs.where("audio = 'cache/e.mp3'"))
    plan = worklists.transcode_plan(twice, files.limit(0), worklists.Target(22050, 1, 16, "mp3", "64k"))
    assert [tuple(r) for r in worklists.to_write(plan).collect()] == [("cache/e.mp3.enc(mp3,64k)", "cache/e.mp3", False)]


def test_numbers_as_shown(spark):
    values = [None, 0.0, 0.0009, 0.0234, 0.5, 0.999, 1.0, 5.67, 9.96, 10.0, 12.5, 13.5, 1234.5, -0.5, float("nan")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    assert [r.s for r in df.select("k", views.shown(F.col("v")).alias("s")).orderBy("k").collect()] == ["", "0", "0", ".023", ".5", "1.0", "1.0", "5.7", "10.0", "10", "12", "14", "1234", "-0.5", ""]


def test_views_of_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "<p>a &amp; b</p>", ["<i>x</i>", "y"], "A, B, C", 3.14159, 2019.0, "05-07")], "id int, t string, l array<string>, p string, n double, y double, md string")
    got = views.record_view(df, keep=["id"], texts=["t"], lists=["l"], places=["p"], numbers=["n"], dates={"d": ("y", "md")}).orderBy("id").collect()
    assert tuple(got[0]) == (1, "", "", "", "", "") and tuple(got[1])[2:] == ("x y", "C, B, A", "3.1", "2019-05-07")


def test_collected_values(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "y"), ("a", 2, None), ("a", 1, "x"), (None, 5, "q")], "k string, o int, v string")
    got = {r.k: r.v for r in collected.lists_per_key(df, ["k"], "v", ["o"]).collect()}
    assert got == {"a": ["x", "y", "z"], None: ["q"]}
    assert {r.k: r.v for r in collected.lists_per_key(df, ["k"], "v", ["o"], most=2).collect()} == {"a": ["x", "y"], None: ["q"]}
    pairs = spark.createDataFrame([("a", "n", 1, 9.0), ("a", "n", 2, 5.0), ("a", "m", 1, None), ("a", None, 1, 1.0)], "k string, name string, o int, v double")
    assert [r.map for r in collected.map_per_key(pairs, ["k"], "name", "v", ["o"]).collect()] == [{"m": None, "n": 5.0}]
    one = spark.createDataFrame([(1, "a", "b"), (1, "a", None), (2, None, "c")], "g int, x string, y string")
    got = {r.g: (r.x, r.y, r.n) for r in collected.passed_through(one, ["g"], ["x", "y"], [F.count("*").alias("n")]).collect()}
    assert got == {1: ("a", "b", 2), 2: (None, "c", 1)}
    with pytest.raises(Exception, match="x differs within a group: a, b"):
        collected.passed_through(spark.createDataFrame([(1, "a"), (1, "b")], "g int, x string"), ["g"], ["x"], []).collect()


def test_split_of_one_large_class(spark):
    """All rows in one class, repeated keys, single rows and nulls: the same rows as one ordering of the class would give."""
    rows = [(k % 300, "big") for k in range(900)] + [(1, "one"), (2, "two"), (3, "two"), (4, None)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = sampling.stratified_split(df, "label", "id", 0.21, "s")
    assert got.count() == 903 and got.columns == ["id", "label", "is_test"]
    plain = sorted((r.d, r.id) for r in df.where("label = 'big'").select(sampling.draw("id", "s").alias("d"), "id").collect())
    want = sorted(i for _, i in plain[: -(-900 * 21 // 100)])
    assert sorted(r.id for r in got.where("is_test AND label = 'big'").collect()) == want
    assert got.where("is_test AND label = 'two'").count() == 1 and got.where("is_test AND label = 'one'").count() == 0


def test_cosine_transform_against_its_definition():
    """Coefficients of mel decibels by sums over bands, standardised by row."""
    mel = np.random.default_rng(0).normal(size=(8, 5))
    want = np.array([[sum(mel[b, t] * np.cos(np.pi * k * (2 * b + 1) / 16) for b in range(8)) * np.sqrt((1 if k == 0 else 2) / 8) for t in range(5)] for k in range(4)])
    assert np.allclose(signal.mfcc(mel, 4, standardise=False), want)
    flat = (want - want.mean(axis=1, keepdims=True)) / want.std(axis=1, keepdims=True)
    assert np.allclose(signal.mfcc(mel, 4), flat)
    assert (signal.mfcc(np.ones((8, 3)), 4) == 0).all()
