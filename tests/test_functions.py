"""Golden values of the column functions. Week bins, geohash cells and media types are fixed values: any right implementation has these."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fernmark.functions import arrays, bars, dates, geo, intervals, text, vectors


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_weeks(spark):
    rows = spark.createDataFrame([(dt.date(2019, m, d),) for m in range(1, 13) for d in (1, 7, 8, 14, 15, 21, 22, 28)], "d date")
    got = [r[0] for r in rows.select(dates.week(F.col("d"))).collect()]
    assert got == [4 * (m - 1) + q for m in range(1, 13) for q in (0, 0, 1, 1, 2, 2, 3, 3)]
    assert [one(spark, dates.normal_week(F.lit(k)))[0] for k in (-1, 48, 1234)] == [47, 0, 1234 % 48]
    weeks = spark.range(48).select(dates.week(dates.first_day(F.col("id"), 2019)).alias("w"))
    assert [r.w for r in weeks.collect()] == list(range(48))


@pytest.mark.parametrize(
    "width, week, bins",
    [(1, 42, [41, 42]), (1, 0, [0, 47]), (1, 5, [4, 5]), (2, 43, [42, 44]), (2, 47, [0, 46]), (2, 1, [0, 2]), (3, 44, [42, 45]), (3, 47, [0, 45]), (4, 44, [40, 44]), (4, 46, [0, 44]), (6, 44, [36, 42]), (6, 45, [0, 42]), (12, 42, [0, 36]), (24, 5, [0, 24]), (48, 42, [0])],
)
def test_enclosing_bins(spark, width, week, bins):
    day = dates.first_day(F.lit(week), 2019)
    assert one(spark, dates.enclosing_bins(day, width))[0] == bins


def test_geohash(spark):
    want = {1: "0", 3: "8", 5: "9", 7: "9h", 9: "9q", 11: "9q0", 13: "9q8", 15: "9q9", 17: "9q9h", 19: "9q9n", 21: "9q9ph", 23: "9q9pw", 25: "9q9px", 27: "9q9px8", 29: "9q9pxf", 31: "9q9pxg0"}
    got = one(spark, *[geo.geohash(F.lit(37.9), F.lit(-122.0), b).alias(str(b)) for b in want])
    assert got.asDict() == {str(b): h for b, h in want.items()}


@pytest.mark.parametrize("bits, cells", [(1, "0 h"), (3, "0 4 8 d"), (5, "8 9 b c"), (9, "9h 9k 9n 9q"), (15, "9q8 9q9 9qb 9qc"), (21, "9q9ph 9q9r0 9qc0h 9qc20")])
def test_smooth(spark, bits, cells):
    assert one(spark, geo.smooth(F.lit(37.9), F.lit(-122.0), bits))[0] == cells.split()


@pytest.mark.parametrize("cell, bits, around", [("9b", 15, "3xz 3zb 3zc 98p 98r 9b0 9b1 9b2 9b3"), ("9b", 10, "3x 3z 6p 98 99 9b 9c d0 d1"), ("9b", 3, "0 4 8 d n w"), ("9b", 2, "0 8 h s"), ("9b", 1, "0 h"), ("9b", 0, "")])
def test_expand(spark, cell, bits, around):
    assert one(spark, geo.expand(F.lit(cell), bits))[0] == around.split()


@pytest.mark.parametrize("bits, cut", [(15, "9b0"), (10, "9b"), (9, "9b"), (8, "98"), (6, "90"), (5, "9"), (4, "8"), (1, "0"), (0, "")])
def test_cut(spark, bits, cut):
    assert one(spark, geo.at_bits(F.lit("9b"), bits))[0] == cut


def test_box(spark):
    x, y = geo.cell_of_text(F.lit("9q9px"), 25)
    got = one(spark, *[F.round(v, 2).alias(k) for k, v in geo.box(x, y, 25).items()]).asDict()
    assert got == {"south": 37.88, "west": -122.04, "north": 37.92, "east": -121.99}


def test_bars(spark):
    got = [one(spark, bars.bar_width(F.lit(p)))[0] for p in (0.0, 0.003, 0.05, 0.59, 0.6, 1.0)]
    assert got == [1, 2, 4, 8, 9, 9]
    assert one(spark, bars.bar(F.lit(0.05)))[0] == "■" * 4 + "—" * 5


def test_vectors(spark):
    a, b, zero = (F.array(*map(F.lit, v)) for v in ([3.0, 4.0], [4.0, 3.0], [0.0, 0.0]))
    got = one(spark, vectors.dot(a, b), vectors.norm(a), F.round(vectors.cosine(a, b), 6), vectors.l1(a, b), F.round(vectors.l2(a, b), 6), vectors.cosine(a, zero), vectors.surprise(F.lit(1.0)), vectors.surprise(F.lit(0.0)))
    assert tuple(got) == (24.0, 5.0, 0.04, 2.0, 1.414214, None, 0.0, float("inf"))


def test_patches(spark):
    m = F.array(*[F.array(*map(F.lit, r)) for r in ([1.0, 2.0, 3.0, 4.0, 5.0], [3.0, 4.0, 5.0, 6.0, 7.0], [5.0, 6.0, 7.0, 8.0, 9.0])])
    got = one(spark, arrays.transpose(arrays.patches(m, 2)), arrays.patches(m, 6))
    assert got[0] == [[1, 2, 3, 4], [2, 3, 4, 5], [3, 4, 5, 6], [4, 5, 6, 7], [5, 6, 7, 8], [6, 7, 8, 9]]
    assert got[1] == []


def test_array_summaries(spark):
    a = F.array(*map(F.lit, [1.0, 2.0, 4.0, 8.0]))
    got = one(spark, *[F.round(f(a), 6).alias(k) for k, f in arrays.SUMMARIES.items()]).asDict()
    assert got["median"] == 3.0 and got["dmean"] == round(7 / 3, 6) and got["d2mean"] == 1.5 and got["std"] == round(7.1875**0.5, 6)
    assert one(spark, arrays.mean(F.array().cast("array<double>")))[0] is None


@pytest.mark.parametrize("audio, want", [("foo.wav.enc(wav)", "foo.wav"), ("x.resample(a).resample(a)", "x.resample(a)"), ("x.mp3.enc(wav)", "x.mp3.enc(wav)"), ("x.enc(a).enc(a).slice(1,2)", "x.enc(a).slice(1,2)")])
def test_simplified(spark, audio, want):
    assert one(spark, text.simplified(F.lit(audio)))[0] == want


@pytest.mark.parametrize("audio, want", [("foo.wav", "audio/wav"), ("foo.mp3.slice(1,2).enc(mp4,aac,64k)", "audio/mp4"), ("foo.xxx", None), ("foo.wav.resample(22050,1,16)", None)])
def test_media_type(spark, audio, want):
    assert one(spark, text.media_type(F.lit(audio)))[0] == want


def test_fields(spark):
    kind, detail = text.license_parts(F.lit("http://creativecommons.org/licenses/by-nc-sa/4.0/"))
    got = one(spark, kind, detail, text.repaired_date(F.lit("2012-00-00")).cast("string"), text.repaired_date(F.lit("1600-01-01")), text.repaired_date(F.lit("x")), text.hour_of(F.lit("25:00")), text.hour_of(F.lit("7:30")))
    assert tuple(got) == ("by-nc-sa", "4.0", "2012-01-01", None, None, None, 7)
    got = one(spark, text.checklist_id(F.lit(None).cast("string"), F.lit("S12")), text.checklist_id(F.lit("G7"), F.lit("S12")), text.strip_html(F.lit("<p>a &amp; <b>b</b></p>\n c")))
    assert tuple(got) == (12, -7, "a & b c")
    assert text.snake_case("COMMON NAME") == "common_name" and text.snake_case("MediaId") == "media_id"
    assert one(spark, text.abbreviated(F.lit("Town, California, United States"), {"California": "CA", "United States": "US"}))[0] == "US, CA, Town"


def test_browse_removes_only_the_first_run(spark):
    tokens = F.array(F.lit("wilsons"), F.lit("warbler"))
    got = one(spark, text.browse_matches("wilson's warb", tokens), text.browse_matches("zz/war", tokens), text.browse_matches("zz", tokens), text.browse_matches("", tokens))
    assert tuple(got) == (True, True, False, True)


def test_intervals(spark):
    a, b, c = (intervals.interval(F.lit(x), F.lit(y)) for x, y in ((0, 10), (2, 3), (11, float("inf"))))
    got = one(spark, intervals.overlaps(a, b), intervals.covers(a, b), intervals.overlaps(a, c), intervals.contains(c, F.lit(99)), intervals.clamp(F.lit(12), a), intervals.intersection(a, c), intervals.json_number(F.lit(float("-inf"))))
    assert tuple(got) == (True, True, False, True, 10.0, None, '"-Infinity"')
