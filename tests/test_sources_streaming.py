import json

import numpy as np

from fernmark.sources import readers, sinks
from fernmark.streaming import aggregates, framing


def test_fixed_width_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "xc 1", "call,song"), ("2", "xc 2", "call")], "i string, xc_id string, handtype string")
    sinks.fixed_width(df, str(tmp_path / "f"), {"i": 3, "xc_id": 8, "handtype": 12})
    back = readers.fixed_width(spark, str(tmp_path / "f"), ["i", "xc_id", "handtype"], key="xc_id")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_multi_label(spark, tmp_path):
    (tmp_path / "x.txt").write_text("rec_id,[labels]\n0\n1,2,3\n2,?\n")
    got = {r.id: r.labels for r in readers.multi_label(spark, str(tmp_path / "x.txt")).collect()}
    assert got == {0: [], 1: [2, 3], 2: None}


def test_csv_and_snapshots(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("COMMON NAME\tCOUNT\nWren\t1\n")
    assert readers.csv_columns(spark, str(tmp_path / "t.tsv"), ["COMMON NAME"]).first().common_name == "Wren"
    for k in (1, 2):
        (tmp_path / f"s{k}.json").write_text(f'{{"id": 1, "v": {k}}}\n')
    assert readers.snapshots(spark, str(tmp_path / "s*.json"), "id int, v int", "id").first().v == 2


def test_catalogue(spark):
    raw = spark.createDataFrame([("7", "Melospiza", "melodia", "", "Song Sparrow", "R", "US", "a, b", "1.5", "x", "song", "n", "2012-00-00", "?", "//c.org/licenses/by/4.0/", "u", "f")], ", ".join(f"{c} string" for c in "id gen sp ssp en rec cnt loc lat lng type q date time lic url file".split()))
    r = readers.catalogue(raw).first()
    assert (r.id, r.sci_name, r.lat, r.lng, r.quality, r.quality_ord, str(r.date), r.time, r.license_type) == (7, "Melospiza melodia", 1.5, None, "no score", 6, "2012-01-01", None, "by")


def test_page_fields(spark):
    html = '<meta property="og:title" content="XC12 Song Sparrow (Melospiza melodia)"/><meta property="og:description" content="bird-seen:yes\nnice one"/><table><tr><td>Country</td><td>US</td></tr></table>'
    r = readers.page_fields(spark.createDataFrame([(html,)], "html string")).first()
    assert (r.id, r.com_name, r.sci_name, r.remarks, r.flags, r.fields) == (12, "Song Sparrow", "Melospiza melodia", "nice one", {"bird-seen": "yes"}, {"country": "US"})


def test_materialize_and_exports(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, "s", [3.0, 4.0]), (2, "t", [1.0, 0.0])], "id long, species string, v array<double>")

    df = [sinks.materialize(spark, str(tmp_path), "x", "v1", build) for _ in range(2)][1]
    assert built == [1] and df.count() == 2
    sinks.export_search(df, str(tmp_path / "e"), vector="v", n=2, id_col="id", sort=["species"])
    assert sorted(spark.read.parquet(str(tmp_path / "e")).columns) == ["id", "norm_v", "species", "v_0", "v_1"]
    sinks.by_species(df, str(tmp_path / "b"), "species")
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    sinks.key_map(df, "id", "species", str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() == 2


def test_frames_do_not_depend_on_chunks(spark, tmp_path):
    rng = np.random.default_rng(0)
    whole = {k: rng.normal(size=int(rng.integers(40, 90))).tolist() for k in (1, 2)}
    source, seq = tmp_path / "in", 0
    source.mkdir()
    for k, x in whole.items():
        at = 0
        while at < len(x):
            n = int(rng.integers(1, 17))
            spark.createDataFrame([(k, seq, x[at : at + n])], "id long, seq long, samples array<double>").coalesce(1).write.mode("append").json(str(source))
            at, seq = at + n, seq + 1
    stream = spark.readStream.schema("id long, seq long, samples array<double>").option("maxFilesPerTrigger", 1000).json(str(source))
    query = framing.frames(stream, 16, 8).writeStream.format("memory").queryName("framed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.id, r.frame): r.samples for r in spark.table("framed").collect()}
    want = {(k, j): f.tolist() for k, x in whole.items() for j, f in enumerate(framing.cut(np.array(x), 16, 8)[0])}
    assert got == want


def test_chunked_frames_equal_whole():
    x = np.arange(100.0)
    for step in (1, 7, 33):
        held, out = np.zeros(0), []
        for k in range(0, 100, step):
            found, held = framing.cut(np.concatenate([held, x[k : k + step]]), 16, 8)
            out += found
        assert np.array_equal(np.stack(out), np.stack(framing.cut(x, 16, 8)[0]))


def test_upsert_and_online_clusters(spark, tmp_path):
    path = str(tmp_path / "u")
    merge = aggregates.upsert_latest(path, "k", "v", buckets=4)
    batches = {0: [(k, 1) for k in range(40)], 1: [(1, 2), (2, 1)], 4: [(3, 9), (3, 8), (50, 1)], 5: []}
    want = {}
    for n, rows in batches.items():
        for _ in range(2):  # runs again, and finds the versions before it
            merge(spark.createDataFrame(rows, "k int, v int"), n)
        for k, v in rows:
            want[k] = max(v, want.get(k, 0))
        assert dict(map(tuple, aggregates.upserted(spark, path).collect())) == want
    data = {int(p.name): sum(1 for b in p.iterdir() if b.is_dir()) for p in (tmp_path / "u" / "data").iterdir()}
    assert data[4] <= 2 and 0 < data.get(0, 4) <= 4 and len(list((tmp_path / "u" / "versions").iterdir())) <= 2  # untouched buckets are left alone
    model = aggregates.OnlineSphericalKMeans(np.eye(2))
    model(spark.createDataFrame([([1.0, 0.1],)], "v array<double>"), 0)
    other = aggregates.OnlineSphericalKMeans(np.eye(2))
    other.update(np.array([[1.0, 0.1]]))
    assert np.allclose(model.centres, other.centres) and model.hits.tolist() == [2, 1]


def test_running_range(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0)], "k string, v double")
    assert {r.k: (r.low, r.high) for r in aggregates.running_range(df, "k", "v").collect()} == {"a": (1.0, 5.0), "b": (2.0, 2.0)}


def test_paged_service(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"page{k}.json").write_text(json.dumps({"recordings": [{"id": str(10 * k + j), "gen": "G", "sp": "s"} for j in range(2)]}))
    got = readers.paged_json(spark, f"file://{tmp_path}/page{{page}}.json", 2)
    assert sorted((r.id, r.gen, r.q) for r in got.collect()) == [("10", "G", None), ("11", "G", None), ("20", "G", None), ("21", "G", None)]


def test_sqlite_files(spark, tmp_path):
    df = spark.createDataFrame([(k, [k], b"x", None if k % 2 else 0.5) for k in range(25)], "id long, a array<int>, b binary, d double").repartition(3)
    sinks.sqlite_files(df, str(tmp_path / "s"), "recs", rows_a_file=4)
    found = []
    for r in spark.read.parquet(str(tmp_path / "s")).collect():
        rows = sinks.open_sqlite(bytes(r["database"])).execute("SELECT id, a, b, d FROM recs").fetchall()
        assert len(rows) == r["n"] <= 4
        found += rows
    assert sorted(found) == [(k, f"[{k}]", b"x", None if k % 2 else 0.5) for k in range(25)]
    sinks.sqlite_files(df.limit(0), str(tmp_path / "e"), "recs")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 0


def test_compressed_latin1(spark, tmp_path):
    import gzip

    (tmp_path / "t.csv.gz").write_bytes(gzip.compress("name,n\nDürer é,2\n".encode("latin-1")))
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "t.csv.gz"), "name string, n int", encoding="ISO-8859-1").collect()] == [("Dürer é", 2)]


def test_trimmed_and_manifest(spark, tmp_path):
    dim, used = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2,), (2,)], "k int")
    assert [tuple(r) for r in sinks.trimmed(dim, used, "k").collect()] == [(2, "b")]
    sinks.json_lines(dim, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), "k int, v string").count() == 2
    assert readers.files(spark, str(tmp_path / "j"), "*.json").where("length > 0").count() >= 1


def test_tags(spark):
    df = spark.createDataFrame([("{}",), ('{"version": 3, "species": "sosp", "edits": [{"clips": [{"time": {"lo": 1, "hi": 2}}]}]}',), (None,)], "tags string")
    got = [r.m for r in df.select(readers.tag_metadata().alias("m")).collect()]
    assert [(m.version, m.species, m.quality) for m in got] == [(0, "_UNK", "no score"), (3, "sosp", "no score"), (0, "_UNK", "no score")]
    assert got[1].edits[0].clips[0].time.hi == 2 and got[1].edits[0].clips[0].gain is None


def test_range_of_a_stream(spark, tmp_path):
    for k, rows in enumerate([[("a", 1.0), ("b", 4.0)], [("a", -2.0)], [("b", 9.0), ("a", 0.0)]]):
        spark.createDataFrame(rows, "k string, v double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    result = aggregates.running_range(stream, "k", "v").writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "c"))
    result.foreachBatch(aggregates.keep_result(str(tmp_path / "out"))).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, aggregates.last_result(spark, str(tmp_path / "out")).collect())) == [("a", -2.0, 1.0, 3), ("b", 4.0, 9.0, 2)]
