import numpy as np
import pytest
from pyspark.sql import functions as F

from fernmark.operators import clustering, dedup, evals, lookup, models, priors, profile, sampling, search, signal, taxonomy


def test_coverage_error(spark):
    df = spark.createDataFrame([(1, "b", [0.2, 0.6, 0.2]), (2, "b", [0.5, 0.3, 0.3]), (3, "a", [0.9, 0.1, 0.0]), (4, "z", [0.4, 0.1, 0.3])], "i int, y string, s array<double>")
    got = df.orderBy("i").select(evals.coverage_error(F.array(*map(F.lit, "abc")), F.col("s"), F.col("y"))).collect()
    assert [r[0] for r in got] == [1.0, 3.0, 1.0, float("inf")]


def test_confusion(spark):
    df = spark.createDataFrame([("b", [0.5, 0.5]), ("b", [0.1, 0.9]), ("a", [0.8, 0.2])], "y string, s array<double>")
    got = {(r["y"], r["class"]): (round(r["total"], 6), round(r["share"], 6)) for r in evals.confusion(df, "y", ["a", "b"], F.col("s")).collect()}
    assert got == {("a", "a"): (0.8, 0.8), ("a", "b"): (0.2, 0.2), ("b", "a"): (0.6, 0.3), ("b", "b"): (1.4, 0.7)}


def test_counters(spark):
    df = spark.createDataFrame([("x", "CORA", 2, 2), ("x", "WREN", 1, 2), ("y", "CORA", 2, 3), ("y", "CALT", 3, 3)], "bin string, kind string, n_present long, n long")
    got = {r["kind"]: (r["n_present"], r["n"], round(r["p"], 3)) for r in priors.add_counters(df, [], "kind").collect()}
    assert got == {"CORA": (4, 5, 0.8), "WREN": (1, 5, 0.2), "CALT": (3, 5, 0.6)}


def test_sketches_are_close(spark):
    df = spark.range(20000).select((F.col("id") % 3).alias("bin"), F.col("id").alias("checklist"), F.lit("k").alias("kind"))
    got = priors.merge_sketched(priors.presence_sketched(df, ["bin"], "checklist", "kind").withColumn("all", F.lit(0)), ["all"], "kind").first()
    assert abs(got["n"] - 20000) < 600 and got["n_present"] == got["n"]


def test_lookup(spark):
    species = spark.createDataFrame([("sonspa", "SOSP", "Song Sparrow", "Melospiza melodia", 1), ("wlswar", "WIWA", "Wilson's Warbler", "Cardellina pusilla", 2)], "species_code string, banding_code string, com_name string, sci_name string, taxon_order int")
    asked = ["SOSP", "sosp", "song sparrow", "melospiza melodia", "WIWA", "wilson's warbler", "does-not-exist", "", "a, b"]
    got = {r["query"]: r["species_code"] for r in taxonomy.lookup(spark.createDataFrame([(q,) for q in asked], "query string"), species).collect()}
    assert [got[q] for q in asked] == ["sonspa"] * 4 + ["wlswar"] * 2 + [None, None, "_MUL"]
    names = {r["species_code"]: r["shorthand"] for r in taxonomy.shorthands(species.withColumn("banding_code", F.lit("SOSP"))).collect()}
    assert names == {"sonspa": "SOSP", "wlswar": "Wilson's Warbler"}
    assert taxonomy.with_synthetic(species).count() == 5


def test_cascade(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "q", "y"), (3, None, None)], "i int, k1 string, k2 string")
    t1, t2 = spark.createDataFrame([("a", "A")], "k string, v string"), spark.createDataFrame([("x", "X"), ("y", "Y")], "k string, v string")
    got = lookup.cascade(df, [(t1, "k1", "k"), (t2, "k2", "k")], "v", "?").orderBy("i").collect()
    assert [r["v"] for r in got] == ["A", "Y", "?"]


def test_samples_repeat(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("g"))
    a, b = (sorted(r.id for r in sampling.sample_per_group(df.repartition(n), "g", "id", 3, "s").collect()) for n in (2, 9))
    assert a == b and len(a) == 21
    split = sampling.stratified_split(df, "g", "id", 0.2).where("is_test").count()
    assert split == sum(-(-n * 2 // 10) for n in [72] * 3 + [71] * 4)
    assert sampling.funnel(df, "g", "id").count() == 500


def test_latest_and_missing(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (3, 1, "c")], "k int, v int, x string")
    assert sorted((r.k, r.x) for r in dedup.latest(df, ["k"], "v").collect()) == [(1, "b"), (3, "c")]
    assert sorted(r.k for r in dedup.missing_ids(df, "k", 4).collect()) == [0, 2]


def test_filters(spark):
    df = spark.createDataFrame([("A", "p", "s1", "g1"), ("B", "p", "s2", "g1"), ("A", "q", "s3", "g2")], "quality string, place string, species string, species_group string")
    count = lambda **k: df.where(search.Filters(**k).condition()).count()
    assert (count(), count(quality=["A"]), count(places=[]), count(exclude_groups=["g1"], include_species=["s2"])) == (3, 2, 0, 2)


def test_search_kinds(spark):
    rows = [(k, f"s{k % 3}", "g", [float(k), 1.0]) for k in range(12)]
    df = spark.createDataFrame(rows, "id long, species string, species_group string, vector array<double>")
    assert search.run(df, search.Query("none")).count() == 0
    assert [r.id for r in search.run(df, search.Query("species", "s1", n=2)).collect()] == [10, 7]
    assert search.run(df, search.Query("random", n=3)).select("species").distinct().count() == 3
    found = search.run(df, search.Query("rec", 11, n=4, per_group=2)).collect()
    assert len(found) == 4 and all(r.id != 11 for r in found)


def test_profile_and_requirements(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert {r["column"]: (r["n_null"], r["n_distinct"]) for r in profile.summary(df).collect()} == {"a": (0, 2), "b": (1, 1)}
    with pytest.raises(ValueError):
        profile.require_columns(df, ["c"])
    with pytest.raises(ValueError):
        profile.require_rows(df.limit(0))


def test_agglomeration_against_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 3))
    for method in ("ward", "complete", "average"):
        tree = clustering.merges(x, method)
        clusters = {k: [k] for k in range(12)}
        for k, (a, b, d) in enumerate(tree):
            def far(p, q):
                pairs = [np.linalg.norm(x[i] - x[j]) for i in clusters[p] for j in clusters[q]]
                if method == "ward":
                    n, m = len(clusters[p]), len(clusters[q])
                    return np.linalg.norm(x[clusters[p]].mean(0) - x[clusters[q]].mean(0)) * (2 * n * m / (n + m)) ** 0.5
                return max(pairs) if method == "complete" else np.mean(pairs)

            best = min(far(p, q) for p in clusters for q in clusters if p < q)
            assert abs(far(a, b) - best) < 1e-9 and abs(d - best) < 1e-9
            clusters[12 + k] = clusters.pop(a) + clusters.pop(b)
        assert sorted(clustering.leaf_order(12, tree)) == list(range(12))
        assert len(set(clustering.cut(12, tree, 4))) == 4


def test_classifier_names(spark):
    df = models.with_features(spark.createDataFrame([(float(k % 2), [float(k % 2), 1.0 + k % 3]) for k in range(30)], "label double, v array<double>"), "v")
    for name in ("nb", "std-logreg,maxIter=5", "rf,numTrees=3", "ovr-logreg"):
        fitted = models.classifier(name).fit(df).transform(df)
        assert fitted.where("prediction = label").count() == 30
    with pytest.raises(ValueError):
        models.classifier("xyz")


def test_spectrogram_of_a_sine():
    rate, hz = 22050, 22050 * 32 / 512
    f, t, s = signal.spectrogram(np.sin(2 * np.pi * hz * np.arange(8192) / rate), rate)
    assert s.shape == (257, 31) and abs(f[s.mean(axis=1).argmax()] - hz) < 1e-9
    assert np.allclose(s.max(axis=0), 0.5, atol=1e-3)
    quiet = signal.quiet_runs(np.r_[np.ones(100), np.zeros(200), np.ones(50)], 10, 0.5, 50)
    assert quiet == [(100, 300)]
    passed = signal.band_pass(np.sin(2 * np.pi * hz * np.arange(8192) / rate), rate, 0, hz / 2)
    assert abs(passed).max() < 0.2
    assert signal.mfcc(signal.mel_db(np.random.default_rng(0).normal(size=4096), rate)).shape[0] == 13


def test_top_groups(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], [1.0, float(k)]) for k in range(12)], "id long, g string, v array<double>")
    p = spark.createDataFrame([("a", 0.2), ("b", 0.7), ("c", 0.1)], "g string, p double")
    one = df.where("id = 0")
    several = search.top_groups(df, one, "v", "id", "g", 2, 6, p).collect()
    assert [r["g"] for r in several] == ["b", "b", "a", "a"]
    assert search.top_groups(df.where("g = 'a'"), one, "v", "id", "g", 2, 6, p).count() == 5
    assert search.top_groups(df.limit(0), one, "v", "id", "g", 2, 6, p).count() == 0


def test_order_of_taxa(spark):
    species = spark.createDataFrame([("x", 30), ("y", 10), ("z", 20)], "species string, taxon_order int")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "?")], "id int, species string")
    got = {r.id: r.taxon_ord for r in taxonomy.with_ordinal(rows, species, "species", [F.col("taxon_order")]).collect()}
    assert got == {1: 2, 2: 0, 3: None}


def test_nearest_neighbour_cache_of_merges():
    """Rows whose neighbour was merged away are looked at again: no merge may be dearer than a brute-force minimum."""
    rng = np.random.default_rng(9)
    for n in (2, 3, 40):
        x = np.round(rng.normal(size=(n, 2)), 1)
        tree = clustering.merges(x, "average")
        assert len(tree) == n - 1 and all(a[2] <= b[2] + 1e-9 for a, b in zip(tree, tree[1:]))


def test_small_sides_are_counted(spark):
    from fernmark import scratch

    df = spark.range(10)
    assert scratch.under(df, 10) and not scratch.under(df, 9)
    assert "hint" in scratch.small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in scratch.small(df, 9)._jdf.queryExecution().logical().toString().lower()


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from fernmark import scratch

    session = lambda master, where: SimpleNamespace(conf={"spark.checkpoint.dir": where} if where else {}, sparkContext=SimpleNamespace(master=master, applicationId="a"))
    with pytest.raises(RuntimeError):
        scratch.path(session("spark://host:7077", None), "x")
    with pytest.raises(RuntimeError):
        scratch.path(session("local-cluster[2,1,1024]", None), "x")
    assert scratch.path(session("spark://host:7077", "hdfs://shared/"), "x").startswith("hdfs://shared/x-")
