"""Queries and operators without SQL, against closed forms and second implementations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernmark import catalog
from fernmark.operators import clustering, evals, models, projection, search, signal
from fernmark.streaming import aggregates


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["embedding"] for r in rows], float)


def result(spark, sf_dir, name, column):
    return {r["vec_id"]: r[column] for r in catalog.QUERIES[name](spark, sf_dir).collect()}


def test_kmeans_is_a_fixpoint(spark, sf_dir, vectors):
    """Each vector is in the cluster whose mean is nearest, but for those that the last rounds of a run moved."""
    ids, _, x = vectors
    got = result(spark, sf_dir, "kmeans_labels", "cluster")
    own = np.array([got[k] for k in ids])
    assert sorted(set(own)) == list(range(8))
    means = np.stack([x[own == k].mean(axis=0) for k in range(8)])
    nearest = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == own).mean() > 0.9


def brute_spherical(x, ids, k, rounds=100, moved=0.01):
    import hashlib

    order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(str(ids[i]).encode()).hexdigest(), ids[i]))
    centres = np.stack([x[i] / np.linalg.norm(x[i]) for i in order[:k]])
    before = None
    for step in range(rounds):
        best = [int(np.argmax([c @ v for c in centres])) for v in x]
        if step and sum(a != b for a, b in zip(best, before)) <= moved * len(x):
            break
        before, sums = best, centres.copy()
        for v, b in zip(x, best):
            sums[b] = sums[b] + v * (v @ centres[b])
        centres = np.stack([s / np.linalg.norm(s) for s in sums])
    return best


def test_spherical_kmeans_query(spark, sf_dir, vectors):
    ids, _, x = vectors
    got = result(spark, sf_dir, "spherical_kmeans_labels", "cluster")
    want = brute_spherical(x, ids.tolist(), 8)
    assert np.mean([got[k] == w for k, w in zip(ids.tolist(), want)]) > 0.99


def test_spherical_kmeans_finds_groups(spark):
    """First centres are drawn by the md5 of ids: here one of each group."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal([5, 0], 0.1, (40, 2)), rng.normal([0, 5], 0.1, (40, 2))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    want = brute_spherical(x, list(range(80)), 2)
    assert {r.id: r.cluster for r in clustering.spherical_kmeans(df, "id", "v", 2)[1].collect()} == dict(enumerate(want))


def naive_order(x):
    """Ward by definition: the pair whose union adds least to the sum of squares; children in the order of their numbers."""
    trees, names, n = {k: ((k,), k) for k in range(len(x))}, list(range(len(x))), len(x)
    while len(names) > 1:
        def cost(p, q):
            a, b = trees[p][0], trees[q][0]
            return len(a) * len(b) / (len(a) + len(b)) * ((x[list(a)].mean(0) - x[list(b)].mean(0)) ** 2).sum()

        p, q = min(((p, q) for i, p in enumerate(names) for q in names[i + 1 :]), key=lambda pq: cost(*pq))
        trees[n] = (trees[p][0] + trees[q][0], (p, q))
        names = [k for k in names if k not in (p, q)] + [n]
        n += 1

    def leaves(k):
        return [k] if k < len(x) else leaves(trees[k][1][0]) + leaves(trees[k][1][1])

    top = trees[n - 1][1]
    order = leaves(n - 1)
    return order[::-1] if len(trees[top[0]][0]) < len(trees[top[1]][0]) else order


def test_leaf_order_query(spark, sf_dir, vectors):
    ids, labels, x = vectors
    got = {r["vec_id"]: r["sort_order"] for r in catalog.QUERIES["agglom_leaf_order"](spark, sf_dir).collect()}
    assert len(got) == len(ids)
    for label in (0, 3):
        mine = np.flatnonzero(labels == label)
        unit = x[mine] / np.linalg.norm(x[mine], axis=1, keepdims=True)
        assert [got[k] for k in ids[mine][naive_order(unit)].tolist()] == list(range(len(mine)))


def test_pca_query(spark, sf_dir, vectors):
    """Eigenvectors of the correlation matrix, up to sign."""
    ids, _, x = vectors
    got = result(spark, sf_dir, "pca_projection", "projected")
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, axes = np.linalg.eigh(z.T @ z)
    want = z @ axes[:, ::-1][:, :4]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    found = np.array([got[k] for k in ids.tolist()])
    assert np.allclose(np.abs(found), np.abs(want), atol=2e-4)
    shares = models.pca_normalised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", 4)[1]
    assert np.allclose(shares, values[::-1][:4] / values.sum())
    table = models.variance_table(shares)
    assert [r["component"] for r in table] == [0, 1, 2, 3] and abs(table[-1]["upto"] - sum(shares)) < 1e-12


def series(spark, sf_dir):
    """Each supplier's prices in the order of their lines."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").toPandas().sort_values(["l_orderkey", "l_linenumber", "l_extendedprice"])
    return {k: g["l_extendedprice"].to_numpy() - 38_000 for k, g in rows.groupby("l_suppkey")}



def test_loudest_mel_bands(spark, sf_dir):
    """The band whose triangle weighs a tone's frequency most, give or take one: the window spreads a tone over three lines."""
    rows = {r["id"]: r["loudest_band"] for r in catalog.QUERIES["mel_of_tones"](spark, sf_dir).collect()}
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 11025 / 700), 42) / 2595) - 1)
    bank = np.array([[max(0, min((hz - a) / (b - a), (c - hz) / (c - b))) * 2 / (c - a) for hz in np.arange(257) * 22050 / 512] for a, b, c in zip(edges, edges[1:], edges[2:])])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(512) / 512)
    prices = {k: x for k, x in series(spark, sf_dir).items() if len(x) >= 512}
    assert rows.keys() == prices.keys() and rows
    for k, x in prices.items():
        frames = [x[at : at + 512] for at in range(0, len(x) - 511, 256)]
        power = np.array([np.abs(np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(512)) / 512) @ ((f - f.mean()) * window)) / window.sum() * 256 for f in frames]).T ** 2
        db = 10 * np.log10(np.maximum(1e-10, bank @ power))
        assert rows[k] == int(np.argmax(np.maximum(db, db.max() - 80).sum(axis=1)))


def test_hll_query(spark, sf_dir):
    exact = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("d"), "user_id").distinct().count()
    rows = catalog.QUERIES["event_presence_hll"](spark, sf_dir).collect()
    assert abs(sum({r["bin4"]: r["n"] for r in rows}.values()) - exact) <= max(2, 0.03 * exact) and all(r["n_present"] <= r["n"] * 1.03 for r in rows)


def test_classifier_on_rows_it_has_not_seen(spark, sf_dir, vectors):
    """Gaussian naive Bayes, written out."""
    ids, labels, x = vectors
    got = result(spark, sf_dir, "classifier_coverage", "coverage")
    held = np.isin(ids, list(got))
    assert 0 < held.sum() < len(ids) / 3
    logs = []
    for c in range(10):
        mine = x[(labels == c) & ~held]
        mean, var = mine.mean(axis=0), mine.var(axis=0)
        logs.append(np.log(len(mine)) - 0.5 * (np.log(var) + (x[held] - mean) ** 2 / var).sum(axis=1))
    logs = np.stack(logs, axis=1)
    own = logs[np.arange(held.sum()), labels[held]]
    want = (logs >= own[:, None]).sum(axis=1)
    assert np.mean([got[k] == w for k, w in zip(ids[held].tolist(), want.tolist())]) > 0.95


def test_whitening(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)) @ np.diag([5.0, 2.0, 1.0, 0.01]) + 3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(5)
    w = projection.fit_whitening(df, "v")
    white = np.array([r["w"] for r in projection.transformed(df, "v", w, "w").orderBy("id").collect()])
    assert np.allclose(white.mean(axis=0), 0, atol=1e-9) and np.allclose(np.cov(white.T, bias=True), np.eye(4), atol=1e-6)
    assert len(projection.fit_whitening(df, "v", retain=0.9).variances) == 2
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(w.variances, values[::-1]) and np.allclose(np.abs(w.components), np.abs(axes[:, ::-1]), atol=1e-6)
    with pytest.raises(ValueError):
        projection.fit_whitening(df.limit(0), "v")


def test_dictionary(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 6)))], "id long, v array<double>")
    d = projection.fit_dictionary(df, "id", "v", 5)
    x = rng.normal(size=(3, 6))
    plain = d(x)
    assert np.allclose(plain, (x - d.whitening.mean) @ d.whitening.components / np.sqrt(d.whitening.variances) @ d.centres.T)
    assert np.array_equal(d(x, rectify=True), np.maximum(plain, 0))
    hot = d(x, n_hot=2)
    assert (hot.sum(axis=1) == 2).all() and all(set(np.flatnonzero(h)) == set(np.argsort(p)[-2:]) for h, p in zip(hot, plain))
    d.save(spark, str(tmp_path / "d"))
    assert np.allclose(projection.Dictionary.load(spark, str(tmp_path / "d"))(x), plain)
    bare = projection.fit_dictionary(df, "id", "v", 2, whiten=False)
    bare.save(spark, str(tmp_path / "b"))
    assert projection.Dictionary.load(spark, str(tmp_path / "b")).whitening is None


def test_whitened_projection_query(spark, sf_dir, vectors):
    got = result(spark, sf_dir, "whitened_projection", "projected")
    assert len(got) == len(vectors[0]) and all(len(v) == 8 and min(v) >= 0 for v in got.values())
    d = projection.fit_dictionary(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 8, retain=0.95)
    want = d(vectors[2], rectify=True)
    assert np.allclose([got[k] for k in vectors[0].tolist()], want, atol=1e-4)


def test_thumbnails(spark, sf_dir):
    """A clip of a second around the loudest moment; near the ends it is moved, and the last second doesn't count."""
    rate = 2000.0
    t = np.arange(16000) / rate
    for at in (2.0, 4.5):
        x = np.sin(1.5 * np.arange(16000)) * np.exp(-50 * (t - at) ** 2)
        assert abs(signal.thumbnail_start(x, rate) - (at - 0.5 - 0.128)) < 0.15
    assert signal.thumbnail_start(np.sin(1.5 * np.arange(16000)) * np.exp(-50 * t**2), rate) == 0.0
    late = np.sin(1.5 * np.arange(16000)) * (np.exp(-50 * (t - 7.9) ** 2) + 0.2 * np.exp(-50 * (t - 3) ** 2))
    assert abs(signal.thumbnail_start(late, rate) - 2.4) < 0.15
    beyond = np.concatenate([np.sin(1.5 * np.arange(20000)) * 0.1, np.sin(1.5 * np.arange(10000))])
    assert signal.thumbnail_start(beyond, rate) < 9.5
    assert signal.thumbnail_start(np.zeros(10), rate) == 0.0
    starts = {r["id"]: r["start"] for r in catalog.QUERIES["thumbnail_starts"](spark, sf_dir).collect()}
    prices = series(spark, sf_dir)
    assert starts.keys() == prices.keys() and len(set(starts.values())) > 3
    for k, x in prices.items():
        loud = []
        for at in range(0, min(len(x), 1000) - 63, 32):
            f = (x[at : at + 64] - x[at : at + 64].mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64))
            loud.append(sum(abs((f * np.exp(-2j * np.pi * h * np.arange(64) / 64)).sum()) for h in range(33)) / 32)
        per_second = 100 / 32
        loud = signal.smoothed(np.array(loud), 0.25 * per_second)[: len(loud) - int(per_second)]
        assert abs(starts[k] - min(max(int(np.argmax(loud)) / per_second - 0.5, 0), len(x) / 100)) < 1e-9


def test_smoothing_against_sums():
    x = np.random.default_rng(0).normal(size=30)
    sigma, reach = 1.5, 6
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    mirrored = lambda k: x[-k - 1] if k < 0 else x[2 * len(x) - 1 - k] if k >= len(x) else x[k]
    want = [sum(w * mirrored(k + d) for w, d in zip(weights, range(-reach, reach + 1))) / weights.sum() for k in range(30)]
    assert np.allclose(signal.smoothed(x, sigma), want)


@pytest.mark.parametrize("by", [["g"], []])
def test_exact_quantiles(spark, by):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.exponential(size=997)] + [("b", 7.0)] * 50 + [("c", float(k % 3)) for k in range(100)] + [("d", 1.5), ("e", None)] + [("f", 1e12), ("f", 0.0), ("f", 1.0), ("f", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99}
    got = sorted(tuple(r) for r in evals.exact_quantiles(df, by, "v", shares).select(*by, *shares).collect())
    want = df.where("v is not null").groupBy(*by).agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()])
    assert got == sorted(tuple(r) for r in want.collect())


def test_batch_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5))
    x[7] = x[8] = x[9]
    x[10] = 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), np.nan)
    far = np.round(1 - unit @ unit.T, 6)
    for block in (1000, 7):
        got = {(r["q_id"], r["rank"]): r["id"] for r in search.batch_nearest(df, df.where("id % 3 = 0"), "v", "id", 4, block=block).collect()}
        want = {}
        for q in range(0, 60, 3):
            near = sorted((far[q, j], j) for j in range(60) if j != q and not np.isnan(far[q, j]))[:4]
            want |= {(q, n + 1): j for n, (_, j) in enumerate(near)}
        assert got == want


def test_models_on_disk_and_their_statistics(spark, tmp_path):
    df = models.with_features(spark.createDataFrame([(float(k % 3), [float(k % 3), 1.0 + k % 2]) for k in range(60)], "label double, v array<double>"), "v")
    for name, kind in (("rf,numTrees=3", "tree"), ("logreg", "linear"), ("std-ovr-logreg", "linear"), ("svm", "linear"), ("nb", "NaiveBayesModel")):
        fitted = models.classifier(name).fit(df)
        models.save(fitted, str(tmp_path / name.split(",")[0]))
        again = models.load(str(tmp_path / name.split(",")[0]))
        assert [r.prediction for r in again.transform(df).collect()] == [r.prediction for r in fitted.transform(df).collect()]
        stats = models.statistics(fitted)
        assert {s["kind"] for s in stats} == {kind} and len(stats) == (1 if name == "nb" else 3)


def test_online_clusters_go_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(7)
    batches = [rng.normal(size=(20, 2)) for _ in range(4)]
    frame = lambda b: spark.createDataFrame([(v.tolist(),) for v in b], "v array<double>")
    whole = aggregates.OnlineSphericalKMeans(np.eye(2))
    for b in batches:
        whole.update(b)
    path = str(tmp_path / "centres")
    first = aggregates.OnlineSphericalKMeans(np.eye(2), path)
    for k in (0, 1):
        first(frame(batches[k]), k)
    second = aggregates.OnlineSphericalKMeans(np.eye(2), path)  # as after a crash; batch 1 comes once more
    for k in (1, 2, 3):
        second(frame(batches[k]), k)
    assert np.allclose(second.centres, whole.centres) and np.array_equal(second.hits, whole.hits)


def test_online_update_by_hand():
    model = aggregates.OnlineSphericalKMeans(np.eye(2))
    model.update(np.array([[3.0, 4.0], [4.0, 3.0], [1.0, 0.0]]))
    one, two = np.array([1.0, 0]) + [4, 3] + [1.0, 0], np.array([0, 1.0]) + [3, 4]
    assert np.allclose(model.centres, [one / np.linalg.norm(one), two / np.linalg.norm(two)]) and model.hits.tolist() == [3, 2]
