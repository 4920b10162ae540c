import random

import pytest

from fernmark.llm import crf, langid, sampling, toxicity
from fernmark.llm._common import held_out
from tests.llm.fixtures import documents, empty, rows_of


def test_language_of_held_out_rows(spark, sf_dir):
    got = rows_of(langid.op3_langid(spark, sf_dir))
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert held and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_awkward_rows(spark):
    train = spark.createDataFrame([(k, t, g) for k in range(10) for t, g in (("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("?", None))], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["de", "en"]
    langs, scores = langid.decide(model, [None, "", "12 !?", "The Dog", "Die Katze", "日本"])
    assert langs[:5] == ["und", "und", "und", "en", "de"] and langs[5] in model.languages and scores[5] == 0
    docs = documents(spark)
    assert langid.predict(docs, model).count() == docs.count()
    nothing = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in rows_of(langid.predict(docs, nothing))} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_filter_holds_the_languages_of_each_gram(spark):
    """The AND of a gram's slots is exactly the set of languages of a brute-force table, but for false positives."""
    import numpy as np

    texts = {"en": "the cat and the dog went over there and then the hat", "de": "der hund und die katze und das haus und der hut", "fr": "le chat et le chien et la maison et le chapeau"}
    model = langid.fit(spark.createDataFrame([(k, t, g) for k in range(5) for g, t in texts.items()], "doc_id long, text string, lang string"))
    counts = {}
    for lang, t in texts.items():
        for grams, order in zip(langid._grams([t] * 5)[0], langid.ORDERS):
            for g, n in zip(*np.unique(grams, return_counts=True)):
                counts.setdefault((order, int(g)), {})[lang] = int(n)
    totals = {(order, lang): sum(c.get(lang, 0) for (o, _), c in counts.items() if o == order) for order in langid.ORDERS for lang in texts}
    extra = 0
    for (order, gram), c in counts.items():
        share = {lang: n / totals[order, lang] for lang, n in c.items()}
        want = {lang for lang, p in share.items() if p >= langid._SHARE * max(share.values())}
        word = np.uint64(2**64 - 1)
        for at in langid._slots(np.array([gram], np.uint64), len(model.words).bit_length() - 1):
            word &= model.words[at[0], 0]
        got = {lang for k, lang in enumerate(model.languages) if int(word) >> k & 1}
        assert want <= got
        extra += len(got - want)
    assert extra <= 0.05 * len(counts)


def test_few_texts_are_enough(spark):
    """One text of each language: its grams count though they are seen once."""
    texts = {"en": "the cat sat over there", "de": "der hund schlief dort drüben", "fr": "le chien dormait ici"}
    model = langid.fit(spark.createDataFrame([(k, t, g) for k, (g, t) in enumerate(texts.items())], "doc_id long, text string, lang string"))
    langs, scores = langid.decide(model, list(texts.values()))
    assert langs == list(texts) and (scores > 0.5).all()


def brute_predict(model, text):
    """Hits of each language counted gram by gram."""
    import numpy as np

    if not any(map(str.isalpha, text or "")):
        return "und"
    hits, total = np.zeros(len(model.languages)), 0
    grams, _, _ = langid._grams([text])
    for g in grams:
        for three, gram in zip(grams[0].tolist(), g.tolist()):
            if three == 0x202020:
                continue
            total += 1
            word = np.uint64(2**64 - 1)
            for at in langid._slots(np.array([gram], np.uint64), len(model.words).bit_length() - 1):
                word &= model.words[at[0], 0]
            hits += [int(word) >> k & 1 for k in range(len(hits))]
    hits = np.clip((hits - total * model.false_rate) / (1 - model.false_rate), 0, None)
    return model.languages[int(hits.argmax())] if hits.sum() else model.languages[model.default]


def test_predictions_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.where(~held_out("doc_id")))
    rows = [r for r in rows_of(docs) if len(r["text"]) < 3000][:25]
    got = {r["doc_id"]: r["lang_pred"] for r in rows_of(langid.op3_langid(spark, sf_dir))}
    assert [got[r["doc_id"]] for r in rows] == [brute_predict(model, r["text"]) for r in rows]


def test_samples_are_bounded_and_never_empty(spark):
    """Shares of very large classes are not 0, and rows that share their key can't overflow a class."""
    n = 5_000_000_000_000
    below = sampling.thresholds({"en": n, "fr": 10, "xx": 0}, 3000)
    assert below["fr"] == 1 << 62 and abs(below["en"] / (1 << 62) * n - 3000) < 1e-3 and "xx" not in below
    rows = spark.createDataFrame([(None, "en", f"t{k % 2}") for k in range(4000)] + [(k, "fr", "t") for k in range(3000)] + [(1, None, "t"), (2, "de", None)], "doc_id long, lang string, text string")
    got = rows_of(sampling.bounded_sample(rows, "lang", ["doc_id", "text"], 100).groupBy("lang").count())
    counts = {r["lang"]: r["count"] for r in got}
    assert counts["en"] == 100 and 60 < counts["fr"] <= 100 and counts["de"] == 1 and None not in counts
    own = rows_of(sampling.bounded_sample(rows, "lang", ["doc_id", "text"], {"en": 50, "fr": 20, "de": 5}).groupBy("lang").count())
    assert all(r["count"] <= {"en": 50, "fr": 20, "de": 5}[r["lang"]] for r in own)
    again = [sorted(r["doc_id"] for r in rows_of(sampling.bounded_sample(rows.repartition(k), "lang", ["doc_id", "text"], 100).where("lang = 'fr'"))) for k in (2, 7)]
    assert again[0] == again[1]


def test_toxicity_of_held_out_rows(spark):
    """Accuracy on labelled rows of either kind that the model has not seen, and spans that are words of the text."""
    sf_dir = "/root/testdata/sf0.1"  # smaller tables have too few toxic labels to tell
    got = {r["doc_id"]: r for r in rows_of(toxicity.op4_toxicity(spark, sf_dir))}
    labels = {r["doc_id"]: r["toxic"] for r in rows_of(spark.read.parquet(f"{sf_dir}/labels.parquet")) if r["toxic"] is not None}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    held = [k for k in labels if got[k]["held_out"]]
    assert len(got) == len(texts)
    for kind in (0, 1):
        mine = [k for k in held if labels[k] == kind]
        assert mine and sum(got[k]["predicted"] == kind for k in mine) / len(mine) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    spans = [texts[k][s["start"] : s["end"]] for k, r in got.items() for s in r["spans"]]
    assert spans and all(s and s.strip() == s for s in spans)


def test_documents_that_share_an_id_with_a_label(spark):
    """However many documents have a labelled id, no more than the bound are fitted on."""
    docs = spark.createDataFrame([(1, f"vile {k}") for k in range(300)] + [(2, f"fine {k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit_on_labels(docs, labels, per_label=10).crf is not None
    assert sampling.capped(docs, "doc_id", ["text"], {1: 10, 2: 20}).groupBy("doc_id").count().collect() and sampling.capped(docs, "doc_id", ["text"], {1: 10, 2: 20}).count() == 30


def brute_score(model, text):
    """Score and spans of one text by loops over words and lines; features are those of the words alone."""
    import math

    w = crf.words_of([text])
    e = [sum(float(model.crf.weights[int(f) >> (64 - crf.BITS)]) for f in row) + model.crf.bias for row in w.features.tolist()]
    m, odds = model.crf.moves, []
    for line in sorted(set(w.chain.tolist())):
        own = [e[k] for k in range(len(e)) if w.chain[k] == line]
        n = len(own)
        forward, backward = [[0.0, own[0]]], [[0.0, 0.0]]
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        for k in range(1, n):
            forward.append([add(forward[-1][0] + m[0][v], forward[-1][1] + m[1][v]) + own[k] * v for v in (0, 1)])
        for k in range(n - 2, -1, -1):
            after = backward[0]
            backward.insert(0, [add(m[u][0] + after[0], m[u][1] + own[k + 1] + after[1]) for u in (0, 1)])
        odds += [f[1] + b[1] - f[0] - b[0] for f, b in zip(forward, backward)]
    top = max([-12.0, *(min(12.0, max(-12.0, x)) for x in odds)])
    expected = sum(1 / (1 + math.exp(-x)) for x in odds if x > 0)
    z = float(model.final @ [1.0, top / 4, math.log1p(expected)])
    spans = []
    for k, x in enumerate(odds):
        if x >= 0:
            if spans and spans[-1][2] == k - 1 and w.chain[k] == w.chain[k - 1]:
                spans[-1] = (spans[-1][0], int(w.end[k]), k)
            else:
                spans.append((int(w.start[k]), int(w.end[k]), k))
    return 1 / (1 + math.exp(-z)), [s[:2] for s in spans]


def test_scores_against_brute_force(spark):
    """The query's scores, predictions and spans, recomputed for some texts of each kind one by one."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = sorted(rows_of(toxicity.op4_toxicity(spark, sf_dir)), key=lambda r: -r["score"])
    texts = {r["doc_id"]: r["text"] for r in rows_of(docs)}
    for r in got[:25] + got[25::40]:
        score, spans = brute_score(model, texts[r["doc_id"]])
        assert abs(score - r["score"]) < 1e-6 and [(s["start"], s["end"]) for s in r["spans"]] == spans
        assert r["predicted"] == (r["score"] >= 0.5)


def test_words_are_read_whole(spark):
    """Words that differ after their first 24 bytes, and one character in the middle of a clause without blanks."""
    long = "abcdefghijklmnopqrstuvwxyz" * 2
    a, b = (crf.words_of([long[:30] + x + long[30:]]).features[0] for x in "xy")
    assert a[0] != b[0]
    clause = "今天的天气非常好我们一起去公园散步然后回家吃饭"
    vile = clause[:11] + "恶毒" + clause[11:]
    w = crf.words_of([vile])
    assert [vile.encode()[s:e].decode() for s, e in zip(w.start, w.end)] == list(vile)
    rows = [(k, clause[k % 7 :] + str(k) if k % 3 else clause[k % 5 :] [:8] + "恶毒" + clause[8 + k % 4 :] + str(k), int(k % 3 == 0)) for k in range(300)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    (bad, good), (spans, none) = toxicity.score_texts(model, ["你" + vile + "吗", clause + "吗"])
    assert bad > 0.5 > good and not none
    assert any("恶" in ("你" + vile + "吗").encode()[s["start"] : s["end"]].decode() for s in spans)
    mixed = "naïve’s word ไทย x"
    m = crf.words_of([mixed])
    assert [mixed.encode()[s:e].decode() for s, e in zip(m.start, m.end)] == ["naïve’s", "word", "ไ", "ท", "ย", "x"]


def labelled(n, seed):
    rng = random.Random(seed)
    common = "the a of and to in is was by with".split()
    rows = []
    for k in range(n):
        w = [rng.choice(common) + rng.choice(["", "th", "er", "ing"]) for _ in range(40)]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(40)] = rng.choice(["rotten", "vilest", "Grotty", "grottier"])
        rows.append((k + seed * 10_000, " ".join(w), int(toxic)))
    return rows


def test_toxicity_of_unseen_rows(spark):
    model = toxicity.fit(spark.createDataFrame(labelled(400, 1), "doc_id long, text string, toxic int"))
    unseen = labelled(200, 2)
    scores, spans = toxicity.score_texts(model, [t for _, t, _ in unseen])
    assert sum((s >= 0.5) == (y == 1) for s, (_, _, y) in zip(scores, unseen)) / 200 > 0.97
    found = {unseen[k][1].encode()[s["start"] : s["end"]].decode().lower().split()[0] for k in range(200) for s in spans[k]}
    assert {"rotten", "vilest"} <= found
    assert (toxicity.score_texts(model, [None, "", "..."])[0] < 0.5).all()
    docs = documents(spark)
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(empty(spark), model).count() == 0


def test_toxicity_without_labels(spark):
    model = toxicity.fit(spark.createDataFrame([(1, "x", 0), (2, "y", None)], "doc_id long, text string, toxic int"))
    assert toxicity.score_texts(model, ["x", None])[0].tolist() == [0, 0]


def test_marginals_against_enumeration():
    """Forward-backward equals the sum over all labellings."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    model = crf.Crf(moves=rng.normal(size=(2, 2)))
    e, chain = rng.normal(size=6), np.array([1, 1, 1, 1, 2, 2])
    got = crf.sigmoid(model.marginals(e, chain)[0])
    for c in (1, 2):
        at = np.flatnonzero(chain == c)
        total, ones = 0.0, np.zeros(len(at))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(e[i] * v for i, v in zip(at, y)) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
        assert np.allclose(got[at], ones / total)


def test_held_out_rule(spark):
    import zlib

    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long")
    assert all(r["h"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in rows_of(df.withColumn("h", held_out("doc_id"))))


@pytest.mark.parametrize("text", ["a" * 100_000, "word " * 30_000, "\n" * 1000])
def test_long_texts(text):
    model = langid.LanguageFilter(["en"], __import__("numpy").zeros((1024, 1), "uint64"), __import__("numpy").zeros(1), 0)
    assert len(langid.decide(model, [text, "x"])[0]) == 2
    w = crf.words_of([text, "x y"])
    assert w.text[-1] == 1
