"""Toxicity by a linear-chain conditional random field.

The labels mark whole documents, a CRF learns from words, so the words are
labelled first, on a bounded sample: in a toxic document the words that stand
out (by the likelihood-ratio statistic of a feature's presence in toxic against
clean documents) are labelled 1, everything else 0. The CRF (``crf``) is then
fitted, and forward-backward gives each word of any text its marginal. A
document's score is a logistic function of its largest marginal log odds and of
the expected number of toxic words among the likely ones, fitted on a quarter of the sample that the
CRF hasn't seen. Runs of words with marginals of at least one half are the
offending spans, as byte offsets [start, end) of the UTF-8 text.

Defined cases: null and empty texts have no words and get the score of no
evidence, under one half; without labels of both kinds every score is 0;
repeated rows and null ids are scored each; very long texts are read whole, one
text at a time; ids may be of any type that hashes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.llm import crf
from fernmark.llm._common import held_out, table
from fernmark.llm.sampling import bounded_sample, capped

#: Most toxic documents that are fitted on; of clean ones, twice as many.
PER_LABEL = 1200
#: Most bytes of text of a label that are fitted on.
MOST_BYTES = 32 << 20
#: Least likelihood-ratio statistic, and least ratio of shares of documents, of a feature that stands out.
_STANDS_OUT, _LIFT = 12.0, 8.0


@dataclass
class ToxicityModel:
    crf: crf.Crf | None
    final: np.ndarray  # of 1, largest log odds, log(1 + expected toxic words)


def _presence(words: list[crf.Words], which: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features and in how many of the chosen texts each is."""
    found = []
    for w, chosen in zip(words, which):
        inside = chosen[w.text]
        pairs = _once_a_text(w.features[inside], w.text[inside])
        found.append(pairs)
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))


def _once_a_text(features: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each feature once for each text."""
    flat, owner = features.ravel(), np.repeat(text, features.shape[1])
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[first]


def _standing_out(words: list[crf.Words], toxic: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features that toxic documents have more often, sorted, with their signed likelihood-ratio statistic."""
    keys, in_toxic = _presence(words, [t == 1 for t in toxic])
    others, in_clean = _presence(words, [t == 0 for t in toxic])
    at = np.searchsorted(others, keys)
    at_safe = np.minimum(at, max(0, len(others) - 1))
    c = np.where(len(others) and others[at_safe] == keys, in_clean[at_safe], 0) if len(others) else np.zeros(len(keys))
    n1, n0 = sum(int((t == 1).sum()) for t in toxic), sum(int((t == 0).sum()) for t in toxic)
    k = in_toxic.astype(float)
    p, p1, p0 = (k + c) / (n1 + n0), k / n1, c / max(n0, 1)

    def log_likelihood(hit: np.ndarray, total: float, share: np.ndarray) -> np.ndarray:
        share = np.clip(share, 1e-9, 1 - 1e-9)
        return hit * np.log(share) + (total - hit) * np.log(1 - share)

    ratio = 2 * (log_likelihood(k, n1, p1) + log_likelihood(c, n0, p0) - log_likelihood(k, n1, p) - log_likelihood(c, n0, p))
    return keys, np.where((k + 0.5) / n1 >= _LIFT * (c + 0.5) / max(n0, 1), ratio, 0.0)


def label_words(words: list[crf.Words], toxic: list[np.ndarray]) -> list[np.ndarray]:
    """0 or 1 for each word: in a toxic text those whose best feature stands out at least half as much as the text's best."""
    keys, ratio = _standing_out(words, toxic)
    out = []
    for w, t in zip(words, toxic):
        y = np.zeros(len(w.start))
        if len(keys) and len(y):
            at = np.minimum(np.searchsorted(keys, w.features), len(keys) - 1)
            best = np.where(keys[at] == w.features, ratio[at], 0.0).max(axis=1)
            top = np.zeros(len(t))
            np.maximum.at(top, w.text, best)
            y[(t[w.text] == 1) & (best >= _STANDS_OUT) & (best >= top[w.text] / 2)] = 1
        out.append(y)
    return out


def _document_features(log_odds: np.ndarray, w: crf.Words, n: int) -> np.ndarray:
    top, expected = np.full(n, -12.0), np.zeros(n)
    np.maximum.at(top, w.text, np.clip(log_odds, -12, 12))
    np.add.at(expected, w.text, np.where(log_odds > 0, crf.sigmoid(log_odds), 0))
    return np.stack([np.ones(n), top / 4, np.log1p(expected)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, clean: float, penalty: float = 1e-2) -> np.ndarray:
    """Newton's method; a clean row stands for ``clean`` rows, as fewer of these are sampled."""
    weight = np.where(y == 1, 1.0, clean)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = crf.sigmoid(x @ beta)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        beta += np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * beta)
    return beta


def fit(labelled: DataFrame, *, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", per_label: int = PER_LABEL) -> ToxicityModel:
    """Fit on a bounded sample, drawn by hash from all labelled rows; the sample comes to the driver."""
    known = labelled.where(F.col(label_col).isin(0, 1))
    sample = bounded_sample(known, label_col, [id_col, text_col], {1: per_label, 0: 2 * per_label})
    rows = sample.select(F.col(id_col).alias("i"), F.col(label_col).alias("y"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return _fit(rows.toPandas(), _totals(known, label_col))


def _totals(known: DataFrame, label_col: str) -> dict[int, int]:
    return {r[0]: r[1] for r in known.groupBy(label_col).count().collect()}


def _fit(rows: pd.DataFrame, totals: dict[int, int]) -> ToxicityModel:
    """``rows``: i, y, t; ``totals``: labelled rows, of which these are a sample, by label."""
    rows = rows.sort_values(["i", "t"])
    texts, y = rows["t"].tolist(), rows["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return ToxicityModel(None, np.zeros(3))
    rng = np.random.default_rng(0)
    order = rng.permutation(len(texts))
    parts, at = [], 0
    # At least four parts, so that some are left that the CRF hasn't seen; of one text there is one part.
    for some in crf.chunks([texts[k] for k in order], max(1, min(1 << 16, sum(map(len, texts)) // 6))):
        parts.append((crf.words_of(some), y[order[at : at + len(some)]]))
        at += len(some)
    clean = (totals[0] / (y == 0).sum()) / (totals[1] / (y == 1).sum())
    kept = max(1, len(parts) * 3 // 4)
    seen, rest = parts[:kept], parts[kept:] or parts
    words, toxic = [w for w, _ in seen], [t for _, t in seen]
    model = crf.train(words, label_words(words, toxic))
    x = [_document_features(model.marginals(model.emissions(model.slots(w)), w.chain)[0], w, len(t)) for w, t in rest]
    x, t = np.concatenate(x), np.concatenate([t for _, t in rest])
    final = _logistic(x, t, clean)
    for k in (1, 2):  # more evidence never lowers a score
        if final[k] < 0:
            final = np.insert(_logistic(np.delete(x, k, axis=1), t, clean), k, 0.0)
    return ToxicityModel(model, final)


def score_texts(model: ToxicityModel, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores, and spans {start, end, p} of the texts."""
    if model.crf is None:
        return np.zeros(len(texts)), [[] for _ in texts]
    scores, spans = [], []
    for some in crf.chunks(texts):
        w = crf.words_of(some)
        log_odds = model.crf.marginals(model.crf.emissions(model.crf.slots(w)), w.chain)[0]
        scores.append(crf.sigmoid(_document_features(log_odds, w, len(some)) @ model.final))
        own: list[list[dict]] = [[] for _ in some]
        last = -2
        for k in np.flatnonzero(log_odds >= 0).tolist():
            t = int(w.text[k])
            begin, p = int(w.begin[t]), float(crf.sigmoid(log_odds[k : k + 1])[0])
            if k == last + 1 and own[t] and w.chain[k] == w.chain[last]:
                own[t][-1] = {"start": own[t][-1]["start"], "end": int(w.end[k]) - begin, "p": max(p, own[t][-1]["p"])}
            else:
                own[t].append({"start": int(w.start[k]) - begin, "end": int(w.end[k]) - begin, "p": p})
            last = k
        spans += own
    return np.concatenate(scores) if scores else np.zeros(0), spans


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = score_texts(sent.value, batch.column(1).to_pylist())
            cols = [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "score", "predicted", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, score double, predicted int, spans array<struct<start:long,end:long,p:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def is_toxic(spark: SparkSession, model: ToxicityModel):
    """A function of a text column: whether its score is at least one half."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(score_texts(sent.value, text.tolist())[0] >= 0.5)

    return toxic


def _within(sample: DataFrame, label: str, keys: list[str], most_bytes: int) -> DataFrame:
    """The rows of a bounded sample, in the order of its draw, up to so many bytes of text a label, or the first row."""
    drawn = Window.partitionBy(label).orderBy(F.xxhash64(*keys, F.lit("bytes")), *keys)
    sized = sample.withColumn("_upto", F.sum(F.octet_length("t")).over(drawn)).withColumn("_at", F.row_number().over(drawn))
    return sized.where((F.col("_upto") <= most_bytes) | (F.col("_at") == 1)).drop("_upto", "_at")


def fit_on_labels(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_bytes: int = MOST_BYTES) -> ToxicityModel:
    """On the rows of ``labels`` outside the held-out fifth. They are sampled before the join, so the sample, bounded
    by ``per_label``, is broadcast and no text is shuffled."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).select(F.col("doc_id").alias("i"), F.col("toxic").alias("y"))
    most = {1: per_label, 0: 2 * per_label}
    sample = bounded_sample(known, "y", ["i"], most)
    texts = docs.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("t"))
    found = texts.join(F.broadcast(sample), F.col("d") == F.col("i")).select("i", "y", "t")
    return _fit(_within(capped(found, "y", ["i", "t"], most), "y", ["i", "t"], most_bytes).toPandas(), _totals(known, "y"))  # documents may share an id


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "spans")
