"""Language identification by language-bitmask n-gram filters.

Fitting counts byte 3- and 4-grams of letters by language on a bounded sample
(``PER_LANGUAGE`` documents each) and says a language contains a gram if it has
it often enough against the language that has it most. Of a language with at
least ``_FEW`` documents in the sample, grams count that it has three times. The filter is a Bloom
filter whose slots hold a word of one bit for each language instead of a single
bit (so bits of one language form a slice): a gram sets its languages' bits in
each of its slots, and the AND of these slots is the set of languages that
contain it. A text's hits are counted for each language, less the expected
false positives of that language's slice, and the largest count decides.

The score is the winner's share of all corrected hits. Texts with letters but
no hits get the most frequent language with score 0.

Defined cases: a null text, or one without a letter, is "und" with score 0; with
no labelled rows everything is "und"; ties go to the language that sorts first;
repeated rows and null ids are predicted each; very long texts are read whole, one
text at a time; ids may be of any type that hashes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.llm._common import held_out, table
from fernmark.llm.sampling import bounded_sample

#: Most documents of a language that are fitted on.
PER_LANGUAGE = 3000
ORDERS = (3, 4)
_SLOTS = 3
_SHARE = 0.5
#: Times a gram has to be seen in a language: once where there are few documents of it.
_LEAST, _FEW = 3, 100
_GAP = b"    "
_CHUNK = 1 << 20
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


@dataclass
class LanguageFilter:
    languages: list[str]
    words: np.ndarray  # (slots, words of 64 languages)
    false_rate: np.ndarray  # by language
    default: int


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, their order's offset included; place of each text's first byte; folded bytes)."""
    parts = [_GAP + (t or "").encode() for t in texts]
    begin = np.cumsum([0, *map(len, parts[:-1])]) if parts else np.zeros(0, np.int64)
    folded = _FOLD[np.frombuffer(b"".join(parts) + _GAP, np.uint8)]
    b = folded.astype(np.uint64)
    three = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16)
    return np.stack([three, three | b[3:] << np.uint64(24)]), begin, folded


def _chunks(texts: list, size: int = _CHUNK) -> Iterator[list]:
    held, room = [], 0
    for t in texts:
        held.append(t)
        room += len(t or "") + 4
        if room >= size:
            yield held
            held, room = [], 0
    if held:
        yield held


def _slots(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = (grams + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    for mult in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)[:_SLOTS]:
        yield ((h * np.uint64(mult)) >> np.uint64(64 - bits)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for lang in sorted(set(langs.tolist())):
            for some in _chunks([texts[k] for k in np.flatnonzero(langs == lang)]):
                grams, _, _ = _grams(some)
                for order, g in zip(ORDERS, grams):
                    keys, n = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([order] * len(keys), pa.int32()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "order", "gram", "n"])


def fit(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageFilter:
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = bounded_sample(rows, lang_col, [id_col, text_col], per_language).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = sample.mapInArrow(_count, "lang string, order int, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    few = [r["lang"] for r in sample.groupBy("lang").count().collect() if r["count"] < _FEW]
    counted = counted.where((F.col("n") >= _LEAST) | F.col("lang").isin(few)).toPandas()  # bounded by the sample
    languages = sorted(counted["lang"].unique())
    if not languages:
        return LanguageFilter([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    of = {x: k for k, x in enumerate(languages)}
    counted["l"] = counted["lang"].map(of)
    counted["p"] = counted["n"] / counted.groupby(["l", "order"])["n"].transform("sum")
    keep = counted[counted["p"] >= _SHARE * counted.groupby(["order", "gram"])["p"].transform("max")]
    n_words = -(-len(languages) // 64)
    bits = max(10, (len(keep) * 8).bit_length())
    words = np.zeros((1 << bits, n_words), np.uint64)
    grams, l = keep["gram"].to_numpy().astype(np.uint64), keep["l"].to_numpy()
    for at in _slots(grams, bits):
        np.bitwise_or.at(words, (at, l // 64), np.uint64(1) << (l % 64).astype(np.uint64))
    fill = np.array([((words[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    default = int(counted.groupby("l")["n"].sum().idxmax())
    return LanguageFilter(languages, words, fill**_SLOTS, default)


def decide(model: LanguageFilter, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    out: list[str] = []
    scores: list[np.ndarray] = []
    bits = len(model.words).bit_length() - 1
    for some in _chunks(texts):
        grams, begin, folded = _grams(some)
        hits = np.zeros((len(some), len(model.languages)))
        blank = grams[0] == 0x202020
        total = np.add.reduceat(~blank, begin, dtype=np.int64) * len(ORDERS)
        for g in grams:
            slots = list(_slots(g, bits))
            for w in range(model.words.shape[1]):
                mask = model.words[slots[0], w]
                for at in slots[1:]:
                    mask = mask & model.words[at, w]
                mask[blank] = 0
                for l in range(w * 64, min(len(model.languages), w * 64 + 64)):
                    hits[:, l] += np.add.reduceat(((mask >> np.uint64(l % 64)) & np.uint64(1)).astype(np.uint8), begin, dtype=np.int64)
        ascii_letters = np.add.reduceat((folded[:-3] >= ord("a")) & (folded[:-3] < 0x80), begin, dtype=np.int64)
        if model.languages:
            hits = np.clip((hits - total[:, None] * model.false_rate) / (1 - model.false_rate), 0, None)
            best, sums = hits.argmax(axis=1), hits.sum(axis=1)
            share = np.where(sums > 0, hits.max(axis=1) / np.where(sums > 0, sums, 1), 0.0)
            best[sums == 0] = model.default
        for k, text in enumerate(some):
            if not model.languages or not (ascii_letters[k] or any(map(str.isalpha, text or ""))):
                out.append("und")
                scores.append(0.0)
            else:
                out.append(model.languages[best[k]])
                scores.append(float(share[k]))
    return out, np.array(scores)


def predict(docs: DataFrame, model: LanguageFilter, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = decide(sent.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id")))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
