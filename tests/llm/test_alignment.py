"""Token alignment against a plain version that encodes whole texts with both libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from fernmark.llm import alignment, postings
from tests.llm.fixtures import documents, empty, rows_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def _bytes(tokenizers):
    """Bytes of A's and of B's tokens, by other means than the operator's."""
    a, b = tokenizers
    shown = {}
    plain = [c for c in range(256) if chr(c).isprintable() and c not in (0x20, 0xA0, 0xAD)]
    shown.update({chr(c): c for c in plain})
    shown.update({chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)})
    of_a = lambda i: bytes(shown[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes.fromhex(b.id_to_piece(i)[3:5]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return of_a, of_b


def brute(tokenizers, text):
    """Groups as pairs of lists of ids; None without tokens."""
    if not text:
        return None
    of_a, of_b = _bytes(tokenizers)
    ids_a, ids_b = tokenizers[0].encode(" " + text, add_special_tokens=False).ids, tokenizers[1].encode(text)
    raw = (" " + text).encode()
    if b"".join(map(of_a, ids_a)) != raw or b"".join(map(of_b, ids_b)) != raw:
        return None
    out, i, j, x, y = [], 0, 0, 0, 0
    while i < len(ids_a) or j < len(ids_b):
        left, right = [ids_a[i]], [ids_b[j]]
        x, y, i, j = x + len(of_a(ids_a[i])), y + len(of_b(ids_b[j])), i + 1, j + 1
        while x != y:
            if x < y:
                left.append(ids_a[i])
                x, i = x + len(of_a(ids_a[i])), i + 1
            else:
                right.append(ids_b[j])
                y, j = y + len(of_b(ids_b[j])), j + 1
        out.append((left, right))
    return out


def named(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])


def odd_texts():
    rng = random.Random(7)
    out = [None, "", " ", "  ", "\n", "\n\nx", "x\n", "a \n b", "a\n\n b", "▁", "a▁ b", "x ▁▁ y  z", "<|endoftext|> and <s> </s> <unk> <0x41>", "tab\tand\t two", "\x00\x01", "naïve 12½ ①a　b ", "日本 語!! 😀😀 é", "  x  y", " lead", "end  \n "]
    return out + ["".join(rng.choices(" \n\t'atre1é日▁😀.", weights=[6, 2, 1, 1, 4, 4, 4, 4, 1, 1, 1, 0.1, 1, 2], k=rng.randint(1, 60))) for _ in range(1500)]


def test_groups_against_whole_texts(tokenizers):
    texts = odd_texts()
    assert alignment.Aligner(A, B).align(texts) == [named(brute(tokenizers, t)) for t in texts]


def test_full_caches_are_begun_anew(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "_MAX_PARTS", 20)
    texts = odd_texts()[:200]
    assert alignment.Aligner(A, B).align(texts) == [named(brute(tokenizers, t)) for t in texts]


def test_kinds_of_links(tokenizers):
    text = "Überraschend naïve tokenizers disagree, ouonneux 12345 thoueringedwh"
    groups = brute(tokenizers, text)
    want = {"end": [(a[-1], b[-1]) for a, b in groups], "group": [(i, j) for a, b in groups for i in a for j in b]}
    of_a, of_b = _bytes(tokenizers)
    places = []
    for side, size in ((0, of_a), (1, of_b)):
        ends = np.cumsum([0, *(len(size(i)) for g in groups for i in g[side])])
        places.append([(i, set(range(s, e))) for i, s, e in zip((i for g in groups for i in g[side]), ends, ends[1:])])
    want["overlap"] = [(i, j) for i, x in places[0] for j, y in places[1] if x & y]
    assert len(want["overlap"]) > len(want["end"])
    for how, pairs in want.items():
        keys, owner, fields = alignment.Aligner(A, B, how)([None, text])
        assert Counter((k >> 20, k & (1 << 20) - 1) for k in keys.tolist()) == Counter(pairs)
        assert set(owner.tolist()) == {1} and fields["n_links"].tolist() == [0, len(pairs)]


def brute_query(tokenizers, rows):
    """All columns of op11 by a dictionary of pairs."""
    found = [(i, brute(tokenizers, t)) for i, t in rows]
    counts = Counter((a[-1], b[-1]) for _, g in found for a, b in g or [])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, g in found:
        links = [(a[-1], b[-1]) for a, b in g or []]
        sums = sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)
        out.append((i, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(links), *sums, hashlib.sha256(named(g).encode()).hexdigest() if g else ""))
    return sorted(map(str, out))


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "best", "n_linked", "groups_sha256")


@pytest.mark.parametrize("hot", [10_000, 1])
def test_counts_of_awkward_rows(spark, tokenizers, monkeypatch, hot):
    """Small blocks, so that keys meet in many; all keys salted, or none."""
    monkeypatch.setattr(postings, "HOT_KEYS", 10_000 if hot == 10_000 else 1 << 40)
    monkeypatch.setattr(postings, "BLOCK_BYTES", 2000)
    docs = documents(spark).repartition(3)
    got = rows_of(alignment.align(docs, A, B).select("row.doc_id", *COLUMNS))
    assert sorted(str(tuple(r.values())) for r in got) == brute_query(tokenizers, [(r["doc_id"], r["text"]) for r in rows_of(docs)])
    assert rows_of(alignment.align(empty(spark), A, B)) == []


def test_query_against_brute_force(spark, sf_dir, tokenizers):
    got = rows_of(alignment.op11_alignment(spark, sf_dir))
    assert list(got[0]) == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [(r["doc_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))]
    assert sorted(str(tuple(r.values())) for r in got) == brute_query(tokenizers, rows)


def test_groups_of_documents(spark, tokenizers):
    docs = spark.createDataFrame([(1, "naïve tokenizers"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in rows_of(alignment.groups(docs, A, B))}
    assert got == {1: brute(tokenizers, "naïve tokenizers"), 2: []}
