"""Token alignment between two tokenizers by elementary intervals.

Both tokenizers cover the same bytes, so each is a series of token ends. The
union of both series cuts the bytes into elementary intervals; a search for an
interval's end in either series names the tokens it lies in (its owners), so
each interval is one overlap of an A token with a B token. Where an end is in both
series a group closes: the smallest runs of A and B tokens with the same bytes.
Links are, as asked, pairs of tokens that end together, overlap or share a group.

A text is cut where neither tokenizer has a token or a rule that reaches over
the cut (before a blank or a newline that follows something else), and what is
between cuts is encoded and aligned once while it is kept: both tokenizers end a
token at a cut, so a group never reaches over it. Whether the tokens' bytes are
the text is checked for each such part, and for whole texts where a part fails.

How often an id pair is linked in the corpus, and which A ids are a B id's most
frequent, is found from inverted postings (``postings``): pairs by block of
documents, shuffled by pair to the pair's counts, and summed up by document.

Defined cases: null and empty texts, and texts whose tokens' bytes differ from a
blank and the text, have no tokens: zeros and the empty string; special tokens'
strings are plain text; repeated rows and rows that share or lack an id are
aligned and counted each; a very long text is one document of one block, and a
part of a text without blanks is encoded whole; ties for the highest count are all
best; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.llm._common import materialize, table
from fernmark.llm.postings import key_counts, weigh, write_blocks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: An id pair as a number: A's id, and B's id in so many bits.
_B_BITS = 20
_MAX_PARTS, _MAX_CHARS, _CHARS_AT_ONCE = 600_000, 12_000_000, 1 << 18
_PART = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
_BLANK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each elementary interval: the A token and the B token that it lies in, and whether both end with it."""
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return a, b, (ends_a[a] == cuts) & (ends_b[b] == cuts)


class Aligner:
    """Two tokenizers of one worker and the parts of texts that they have seen."""

    def __init__(self, path_a: str, path_b: str, links: str = "end"):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        if links not in ("end", "overlap", "group"):
            raise ValueError(f"links are by end, overlap or group, not by {links}")
        self._a, self._b, self._links = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b), links
        self._a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self._a.get_vocab()
        self._bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self._bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.vocab_size())]
        self._bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self._size_a, self._size_b = (np.array(list(map(len, x)), np.int64) for x in (self._bytes_a, self._bytes_b))
        self._lens_a, self._lens_b = self._size_a.tolist(), self._size_b.tolist()
        named = lambda n, last: np.array([f"{i},".replace(",", c) for c in ("," + last) for i in range(n)], object)
        self._names_a, self._names_b = named(len(self._bytes_a), "|"), named(len(self._bytes_b), ";")
        self._lone = self._b.piece_to_id(_BLANK)
        # A cut before a blank or a newline needs that no piece has one after something else.
        self._cuts = not any("\n" in p or _BLANK in p.lstrip(_BLANK) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        #: Of each part: its slot; by slot numbers of A tokens, B tokens and groups, links, groups as text, and whether the bytes agree.
        self._slots: dict[str, int] = {}
        self._chars = 0
        self._counts = np.zeros((1 << 10, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self._at, self._pairs, self._used = np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.int64), 0
        self._text: list[str] = []
        self._good = np.zeros(1 << 10, bool)

    def _encode_b(self, parts: list[str]) -> list[list[int]]:
        """B puts a blank before each text: one that is there already is left out, one that is not there is taken out."""
        found = self._b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [([self._lone] if p == " " else ids) if p[0] == " " else ids[1:] for p, ids in zip(parts, found)]

    def _checked(self, parts: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> np.ndarray:
        """Whether tokens' bytes are the part's, by part; the ids of others are taken away."""
        joined = lambda table, ids: b"".join(map(table.__getitem__, ids))
        good = np.ones(len(parts), bool)
        every = "".join(parts).encode()
        sizes = [np.fromiter((sum(map(table.__getitem__, ids)) for ids in x), np.int64, len(parts)) for table, x in ((self._lens_a, ids_a), (self._lens_b, ids_b))]
        if np.array_equal(*sizes) and joined(self._bytes_a, chain.from_iterable(ids_a)) == every and joined(self._bytes_b, chain.from_iterable(ids_b)) == every:
            ends = np.cumsum(sizes[0])
            if np.array_equal(ends, np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))):
                return good
        for k, (p, a, b) in enumerate(zip(parts, ids_a, ids_b)):
            raw = p.encode()
            if joined(self._bytes_a, a) != raw or joined(self._bytes_b, b) != raw:
                good[k], ids_a[k], ids_b[k] = False, [], []
        return good

    def _add(self, parts: list[str]) -> None:
        ids_a = [e.ids for e in self._a.encode_batch_fast(parts, add_special_tokens=False)]
        ids_b = self._encode_b(parts)
        good = self._checked(parts, ids_a, ids_b)
        part_a, part_b = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n[-1])) for x, n in ((ids_a, part_a), (ids_b, part_b)))
        a, b, closed = intervals(np.cumsum(self._size_a[flat_a]), np.cumsum(self._size_b[flat_b]))
        stop_a, stop_b = a[closed] + 1, b[closed] + 1  # of groups
        groups = np.searchsorted(stop_a, part_a, side="right")  # up to the end of each part
        if self._links == "group":
            spans = zip(stop_a.tolist(), stop_b.tolist(), np.diff(stop_a, prepend=0).tolist(), np.diff(stop_b, prepend=0).tolist())
            sides = [(flat_a[x - n : x], flat_b[y - m : y]) for x, y, n, m in spans]
            pairs = np.array([i << _B_BITS | j for some_a, some_b in sides for i, j in product(some_a.tolist(), some_b.tolist())], np.int64)
            upto = np.cumsum([0, *(len(x) * len(y) for x, y in sides)])[groups]
        else:
            chosen = closed if self._links == "end" else np.ones(len(closed), bool)
            pairs = flat_a[a[chosen]] << _B_BITS | flat_b[b[chosen]]
            upto = np.searchsorted(a[chosen], part_a)  # intervals of the part's tokens
        first, last = len(self._text), len(self._text) + len(parts)
        while last > len(self._good):
            for name in ("_counts", "_at", "_good"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while self._used + len(pairs) > len(self._pairs):
            self._pairs = np.concatenate([self._pairs, np.zeros_like(self._pairs)])
        self._pairs[self._used : self._used + len(pairs)] = pairs
        n_links = np.diff(upto, prepend=0)
        self._counts[first:last] = np.stack([np.diff(part_a, prepend=0), np.diff(part_b, prepend=0), np.diff(groups, prepend=0), n_links], axis=1)
        self._at[first:last] = self._used + upto - n_links
        self._good[first:last] = good
        self._used += len(pairs)
        # Names of A's tokens with what follows them, then B's, by group: a number after which comes a comma, a bar or a semicolon.
        ends_a, ends_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        ends_a[stop_a - 1], ends_b[stop_b - 1] = True, True
        of_a, of_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        names = np.concatenate([self._names_a[flat_a + ends_a * len(self._bytes_a)], self._names_b[flat_b + ends_b * len(self._bytes_b)]])[order].tolist()
        stops = (part_a + part_b).tolist()
        self._text += ["".join(names[x:y])[:-1] for x, y in zip([0, *stops], stops)]

    def _learn(self, parts: Iterable[str]) -> None:
        new = [p for p in dict.fromkeys(parts) if p not in self._slots]
        if new:
            self._chars += sum(map(len, new))
            self._slots.update(zip(new, range(len(self._text), len(self._text) + len(new))))
            self._add(new)

    def slots(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The slots of each text's parts, in order, good until the next one is asked for; none without tokens."""
        at = 0
        while at < len(texts):
            if len(self._slots) > _MAX_PARTS or self._chars > _MAX_CHARS:
                self._forget()
            parts, room = [], 0
            while at < len(texts) and room < _CHARS_AT_ONCE:
                text = " " + texts[at] if texts[at] else ""
                parts.append(_PART.findall(text) if self._cuts else [text] if text else [])
                room, at = room + len(text), at + 1
            self._learn(chain.from_iterable(parts))
            for some in parts:
                found = np.fromiter(map(self._slots.__getitem__, some), np.int64, len(some))
                if not self._good[found].all():
                    whole = "".join(some)
                    self._learn([whole])
                    found = np.array([self._slots[whole]])
                    if not self._good[found[0]]:
                        found = found[:0]
                yield found

    def align(self, texts: list[str | None]) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        return [";".join([self._text[k] for k in some.tolist()]) for some in self.slots(texts)]

    def __call__(self, texts: list[str | None]):
        """Links and their texts, and n_a, n_b, n_groups, n_links, groups and their sha256 of each text."""
        counts, pairs, digests = np.zeros((len(texts), 4), np.int64), [np.zeros(0, np.int64)], []
        for k, some in enumerate(self.slots(texts)):
            if not len(some):
                digests.append("")
                continue
            digests.append(hashlib.sha256(";".join(map(self._text.__getitem__, some.tolist())).encode()).hexdigest())
            own = self._counts[some]
            counts[k] = own.sum(axis=0)
            n = own[:, 3]
            pairs.append(self._pairs[np.repeat(self._at[some] - (np.cumsum(n) - n), n) + np.arange(counts[k, 3])])
        fields = dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts.T.copy()))
        return np.concatenate(pairs), np.repeat(np.arange(len(texts)), counts[:, 3]), fields | {"groups_sha256": digests}


_ALIGNERS: dict = {}


def _aligner(*how: str):
    """One aligner for each worker process; what it has seen serves the tasks that follow."""

    def start():
        if how not in _ALIGNERS:
            _ALIGNERS[how] = Aligner(*how)
        return _ALIGNERS[how]

    return start


def groups(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and groups of each document: array of (a: ids, b: ids)."""
    start = _aligner(path_a, path_b, "end")

    @F.arrow_udf("string")
    def aligned(texts: pa.Array) -> pa.Array:
        return pa.array(start().align(texts.to_pylist()), pa.string())

    ids = lambda side: F.transform(F.split(side, ","), lambda i: i.cast("int"))
    split = F.transform(F.filter(F.split(aligned(F.col(text_col)), ";"), lambda g: g != ""), lambda g: F.struct(ids(F.split_part(g, F.lit("|"), F.lit(1))).alias("a"), ids(F.split_part(g, F.lit("|"), F.lit(2))).alias("b")))
    return docs.select(F.col(id_col), split.alias("groups"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """key (an id pair), rows, n_linked and best: 1 if no other A id is linked with the B id more often."""
    counted = materialize(key_counts(blocks).select("key", "rows", F.col("n").alias("n_linked"), F.col("key").bitwiseAND((1 << _B_BITS) - 1).alias("b")), "pairs")
    top = counted.groupBy("b").agg(F.max("n_linked").alias("most"))  # a row for each B id, of its vocabulary at most
    return counted.join(F.broadcast(top), "b").select("key", "rows", "n_linked", (F.col("n_linked") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, *, links: str = "end", carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """row (the carried columns), n_a, n_b, n_groups, n_links, groups_sha256, best and n_linked (sums over links) of each document."""
    fields = "n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string"
    blocks = write_blocks(docs, _aligner(path_a, path_b, links), fields, "aligned", carry=carry, text_col=text_col)
    return weigh(blocks, materialize(pair_counts(blocks), "counted"), ["best", "n_linked"])


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("best").alias("n_best"), F.col("n_linked").alias("count_sum"), "groups_sha256")
