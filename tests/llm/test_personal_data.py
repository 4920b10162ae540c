"""Spans of personal data against the patterns as they are stated, and checks by hand."""

import hashlib
import random
import re

from fernmark.llm import personal_data as pii
from tests.llm.fixtures import documents, empty, rows_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(kind, m[0])]


def base(text):
    return [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(text) if s["kind"] in pii.BASE]


def test_base_against_the_patterns():
    rng = random.Random(3)
    texts = [None, "", "a@b.c_d@e.f", "a@@b.c", "x@y", "x@y.z.", "@a.b", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.2.3.04", "1..2.3.4", "+1 (2) 3", "+12345678", "é+49 30 1234567é", "4111 1111 1111 1111-", "4111-1111--11111111"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for alphabet in ("a.@-_1", "12.3 ", "+1 (2)-.", "0123456789 -", "a@b.1+é ") for _ in range(3000)]
    texts += [str(rng.randrange(10**15, 10**17)) + c for _ in range(3000) for c in (" ", "-1", "x")]
    for t in texts:
        assert base(t) == brute(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "AB12" * 80_000, "0 " * 150_000, "(12) " * 60_000):
        assert base(t + " x@y.zz")[0][0] == "email"


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


def kinds(text):
    return [s["kind"] for s in pii.spans_of(text)]


def test_added_kinds():
    assert kinds("konto DE89 3704 0044 0532 0130 00.") == ["iban"] and kinds("DE89370400440532013000") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32, danke") == ["iban"] and kinds("GB82 WEST 1234 5698 7654 33") == []
    assert kinds("her ssn is 536-90-4399") == ["ssn"] and kinds("part 536-90-4399 of it") == [] and kinds("ssn 666-90-4399") == []
    assert kinds("amex 3782 822463 10005") == ["short_card"] and kinds("nr 378282246310005") == []
    assert kinds("Tel. (030) 901820") == ["local_phone"] and kinds("see (030) 901820") == []
    found = pii.spans_of("card 4111 1111 1111 1111")[0]
    assert found["score"] == 1.0 and found["confirmed"] and pii.spans_of("order 4111111111111111")[0]["score"] == 0.4
    assert pii.spans_of("version 1.2.3.4")[0]["score"] < pii.spans_of("host 1.2.3.4")[0]["score"]


def test_redacted_texts():
    assert pii.redact("write to a.b@c.de or +1 (212) 555-0100, é") == "write to [EMAIL] or [PHONE], é"
    assert pii.redact(None) is None and pii.redact("") == "" and pii.redact("clean 12") == "clean 12"
    assert pii.redact("+1234567890123456") == "+1234567890123456"


def test_queries_rows(spark, tmp_path):
    docs = documents(spark).union(spark.createDataFrame([(900, "é x@y.org, 10.0.0.1 +1 (212) 555-0100 4111111111111111 ssn 536-90-4399", None, None, 0, 1, "h", 2, 3, "k", "m")], documents(spark).schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in rows_of(docs)]
    got = rows_of(pii.op13_personal_data(spark, str(tmp_path)))
    want = []
    for i, t in rows:
        b = brute(t)
        n = [sum(k == kind for k, _, _ in b) for kind in PATTERNS]
        want.append((i, *n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()))
    assert sorted(str(tuple(r.values())[:-1]) for r in got) == sorted(map(str, want))
    own = next(r for r in got if r["doc_id"] == 900)
    assert own["spans"].split(",")[-1].startswith("ssn:") and own["spans"].startswith("email:2:9,ip:11:19,")


def test_awkward_rows(spark):
    docs = documents(spark)
    cleaned = pii.redacted(docs)
    assert cleaned.columns == docs.columns and sorted(map(str, rows_of(cleaned))) == sorted(map(str, rows_of(docs)))  # there is none in these
    assert rows_of(empty(spark).select(pii.spans("text").alias("s"))) == [] and rows_of(pii.redacted(empty(spark))) == []
