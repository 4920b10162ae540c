"""Chat rotation, decontamination and mixing."""

import re

from fernmark.llm import chat, decontam, mixing
from tests.llm.fixtures import documents, empty, lower, rows_of


def test_rotation(spark):
    conv = spark.createDataFrame(
        [(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", None, 9), (1, 3, None, "who", 9), (1, 3, "ann", "tie", 9), (2, None, "ann", "", 9), (None, 1, "x", "y", 9)], "conv_id long, turn long, role string, text string, seq long"
    )
    rotated = chat.rotate(conv)
    full = {(r["conv_id"], r["speaker"]): r for r in rows_of(chat.render(rotated))}
    assert set(full) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "x")}
    ann = full[1, "ann"]
    assert ann["dialogue"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\ntie<|end|>\n<|user name=unknown|>\nwho<|end|>\n"
    assert [ann["dialogue"][s["start"] : s["end"]] for s in ann["spans"]] == ["hi<|end|>", "tie<|end|>"]
    assert chat.rotate(conv.limit(0)).count() == 0


def test_places_over_many_blocks(spark, monkeypatch):
    conv = spark.createDataFrame([(1, k, "ab"[k % 2], "x" * (k % 7)) for k in range(1000)], "conv_id long, turn long, role string, text string")
    a = sorted((r["speaker"], r["seq"], r["char_start"], r["char_end"]) for r in rows_of(chat.rotate(conv)))
    monkeypatch.setattr(chat, "TURNS_A_BLOCK", 7)
    b = sorted((r["speaker"], r["seq"], r["char_start"], r["char_end"]) for r in rows_of(chat.rotate(conv)))
    assert a == b and [x[1] for x in a[:1000]] == list(range(1000)) and all(p[3] == q[2] for p, q in zip(a[:999], a[1:1000]))


def test_one_number_for_most_turns(spark, monkeypatch):
    """Blocks over the bound are cut by range, inside a number and inside rows alike; places and order stay."""
    rows = [(1, None, "ab"[k % 2], "x" * (k % 5)) for k in range(300)] + [(1, 7, "c", "same")] * 300 + [(1, k, "ab"[k % 2], str(k)) for k in range(600)] + [(None, None, None, str(k % 9)) for k in range(200)] + [(2, 1, "ann", "hi")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(str, rows_of(chat.rotate(conv))))
    monkeypatch.setattr(chat, "MOST_IN_BLOCK", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (500_000, 0):
            monkeypatch.setattr(chat, "MAX_BROADCAST_ROWS", most)
            assert sorted(map(str, rows_of(chat.rotate(conv)))) == whole
        turns = conv.selectExpr("'i1' c", "0 block", "turn", "role who", "text", "conv_id").where("conv_id = 1")
        parts = [r["count"] for r in chat._in_parts(turns)[0].groupBy("part").count().collect()]
        assert sum(parts) == 1200 and max(parts) < 800
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_hits(doc, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    w, hit, which = split(doc), set(), set()
    for item, text in items:
        v = split(text)
        for s in range(max(1, len(v) - n + 1)) if v else []:
            window = v[s : s + n]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    which.add(str(item))
    return len(w), len(hit), sorted(which)


def test_decontamination(spark, monkeypatch):
    docs = documents(spark)
    texts = [r["text"] for r in rows_of(docs)]
    base = texts[5].split()
    items = [(1, " ".join(base[20:45])), (2, "one"), (10, "TWO, three"), (3, None), (4, "..."), (5, " ".join(base[380:395])), (5, "日本"), (6, "not there at all"), (7, "ab ab ab ab ab ab ab ab ab ab ab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r["doc_id"], *brute_hits(r["text"], items)) for r in rows_of(docs)), key=str)
    for most in (500_000, 0):
        monkeypatch.setattr(decontam, "MAX_BROADCAST_ROWS", most)
        got = rows_of(decontam.decontaminate(docs, bench))
        unique = [r for r in got if r["doc_id"] is not None]
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == want and unique
    assert {r["n_hit"] for r in rows_of(decontam.decontaminate(docs, bench.limit(0)))} == {0}
    assert decontam.decontaminate(empty(spark), bench).count() == 0


def test_a_window_of_all_items(spark, monkeypatch):
    """Items of a shared window are joined last, as rows."""
    docs = spark.createDataFrame([(1, "so it is: one two three"), (2, "one two"), (3, "two three four five")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, "ONE two") for k in range(500)] + [(900, "four five"), (901, "three four"), (902, "five six")], "item_id long, text string")
    for most in (500_000, 0):
        monkeypatch.setattr(decontam, "MAX_BROADCAST_ROWS", most)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows_of(decontam.decontaminate(docs, bench))}
        every = sorted(map(str, range(500)))
        assert got == {1: (6, 2, every), 2: (2, 2, every), 3: (4, 3, ["900", "901"])}


def test_a_filter_does_not_split_again(spark):
    """Whatever is asked of the result, no text is split inside a lambda or a filter."""
    docs, bench = documents(spark), spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    plan = decontam.decontaminate(docs, bench).where("n_hit > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and not re.search(r"lambda[^\n]*split\(", plan)
    assert not [x for x in plan.split("\n") if "Filter" in x and "split(" in x]


def test_contamination_of_long_texts(spark):
    """A window at the very end of a long text, and a text that is one word over and over."""
    end = " ".join(f"b{k}" for k in range(10))
    docs = spark.createDataFrame([("a", "w " * 100_000 + end), ("b", "ab " * 50_000)], "doc_id string, text string")
    bench = spark.createDataFrame([("x", end), ("y", "ab " * 30), ("z", "ab " * 12 + "no")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows_of(decontam.decontaminate(docs, bench))}
    assert got == {"a": (100_010, 10, ["x"]), "b": (50_000, 50_000, ["y", "z"])}
    assert [r["doc_id"] for r in rows_of(decontam.drop_contaminated(docs, bench.where("item_id = 'x'")))] == ["b"]


def test_long_turns(spark):
    conv = spark.createDataFrame([("c", 0, "ann", "x" * 500_000), ("c", 1, "bob", "y")], "conv_id string, turn long, role string, text string")
    got = {(r["speaker"], r["seq"]): (r["char_start"], r["char_end"], r["mask_start"], r["mask_end"]) for r in rows_of(chat.rotate(conv))}
    head = len("<|assistant|>\n")
    assert got["ann", 0] == (0, head + 500_008, head, head + 500_007) and got["bob", 1][0] == len("<|user name=ann|>\n") + 500_008


def test_mixing_a_long_text(spark):
    docs = spark.createDataFrame([("a", "w " * 200_000, "s"), ("b", "one", "s"), ("c", "two words", "t")], "doc_id string, text string, source string")
    got = {r["doc_id"]: r["size"] for r in rows_of(mixing.mix_sources(docs))}
    assert got == {"a": 200_000, "b": 1, "c": 2}


def brute_targets(sizes, weights, most=3):
    """Water-filling step by step."""
    budget, fixed = sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        if not free:
            return [float(fixed[k]) for k in range(len(sizes))]
        level = (budget - sum(fixed.values())) / sum(weights[k] for k in free)
        over = [k for k in free if level * weights[k] > most * sizes[k]]
        if not over:
            return [float(fixed[k]) if k in fixed else level * weights[k] for k in range(len(sizes))]
        fixed |= {k: most * sizes[k] for k in over}


def test_mixing(spark):
    docs = documents(spark)
    got = rows_of(mixing.mix_sources(docs))
    names = sorted({r["source"] for r in got} - {None}) + [None]
    sizes = [sum(r["size"] for r in got if r["source"] == s) for s in names]
    targets = brute_targets(sizes, [k % 3 + 1 for k in range(len(names))])
    largest = max(r["size"] for r in got)
    for s, size, target in zip(names, sizes, targets):
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size} and all(abs(r["target"] - target) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= 2 * largest
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    assert sum(r["taken"] for r in got) <= sum(sizes)
    again = rows_of(mixing.mix_sources(docs.repartition(3)))
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_mixing_one_hot_source(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 9), "hot" if k % 10 else f"s{k % 7}") for k in range(3000)], "doc_id long, text string, source string")
    got = rows_of(mixing.mix_sources(docs))
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 30
