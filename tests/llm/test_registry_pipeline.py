"""Queries against their SQL, and the pipeline's stages against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fernmark.llm import mixing, registry, toxicity
from fernmark.llm._common import made
from tests.llm.fixtures import component_ids, rows_of
from tests.llm.test_native import brute_hits
from tests.oracle import check, connect


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    check(connect(sf_dir), registry.QUERIES[name](spark, sf_dir).toPandas(), registry.ORACLES[name])


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))


def brute_tokens(rows):
    """What the token files hold of rows in the order of id and text."""
    tok, start, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def same(rows):
    return sorted(map(str, rows))


def stages(spark, docs, sf_dir, tmp_path):
    """Every stage's input and output."""
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == before.columns
        kept[name] = (rows_of(before), rows_of(docs))
    return kept


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stages(spark, docs, sf_dir, tmp_path)
    before, after = kept["toxicity"]
    model = toxicity.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert same(after) == same(r for r in before if toxicity.score_texts(model, [r["text"]])[0][0] < 0.5)
    before, after = kept["near_duplicates"]
    groups = component_ids({r["doc_id"]: r["text"] for r in before})
    assert same(after) == same(r for r in before if groups[r["doc_id"]][1] == r["doc_id"])
    before, after = kept["decontamination"]
    items = [(r["item_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))]
    assert same(after) == same(r for r in before if not brute_hits(r["text"], items)[1])
    before, after = kept["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mix_sources(spark.createDataFrame(before, docs.schema)))}
    assert same(after) == same(r for r in before for _ in range(copies[r["doc_id"]]))
    before, after = kept["tokens"]
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in after) == sorted(brute_tokens(before))


def test_run_equals_its_stages(spark, sf_dir, tmp_path):
    begun = made()
    got = rows_of(corpus_pipeline.run(spark, sf_dir))
    assert made() == begun  # what stages made on their way is gone
    assert same(got) == same(stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, tmp_path)["tokens"][1])


@pytest.fixture
def awkward(spark, tmp_path):
    """Rows with nulls, shared and missing ids, repeated rows, a long text and columns named like those inside; labels; a benchmark."""
    long = " ".join(f"w{k}" for k in range(60_000))
    leak = "this very passage stands in the benchmark and so it has to go away now"
    vile = " ".join(f"filler{k} word" for k in range(8)) + " grotty vilest"
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(3, a), (7, a), (7, b), (None, b + " x"), (None, leak), (None, "clean words of a row without an id"), (8, f"said {leak} then " + " ".join(f"more{k}" for k in range(20))), (8, "another text of the same id"), (9, long), (10, long + " more")]
    rows += [(11, None), (11, None), (12, ""), (13, vile), (None, vile + " again"), (14, "twice the same row"), (14, "twice the same row")]
    train = [(100 + k, f"plain text number {k} " + " ".join(f"t{k}x{j}" for j in range(20)) + (" grotty vilest" if k % 2 else "")) for k in range(120)]
    names = ["copies", "copy", "mixed_id", "component", "key", "id", "rid", "size", "node", "row"]
    data = [(i, t, None if k % 4 == 0 else f"s{k % 2}", *[k] * len(names)) for k, (i, t) in enumerate(rows + train)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names)
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(100 + k, 1, k % 2) for k in range(120)] + [(None, 1, 1), (13, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.createDataFrame(data, schema)
    docs.write.parquet(f"{sf}/documents.parquet")
    return docs, sf, dict(a=a, b=b, leak=leak, vile=vile, long=long)


def test_stages_on_awkward_rows(spark, awkward, tmp_path):
    docs, sf, t = awkward
    texts = lambda rows: [(r["doc_id"], r["text"]) for r in rows]
    kept = stages(spark, docs, sf, tmp_path)
    before, after = kept["toxicity"]
    assert not [r for r in after if "vilest" in (r["text"] or "")] and same(r for r in before if "vilest" not in (r["text"] or "")) == same(after)
    found = texts(kept["near_duplicates"][1])
    assert (3, t["a"]) in found and (7, t["a"]) not in found and (7, t["b"]) in found and (None, t["b"] + " x") not in found
    assert (9, t["long"]) in found and (10, t["long"] + " more") not in found
    assert found.count((11, None)) == 2 and found.count((14, "twice the same row")) == 1 and (12, "") in found
    before, after = kept["decontamination"]
    assert same(r for r in before if t["leak"] not in (r["text"] or "")) == same(after) and len(before) - len(after) == 2
    before, after = kept["mixing"]
    assert set(map(str, after)) <= set(map(str, before)) and max(map(same(after).count, same(after))) <= 3
    before, after = kept["tokens"]
    assert len(before) == len(after) and sum(r["n_tokens"] for r in after) == sum(n for _, _, n, _ in brute_tokens(before))


def test_stages_on_an_empty_table(spark, awkward, tmp_path):
    docs, sf, _ = awkward
    assert all(not after for _, after in stages(spark, docs.limit(0), sf, tmp_path).values())


def test_mix_of_rows_alike(spark):
    """Rows alike share what they are given; a column named like one inside is kept."""
    rows = [(1, "one two", "s", 5)] * 4 + [(1, "one two", "other", 6), (2, "three", None, 7), (None, None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    taken, out = rows_of(mixing.mix_sources(docs)), rows_of(mixing.take(docs))
    assert sum(r["copies"] for r in taken) == len(out)
    for source in ("s", "other", None):
        assert sum(r["copies"] for r in taken if r["source"] == source) == sum(r["source"] == source for r in out)


def test_stages_keep_columns_of_any_type(spark, awkward, tmp_path):
    """A map column, which has no order, in rows that repeat."""
    from pyspark.sql import functions as F

    docs, sf, _ = awkward
    docs = docs.withColumn("about", F.create_map(F.lit("k"), F.col("size")))
    kept = stages(spark, docs, sf, tmp_path)
    assert all("about" in r for r in kept["mixing"][1]) and len(kept["tokens"][1]) == len(kept["mixing"][1])


def test_missing_package_or_missing_library():
    """Only the absence of the subpackage is excused."""
    import subprocess
    import sys

    code = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    run = lambda name: subprocess.run([sys.executable, "-c", code.format(name)], capture_output=True, text=True)
    assert run("fernmark.llm").stdout.split()[1] == "False"
    assert run("xxhash").returncode != 0


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from fernmark.llm import _common

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn", applicationId="a"))
    with pytest.raises(RuntimeError):
        _common.shared_dir(session)
