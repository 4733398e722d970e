"""Each stage on its own input, and the whole run."""

import hashlib
import re
from pathlib import Path

import corpus_pipeline as cp
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from barloom.llm import bpe, common, lines, mixing
from barloom.llm.queries import RANKS
from tests.llm.test_texts import by_definition, plain_groups


def test_stages_follow_the_plain_versions(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            good = [i for i, q in labels.items() if q == 1]
            bad = [i for i, q in labels.items() if q == 0]
            assert sum(i in got for i in good) >= 0.99 * len(good) and sum(i in got for i in bad) <= 0.1 * len(bad)
        elif name == "line_dedup":
            want = {i: t for (i, _), t in by_definition([(r.doc_id, r.text) for r in rows.values()]).items()}
            kept = {i: t for i, t in want.items() if t.strip() or not rows[i].text.strip()}
            assert {i: r.text for i, r in got.items()} == kept
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_duplicates":
            want = plain_groups([(r.doc_id, r.text) for r in rows.values()])
            assert set(got) == {i for i, (_, c) in want.items() if i == c}
        elif name == "mixing":
            assert set(got) == set(rows) and docs.count() == len(rows)
        else:
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
            assert {i: r.n_tokens for i, r in got.items()} == {i: len(enc.encode_ordinary(r.text)) for i, r in rows.items()}
            assert all(r.decoded_sha256 == hashlib.sha256(rows[i].text.encode()).hexdigest() for i, r in got.items())
        rows = got


def test_rows_keep_the_order_of_the_mix_over_several_files(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        cp.mix_sources(spark, docs, sf).write.parquet(str(tmp_path / "mixed"))
        assert len(list((tmp_path / "mixed").glob("*.parquet"))) > 1
        got = cp.tokenize(spark, spark.read.parquet(str(tmp_path / "mixed")), sf).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = mixing.mix(docs).select("doc_id", "mix.slot", "mix.row").orderBy("slot", "row").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    assert [(r.mix_slot, r.mix_row) for r in got] == [(r.slot, r.row) for r in want]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_odd_and_empty_tables(spark, docs, no_docs, name):
    stage = dict(cp.STAGES)[name]
    sf = "/root/testdata/sf0.001"
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = stage(spark, own, sf).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in own.collect()}
    assert stage(spark, no_docs, sf).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES[:-1]])
def test_stages_keep_columns_with_names_like_their_own(spark, docs, name):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for c in ("_score", "_lines", "_mix", "_row", "_k", "_d"):
        own = own.withColumn(c, cp.F.lit("x"))
    out = dict(cp.STAGES)[name](spark, own, "/root/testdata/sf0.001")
    assert out.columns == own.columns
    assert all(r[c] == "x" for r in out.collect() for c in ("_score", "_lines", "_mix", "_row", "_k", "_d"))


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "en", "s", 1), (2, b, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "t", 1), (3, b, "en", "s", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for order in (rows, rows[::-1]):
        out = cp.keep_one_of_each_group(spark, spark.createDataFrame(order, schema), "/root/testdata/sf0.001")
        assert sorted((r.doc_id, r.text, r.source) for r in out.collect()) == [(1, a, "s"), (2, b, "s")]


def test_stages_without_tables_let_go_of_earlier_ones(monkeypatch):
    """What the encoder of one stage left in a worker goes when lines or quality start in it."""
    stage = [1]
    monkeypatch.setattr(common, "_stage", lambda: stage[0], raising=False)
    monkeypatch.setattr(common, "_WORKER", {})
    none = pa.array([None], pa.list_(pa.int32()))
    common.per_worker(("encoder", "a"), object)
    lines._cut(pa.array(["x"]), none, none)
    assert "encoder" in common._WORKER  # of the same stage
    stage[0] = 2
    lines._cut(pa.array(["x"]), none, none)
    assert not common._WORKER


def test_encoding_hands_freed_memory_back(spark, monkeypatch):
    """A worker that has encoded holds its tables, not what encoding freed (some 100 MB for 7 MB of text)."""

    def held() -> float:
        return sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    monkeypatch.setattr(common, "_WORKER", {})
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(3000)
    texts = [r.text or "" for r in docs.collect()]
    seen = []
    own = bpe.F.arrow_udf
    monkeypatch.setattr(bpe.F, "arrow_udf", lambda fn, kind: seen.append(fn) or own(fn, kind))
    bpe.encode(docs, RANKS, decoded=True)
    for i in range(0, len(texts), 750):
        got = seen[0](pa.array(texts[i : i + 750]))
        assert got.field("decoded").to_pylist() == [t.encode() for t in texts[i : i + 750]]
    del got
    after = held()
    common.give_back()
    assert after - held() < 30
