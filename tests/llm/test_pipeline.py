"""The pipeline end to end on the small tables."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    from tallyfold.llm.shared import stash

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, DATA), "test")
        assert docs.columns == columns, name
        assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.where("piece = 0").count() == docs.count()


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_odd_rows_pass_through_every_stage(spark):
    """Nulls in any column, empty and very long texts, repeated rows and columns with clashing names."""
    from tallyfold.llm.shared import stash

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").limit(120).collect()]
    good = max(rows, key=lambda r: len(WORD.findall(r[1] or "")))
    rows += [rows[0], rows[1], (None, good[1] + " and more", "en", "s"), (900_001, None, "en", "s"), (900_002, "", None, None), (900_003, good[1] * 40, None, None), (900_004, " \n\t ", "xx", "s"), (900_005, "x" * 300_000, "en", None)]
    docs = spark.createDataFrame([(*r, "kept", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, kept string, token int, `size` int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, DATA), "odd")
        assert docs.columns == ["doc_id", "text", "lang", "source", "kept", "token", "size"], name
        assert docs.where("kept != 'kept' OR token != 1 OR `size` != 2").count() == 0
    held = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not held & {900_001, 900_002, 900_004}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.where("piece = 0").count() == docs.count()


def test_stages_are_packed_and_mixed_texts_are_shuffled_once(spark):
    """What a stage leaves is written with the closer codec, and the mix shuffles no text twice side by side."""
    from tallyfold.llm import mixing
    from tallyfold.llm.shared import stash

    docs = spark.createDataFrame([(k, f"word{k} and more of it", "en", f"s{k % 3}", 20) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stash(docs, "stage", codec="zstd")
    assert all(f.endswith(".zstd.parquet") for f in kept.inputFiles())
    assert sorted(kept.collect()) == sorted(docs.collect())
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Project [" in line and "_in_text#" in line]
    assert lines and not any(re.search(r"(\[|, )text#\d+(,|\])", line) for line in lines)


def test_what_a_stage_has_used_up_does_not_lie_on_disk(spark):
    """A written frame leaves no shuffle files behind, and the join none of its postings, prefixes or pairs."""
    import glob
    import time

    from tallyfold.llm import ngram_join
    from tallyfold.llm.shared import scratch, stash

    def shuffled():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    kept = stash(spark.range(50_000).selectExpr("id % 9000 AS k").groupBy("k").count(), "tidy")
    until = time.time() + 5
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert kept.count() == 9000

    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(k, f"{text} {k}") for k in range(5)] + [(9, "another text that has some words")], "doc_id long, text string")
    held = f"{scratch(spark).removeprefix('file://')}/tallyfold/"
    there = set(glob.glob(f"{held}*"))
    assert sorted(r.doc_id for r in ngram_join.deduplicate(docs).collect()) == [0, 9]
    left = {f.removeprefix(held).rpartition("-")[0] for f in set(glob.glob(f"{held}*")) - there}
    assert left and not left & {"postings", "banded", "prefixes", "lists"}
