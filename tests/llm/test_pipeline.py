"""The corpus pipeline, stage by stage and as a whole."""

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import functions as F
from text_samples import DOCS

from studyframe.llm import quality, sentencepiece_codec, warc

GOOD = "The river runs past the old mill and the village where {0} people gather every {1} to trade bread, cheese and stories of the long winter that came before the {2} flood"
RULES = dict.fromkeys(("quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"))


def rows():
    """Distinct good texts, a near and an exact copy, texts that fail a base rule, nulls, empties, repeated rows, no ids."""
    words = "amber birch cedar dune ember fjord grove heath isle jetty knoll larch marsh north ocean pine quarry reef shore tarn".split()
    texts = [" ".join(f"{a}{i} {b}" for a in words for b in (words[(i * 7 + len(a) * 3) % 20], words[(i + ord(a[0])) % 20])) for i in range(12)]
    out = [(i, f"{t} line of document {i}", f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(100, out[0][1], "s0"), (101, out[1][1] + " tail", "s1"), (200, "too short", "s0"), (201, "a b c d e f g h " * 9, "s1"), (202, None, "s2"), (203, "", None), (5, out[5][1], "s2")]
    return out + [(None, GOOD.format("twelve", "Sunday", "great") + " without an id at all, and it goes on for a while longer", None)]


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows()], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(6)] + [(200, 0, 0), (999, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    return str(tmp_path)


def test_stages_in_order(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == list(RULES)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        seen[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: sorted(r["doc_id"] for r in found if r["doc_id"] is not None) for name, found in seen.items()}
    failed = {200, 201, 202, 203}
    assert ids["quality_rules"] == sorted(i for i, _, _ in rows() if i is not None and i not in failed)
    assert not {200, 201, 202, 203} & set(ids["line_dedup"])
    left = ids["ngram_jaccard_join"]
    assert {i for i in left if left.count(i) > 1} <= {5}  # rows that repeat an id and its text stay together
    assert set(range(2, 12)) <= set(left) and len({0, 100} & set(left)) == len({1, 101} & set(left)) == 1
    assert set(ids["mixing"]) <= set(left) and len(ids["mixing"]) > 0
    by_id = {(r["doc_id"], r["text"]) for r in seen["mixing"]}
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    want = sorted((i if i is not None else -1, model.encode(t)) for i, t in by_id for _ in range(sum((r["doc_id"], r["text"]) == (i, t) for r in seen["mixing"])))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in seen["sentencepiece"]) == want


def test_run_of_whole_and_empty_tables(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and out.count() > 0 and out.where("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.run(spark, f"{folder}/empty").collect() == []


def test_lines_are_cut_by_one_worker_per_task(spark, folder):
    """The stage's filter reads the text that is left; it must not have the lines cut a second time."""
    out = corpus_pipeline.without_repeated_lines(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_kept_rows_are_those_of_the_rules(spark, folder):
    """The stage judges in place; the operator says the same of every row, with a model and without one."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionAll(docs).withColumn("kept", F.lit("x")).withColumn("probability", F.lit(None).cast("double"))
    for model in (None, quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))):
        want = sorted(str(r["doc_id"]) for r in quality.quality_rules(docs, model).where("kept").collect())
        got = quality.keep_good(docs, model)
        assert got.schema == docs.schema and sorted(str(r["doc_id"]) for r in got.collect()) == want
    assert quality.keep_good(docs.where("false"), None).collect() == []


def test_many_ranges_are_read_by_many_tasks(spark):
    files = spark.createDataFrame([(f"/nowhere/{i}", 4 << 30) for i in range(40)], "path string, bytes long")
    plan = warc.read_archives(spark, files)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and " 64)" in plan.replace("), 64", " 64)")
    few = warc.read_archives(spark, files.limit(1), range_bytes=2 << 30)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in few
