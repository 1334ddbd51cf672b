"""The pipeline's stages in order, each against its operator applied on its own, and over odd rows."""

import collections

import corpus_pipeline
from pyspark import SparkContext
from seatloom.llm import quality
from seatloom.llm.common import documents

from .test_native import plain_dedup
from .test_simhash import components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    kept = {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), stage(spark, docs, SF).schema)
        kept[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    assert list(kept) == ["quality classifier", "quality rules", "line dedup", "near dedup", "packing"]
    before, after = kept["quality classifier"]
    model = quality.learn(documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if quality.sigmoid(model.a * model.margin(quality.features(r.text)) + model.b) >= 0.3}
    before, after = kept["quality rules"]
    assert 0 < len(after) <= len(before)
    before, after = kept["line dedup"]
    want = plain_dedup([(r.doc_id, r.text) for r in before], 10)
    assert {r.doc_id: r.text for r in after} == {r.doc_id: want[r.doc_id, r.text][2] for r in before}
    before, after = kept["near dedup"]
    fps = {r.doc_id: plain_fingerprint(r.text) for r in before}
    groups = components(set(fps.values()), 4)
    assert sorted(r.doc_id for r in after) == sorted({groups[f]: d for d, f in sorted(fps.items(), reverse=True)}.values())
    assert len(after) == len({groups[f] for f in fps.values()})  # one document of each group
    before, after = kept["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    final = {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    assert final == {(r.doc_id, r.start, r.ids_crc32) for r in after}


def write_tables(spark, rows, path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, row string, h1 string, kept string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(k % 3 > 0), 0) for k, r in enumerate(rows)] + [(None, None, None), (1, None, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_odd_rows_go_through(spark, tmp_path, edge_rows):
    """Nulls, repeats, shared ids and clashing columns: each stage works on what the one before kept, and loses nothing else."""
    rows = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), "own", "row", None, "kept") for r in edge_rows]
    rows += [(3, "a text of its own under a used id " * 5, "en", "s0", 1, "x", None, "y", None)] * 2
    write_tables(spark, rows, tmp_path)
    docs = documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        before, after = docs.collect(), out.collect()
        if name == "packing":
            assert collections.Counter(r.doc_id for r in after if r.start == 0) == collections.Counter(r.doc_id for r in before)
            break
        assert out.columns == docs.columns
        own = lambda x, but=(): collections.Counter(tuple(r[c] for c in out.columns if c not in but) for r in x)
        assert not own(after, ("text", "n_chars")) - own(before, ("text", "n_chars"))
        if name == "line dedup":
            assert len(after) == len(before)
            want = plain_dedup([(r.doc_id, r.text) for r in before], 10)
            assert collections.Counter((r.doc_id, r.text) for r in after) == collections.Counter((r.doc_id, None if r.text is None else want[r.doc_id, r.text][2]) for r in before)
        if name == "near dedup":
            fps = {r.text: plain_fingerprint(r.text) for r in before}
            groups = components(set(fps.values()), 4)
            assert sorted(groups[fps[r.text]] for r in after) == sorted({groups[f] for f in fps.values()})
        docs = spark.createDataFrame(after, out.schema)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_an_empty_table(spark, tmp_path):
    write_tables(spark, [], tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_make_no_tables_by_further_workers(spark, monkeypatch):
    """A table made of a Python list has a daemon and workers of its own on every executor, beside those of the operators."""

    def refuse(*_, **__):
        raise AssertionError("a Python list became a distributed table")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    assert corpus_pipeline.run(spark, SF).count()
