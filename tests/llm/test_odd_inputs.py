"""Every operator on empty tables, nulls, empty and long texts, repeated rows
and clashing columns."""

import pytest
from pyspark.sql import functions as F

from funnelkit.llm import decontaminate, mixing, ngram_join, page_text, quality_model, quality_rules, secret_scan, sharding, token_files, toxicity
from funnelkit.llm.queries import tokenizer_path

ODD = [(1, None), (None, "a null id " * 20), (2, ""), (3, "   \n\t"), (4, "one"), (5, "word " * 30_000), (6, "same text of ten words is in here two times"),
       (6, "same text of ten words is in here two times"), (7, "é x  ## <|endoftext|> password=abcdefgh1"), (8, "x", None, None)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (None, 1, 1), (5, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")


def runs(name, docs, labels, benchmark):
    return {
        "op1": lambda: token_files.op1(docs, tokenizer_path()),
        "op2": lambda: ngram_join.op2(docs),
        "op4": lambda: quality_rules.op4(docs),
        "op5": lambda: mixing.op5(docs),
        "op6": lambda: quality_model.op6(docs, labels),
        "op7": lambda: sharding.op7(docs),
        "op8": lambda: secret_scan.op8(docs),
        "op9": lambda: decontaminate.op9(docs, benchmark),
        "op10": lambda: toxicity.op10(docs, labels),
    }[name]()


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_odd_rows_and_empty_tables(spark, docs_of, labels, name):
    benchmark = spark.createDataFrame([(1, "same text of ten words is in here two times"), (2, None), (3, "")], "item_id long, text string")
    # columns that the operators use inside
    docs = docs_of(ODD).withColumn("size", F.lit("x")).withColumn("node", F.lit(1)).withColumn("score", F.lit(0)).withColumn("shard", F.lit("s"))
    rows = runs(name, docs, labels, benchmark).collect()
    if name == "op9":
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(6, 1), (6, 1)]
    else:
        assert len(rows) == len(ODD)
        by_id = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
        assert by_id == sorted((r[0] is None, r[0] or 0) for r in ODD)
    assert runs(name, docs_of([]), labels.limit(0), benchmark.limit(0)).count() == 0


def test_pages(spark, docs_of):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>un"), (3, "u", "<article><p>a &amp; b<br>c</p><p>d" + " e" * 50_000)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in page_text.op3(pages.withColumn("text", F.lit(1))).collect()}
    assert rows[1].text == "" and rows[2].text == "" and rows[1].n_chars == 0
    assert rows[3].text == "a & b c\n\nd" + " e" * 50_000
    assert page_text.op3(pages.limit(0)).count() == 0


def test_pipeline_stages_keep_columns(spark, docs_of, tmp_path):
    from corpus_pipeline import keep_first_of_groups

    docs = docs_of(ODD).withColumn("component_id", F.lit("x"))
    kept = keep_first_of_groups(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 5, 6, 7, 8]
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    clean = decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, ODD[6][1])], "item_id long, text string"))
    assert clean.columns == docs.columns and clean.where("doc_id = 6").count() == 0 and clean.count() == len(ODD) - 2


def test_pipeline_keeps_a_text_of_every_group(spark, docs_of):
    """Null ids and repeated ids with different texts: no clean text is lost."""
    from corpus_pipeline import keep_first_of_groups

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (5, text(3)), *[(5, text(k)) for k in range(4, 12)],
            (20, text(20)), (20, text(20) + " more"), (None, text(20)), (21, text(21)), (21, text(21).upper()), (None, " "), (None, None), (22, ""), (22, "")]
    kept = [(r.doc_id, r.text) for r in keep_first_of_groups(docs_of(rows)).collect()]
    # one text of every group, under the group's least id
    group = {(i, (t or "").lower().removesuffix(" more")) for i, t in kept}
    assert group == {(None, text(0)), (None, text(1)), (None, text(2)), (3, text(3)), *[(5, text(k)) for k in range(4, 12)],
                     (20, text(20)), (21, text(21)), (None, " "), (None, ""), (22, "")}
    assert len(kept) == len(group) + 1


def test_shards_do_not_depend_on_the_order_of_arrival(spark, docs_of, tmp_path):
    from funnelkit.llm.common import scratch

    docs = docs_of([(k % 37, f"text {k % 50}") for k in range(300)] + ODD).repartition(4).cache()
    docs.count()
    one, two = (sharding.write_shards(docs, scratch(spark, "s"), shards=3, bucket_bytes=200).select("record", "shard", "slot", "bucket", "place").collect() for _ in range(2))
    assert sorted(map(repr, one)) == sorted(map(repr, two)) and len(one) == 300 + len(ODD)


def test_many_matches_and_very_frequent_rows(spark, docs_of):
    import time

    from test_results import base_spans

    many = "".join(f"x token=abcdefgh{k} y\n\nplain words\n\n" for k in range(5_000))
    docs = docs_of([(1, many), (2, "a password=abcdefgh1 b"), (3, "none")]).unionByName(docs_of([(2, "a password=abcdefgh1 b")] * 9_000))
    t = time.perf_counter()
    rows = secret_scan.op8(docs).collect()
    assert time.perf_counter() - t < 60
    assert len(rows) == 9_003 and sum(r.n_assign for r in rows) == 5_000 + 9_001
    assert next(r.spans for r in rows if r.doc_id == 1) == base_spans(many)


def test_whole_pipeline(spark, tmp_path):
    """All stages in order on odd documents: columns, ids and empty tables."""
    import shutil

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", None, 0), (None, "", None, "x", 0), (7_000_001, "w " * 30_000, "en", "x", 1)], docs.schema)
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(odd).withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(1.5)).withColumn("component", F.lit(None).cast("string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "mixing sources", "sharding"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "_shard", "_slot"]
    rows = out.collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert rows and {(r.doc_id, r.text) for r in rows} <= texts and {r.shard for r in rows} == {"mine"}
    slots = {}
    for r in rows:
        slots.setdefault(r._shard, []).append(r._slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    empty = tmp_path / "none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
