"""The dealt operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from funnelkit.llm.common import ship, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.token_files import op1

    return op1(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.ngram_join import op2

    return op2(table(spark, sf_dir, "documents"))


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.page_text import op3

    return op3(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.quality_rules import op4

    return op4(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.mixing import op5

    return op5(table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.quality_model import op6

    return op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.sharding import op7

    return op7(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.secret_scan import op8

    return op8(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.decontaminate import op9

    return op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.toxicity import op10

    return op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.whitening import op11

    return op11(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.warc import op12

    return op12(table(spark, sf_dir, "pages"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelkit.llm.phrases import op13

    return op13(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return query

    dealt = (op1_token_files, op2_ngram_join, op3_page_text, op4_quality_rules, op5_mix_sources, op6_quality_model,
             op7_shuffle_shards, op8_secrets, op9_decontaminate, op10_toxicity, op11_whitening, op12_warc, op13_phrases)
    return {f.__name__: shipped(f) for f in dealt}


def oracle_sql() -> dict[str, str]:
    from funnelkit.llm import oracle

    return {"op12_warc": oracle.OP12, "op13_phrases": oracle.OP13}
