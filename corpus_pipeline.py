"""The corpus pipeline: five stages over ``documents``, each one operator of
``funnelkit.llm``.  Every stage's result is written as Parquet in the shared
folder and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import scratch, ship, stored, table, text_of
from funnelkit.llm.decontaminate import remove_contaminated
from funnelkit.llm.mixing import mix_documents
from funnelkit.llm.native import SPACES
from funnelkit.llm.ngram_join import near_duplicates
from funnelkit.llm.quality_model import keep_good
from funnelkit.llm.sharding import write_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; every row is
    judged by its own text, so repeated rows and ids share their fate, and
    empty and null texts are judged as empty.  No documents: none."""
    ship(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id
    (null ids last), of that id's texts the first by hash, of equal rows any
    one; documents without words stay."""
    ship(spark)
    return keep_first_of_groups(docs)


def keep_first_of_groups(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs).where("n_shingles > 0")
    # the least row of each group, told by its id and the hash of its text:
    # ids may be null or repeated
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node", "same")).alias("r"))
    # names that no column of the input has; the window and the join use the
    # same key, so the texts are shuffled once
    spare = "_" + max(docs.columns, key=len)
    key, null, same, place = f"{spare}_id", f"{spare}_null", f"{spare}_same", f"{spare}_place"
    known = lambda doc_id, text: (F.coalesce(doc_id.cast("long"), F.lit(0)).alias(key), doc_id.isNull().alias(null), text.alias(same))
    text = text_of(docs)
    wordless = F.translate(text, SPACES, "") == ""
    rows = docs.where(~wordless).select("*", *known(docs["doc_id"].cast("long"), F.xxhash64(text)))
    # of equal rows one, before the shuffle too: a filter on the place alone
    equal = Window.partitionBy(key, null, same).orderBy(F.lit(0))
    one = rows.withColumn(place, F.row_number().over(equal)).where(F.col(place) == 1)
    kept = one.join(least.select(*known(F.col("r.doc_id"), F.col("r.same"))), [key, null, same], "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(wordless))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; every row is judged by its own
    text.  Empty and null texts stay, as do all rows if the benchmark is empty."""
    ship(spark)
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark)
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shuffled shards: the columns of documents, then shard and slot (with
    underscores before a name that documents have already).  Every row is
    kept, repeated, null or empty."""
    ship(spark)
    out = write_shards(docs, scratch(spark, "corpus-shards"))
    added = []
    for name in ("shard", "slot"):
        own = name
        while own in docs.columns:
            own = f"_{own}"
        added.append(F.col(name).alias(own))
    return out.select(*[F.col("record")[c].alias(c) for c in docs.columns], *added)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("sharding", sharding),
]

#: no stage but the last could be said in SQL: models, sketches, seeded draws
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
