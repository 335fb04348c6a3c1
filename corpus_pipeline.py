"""From raw documents to balanced shards: five stages over the corpus operators.

Each stage takes what its predecessor kept. All but the last return the columns
of ``documents``; ``run`` writes every stage's rows to the shared folder and
reads them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lodestone.llm import decontaminate, language_id, mixing, near_dup, sharding
from lodestone.llm.common import id_crc, stage, table

#: A document whose best language holds less than this share of its letters' trigrams is in none.
LEAST_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, with all their columns.

    Null and empty texts, texts without a letter, and texts with too few of any
    learned language's trigrams go. Languages are learned from the stage's own
    rows that have a ``lang``; without such a row every document goes. Rows that
    repeat an id are judged one by one.
    """
    model = language_id.train(docs.where(id_crc() % 3 != 1))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    judged = language_id.identify(plain, model, text=f"c{names.index('text')}", keep=plain.columns)
    kept = judged.where((F.col("lang_pred") != language_id.UNDECIDED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*plain.columns).toDF(*names)


def _text_key() -> Column:
    """The key by which near-dedup names a text."""
    return F.when(F.length("text") > 0, F.unhex(F.md5(F.col("text").cast("binary"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id.

    Rows with a null id stay. Rows of one id with several texts are judged each by
    its text; equal rows of one id and text are one. Null and empty texts are no
    copies of others.
    """
    kept = near_dup.near_duplicates(docs).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_kept")).agg(F.count(F.lit(1)).alias("_rows"))
    kept = stage(kept, "kept")
    mine = docs.where("doc_id is not null").withColumn("_text", _text_key())
    one = mine.join(kept.drop("_rows").hint("merge"), (F.col("doc_id") == F.col("_id")) & F.col("_text").eqNullSafe(F.col("_kept")), "left_semi")
    if kept.where("_rows > 1").limit(1).count():
        one = one.dropDuplicates(["doc_id", "_text"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark passages make up less than a twentieth of the words.

    Every row is judged by its own text, whatever its id; null and empty texts stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows that share an id are told apart by source and size; if these are equal
    too, the mix's words are the same whichever of them it takes. Documents
    without a word add none to it; they stay where their source is taken whole.
    """
    place = W.partitionBy("_id")
    taken = mixing.mix(docs).select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"), "source", "size")
    taken = stage(taken.withColumn("_place", F.row_number().over(place.orderBy("source", "size", "_copies"))).select("_id", "_place", "_copies"), "taken")
    mine, same = docs, F.col("doc_id").eqNullSafe(F.col("_id"))
    if taken.where("_place > 1").limit(1).count():
        # Only rows that share an id need their size here.
        size = F.when(F.count(F.lit(1)).over(W.partitionBy("doc_id")) > 1, mixing.size_of("text"))
        mine = docs.withColumn("_size", size).withColumn("_row", F.row_number().over(W.partitionBy("doc_id").orderBy("source", "_size")))
        same = same & (F.col("_row") == F.col("_place"))
    rows = mine.join(taken.where("_copies > 0").hint("merge"), same)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; copies of a document share a shard."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Mixing fits budgets by dynamic programming, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
