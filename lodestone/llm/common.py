"""Session helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, one is made up for a driver that runs all tasks
    itself (tests, a laptop). On a cluster executors could not read each other's
    files in such a folder, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, so a lost executor
    costs the tasks it ran and not the whole plan above them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the staged tables of a session; frames read from them end here."""
    jvm, kept = spark.sparkContext._jvm, []
    for owner, path in _STAGED:
        if owner is not spark:
            kept.append((owner, path))
            continue
        parent = jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
        parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)
    _STAGED[:] = kept


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _STAGED}.values():
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # noqa: BLE001  the session is gone already
            pass


def tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle whose work its bytes do not tell: the session's number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, bucket_rows: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0 by a seeded hash of ``order``.

    A group of any size is cut into buckets of about ``bucket_rows`` rows by
    that hash; only a bucket is sorted in one task, and a running sum over
    bucket counts gives each bucket its first number.
    """
    from pyspark.sql import Window as W

    key = F.xxhash64(F.lit(17), *order)
    share = (F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53)))
    base = df.withColumns({"_h": key, "_u": share})
    sizes = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"_g_{i}") for i, c in enumerate(group)], F.ceil(F.col("_n") / bucket_rows).cast("long").alias("_nb"))
    on = [F.col(c).eqNullSafe(F.col(f"_g_{i}")) for i, c in enumerate(group)]
    cut = base.join(sizes, on, "left").withColumn("_b", F.least(F.floor(F.col("_u") * F.col("_nb")), F.col("_nb") - 1))
    cut = cut.drop("_u", "_nb", *[f"_g_{i}" for i in range(len(group))])
    counts = cut.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(*[F.col(c).alias(f"_g_{i}") for i, c in enumerate(group)], F.col("_b").alias("_fb"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    on = [F.col(c).eqNullSafe(F.col(f"_g_{i}")) for i, c in enumerate(group)] + [F.col("_b") == F.col("_fb")]
    inner = W.partitionBy(*group, "_b").orderBy("_h", *order)
    numbered = cut.withColumn("_r", F.row_number().over(inner)).join(first, on, "left")
    return numbered.withColumn(out, (F.col("_first") + F.col("_r") - 1).cast("long")).drop("_h", "_b", "_r", "_fb", "_first", *[f"_g_{i}" for i in range(len(group))])
