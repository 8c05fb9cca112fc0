"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words as long: pieces between separators, less the empty ones at the ends."""
    t = F.coalesce(text, F.lit(""))
    ends = t.rlike(f"^{SPACE}").cast("int") + t.rlike(f"{SPACE}$").cast("int")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE)) - ends).cast("long")


def checkpointed(df: DataFrame, rows_each: int | None = None) -> DataFrame:
    """``df`` written to the reliable checkpoint folder and read from it from now on.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only in local mode (tests on one machine), where that is
    unset, a temporary folder is made. With ``rows_each``, partitions are put together
    (not shuffled) until they hold about so many rows: a small table in hundreds of partitions costs hundreds of
    near-empty files in every shuffle that follows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out if rows_each is None else out.coalesce(max(1, -(-out.count() // rows_each)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def released(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of steps whose results are written and to which nothing refers any more. It does so by itself when the driver collects garbage,
    which on a driver with little to do may be after the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
