"""Session helpers: reading tables, cutting lineage, choosing a join side by measured size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the cluster's shared one where it is named, else (tests, one machine) an own one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="terralith-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, iterated: bool = False) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder: later stages read files that outlive any executor.

    A checkpoint keeps what the optimiser knew about its columns. In a loop (`iterated`) that knowledge doubles with every
    round until planning takes longer than running, so it is not gathered there.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = "spark.sql.constraintPropagation.enabled"
    if not iterated or spark.conf.get(name) == "false":
        return df.checkpoint(eager=True)
    spark.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.unset(name)


def _file(spark: SparkSession, path: str):
    """File system and path object of a path on whatever store it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _file(spark, path)
    return store.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file (statistics, a mark), overwritten if it is there."""
    store, where = _file(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one row


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether `df` has at most `most_rows` rows; counts no further than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """`df` with a broadcast hint if a count shows that it is small enough, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if small(df, most_rows) else df


def id_key(column):
    """Ids compare without regard to letter case and surrounding white space."""
    return F.lower(F.trim(column, F.lit(" \t\n\r\x0b\f")))


def name_key(column):
    """Spelling-independent key of a category, source or author: letters and digits only, lower case, null where none are left."""
    key = F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "")
    return F.when(key != "", key)
