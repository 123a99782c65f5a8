"""What the operators share: reading tables, and tables written between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run without blanks or \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between words.
BLANKS = " \t\n\x0b\x0c\r"
#: Spark's setting to remove a query's shuffle files as it ends, and not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words_of(text: Column) -> Column:
    """The words of a text that is not null, as an array."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tallyfold-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def stash(df: DataFrame, tag: str, *by: str, codec: str = "snappy") -> DataFrame:
    """Writes a frame to the shared folder, in folders by the columns ``by`` if any, and reads it again.

    This cuts the lineage at a copy that no lost executor takes along, and lets
    the optimizer see the true size, so that it broadcasts only what is small.
    The folder is the cluster's scratch space; each call takes a new subfolder.
    What was shuffled to make the copy goes with the write, as it would lie on disk beside the copy.
    """
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/tallyfold/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).option("compression", codec).parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stashed: DataFrame) -> None:
    """Deletes the files of stashed frames that no frame still to be computed reads."""
    for df in stashed:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def set_aside(docs: DataFrame, *needed: str) -> DataFrame:
    """All columns under names of their own, and those that the work needs once more, so that no name clashes with a computed one."""
    return docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns], *needed)


def restored(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` as they were set aside, but for those that are changed."""
    return rows.select(*[changed.get(c, F.col(f"_in_{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def only(df: DataFrame, verdict: str) -> DataFrame:
    """The rows whose column ``verdict`` is true, decided after it is computed.

    A plain filter would be pushed down with all that the verdict is made of, and
    then work out arrays again for each of their elements.
    """
    return df.withColumn("_at", F.monotonically_increasing_id()).where(F.col(verdict) & (F.col("_at") >= 0)).drop("_at")


def batched(spark: SparkSession) -> None:
    """Keeps the Arrow batches that go to Python small, also for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), the component being its smallest node.

    Each round takes the least label among the neighbours and then the label of
    the label, so that rounds grow with the logarithm of a component's width.
    All steps are aggregates by minimum and joins with one row per node, so a
    node with very many neighbours is combined before the shuffle.
    """
    both = stash(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .where("u != v")
        .distinct(),
        "edges",
    )
    labels = stash(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        far = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = stash(step.join(far, "mid").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("moved")), "labels")
        labels = step.select("node", "label")
        if not step.where("moved").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
