"""Text sources and sinks: single texts, folders of text files, committed excerpts, and files written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.functions.text import trim_blank

DOC_SCHEMA = "doc string, text string"
#: Bytes of a row group, about; readers do not split one.
ROW_GROUP = 128 << 20


def single_text(spark: SparkSession, text: str | None, name: str = "text") -> DataFrame:
    """(doc, text) of a pasted or selected text, trimmed; no row where it is blank."""
    return spark.createDataFrame([(name, text)], DOC_SCHEMA).select("doc", trim_blank(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")


def text_folder(spark: SparkSession, folder: str, prefix: str = "local:") -> DataFrame:
    """(doc, text) of the .txt files of a folder, named by their files and in the order of these; no rows where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], DOC_SCHEMA)
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_name")).orderBy("file")
    return files.select(F.concat(F.lit(prefix), F.regexp_replace("file", r"\.txt\z", "")).alias("doc"), F.col("value").alias("text"))


def corpus(spark: SparkSession, excerpts: list[tuple[str, str]], folder: str | None = None) -> DataFrame:
    """(doc, text) of committed excerpts and, if there is one, a folder of full texts."""
    named = spark.createDataFrame([(f"excerpt:{n}", t) for n, t in excerpts], DOC_SCHEMA)
    return named.unionByName(text_folder(spark, folder)) if folder else named


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, where its files cannot be: a small file is one row group, and so one task's work.

    A shuffle is paid only for what fills fewer row groups than there are cores.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * ROW_GROUP or len(df.inputFiles()) + size // ROW_GROUP >= cores:
        return df
    return df.repartition(cores)


def write_texts(df: DataFrame, path: str, name: str = "doc", text: str = "text") -> None:
    """A file <name>.txt for each name with its text, ending in a line feed; texts of one name follow each other in its file.

    Tasks write a folder for each name; the driver then only renames files.
    """
    spark = df.sparkSession
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).repartition("name").write.partitionBy("name").option("lineSep", "\n").text(path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(Path(path)):
        if folder.isDirectory() and folder.getPath().getName().startswith("name="):
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), Path(path, folder.getPath().getName()[len("name="):] + ".txt"))
            fs.delete(folder.getPath(), True)
