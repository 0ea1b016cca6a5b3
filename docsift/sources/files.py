"""Every ``*.txt`` file under a folder is one document.

The name is the file name without ``.txt``, first letter upper case and the
rest lower case (``portugal.txt`` -> ``Portugal``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TASKS_PER = 4


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """[path, name, text]: one row per file, the whole file as text."""
    # text()'s own wholetext argument overrides a reader option of that name.
    raw = (
        spark.read.option("pathGlobFilter", "*.txt")
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
    )
    # Spark plans a few files a task, as opening one counts as megabytes: for small files that is a
    # task for every few kilobytes, so tasks that open many are made of them.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = F.col("_metadata.file_path")
    base = F.regexp_extract(p, r"([^/]+)\.txt$", 1)
    name = F.concat(F.upper(F.substring(base, 1, 1)), F.lower(F.substring(base, 2, 1 << 30)))
    return raw.select(p.alias("path"), name.alias("name"), F.col("value").alias("text")).coalesce(TASKS_PER * tasks)


def write_text_files(df: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """Write each row as ``<path>/<name>.txt`` from the executors (a fixture writer for
    S1). A path without a scheme is on the cluster's default file system, as for Spark."""
    import pandas as pd

    from docsift.session import ship_package

    ship_package(df.sparkSession)
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    if out.startswith("file:/") and not out.startswith("file://"):
        out = "file://" + out[5:]

    def write(batches):
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(out)
        filesystem.create_dir(root, recursive=True)
        n = 0
        for pdf in batches:
            for nm, tx in zip(pdf[name], pdf[text]):
                with filesystem.open_output_stream(f"{root}/{nm}.txt") as f:
                    f.write(tx.encode("utf-8"))
                n += 1
        yield pd.DataFrame({"written": [n]})

    df.select(name, text).mapInPandas(write, "written long").agg(F.sum("written")).collect()
