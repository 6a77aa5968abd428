"""Session factory for local runs and tests; on a cluster the caller brings its own session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "reelframe", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session in UTC with adaptive execution on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("REELFRAME_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key to all cores, for small rows that are made into large ones: a table of one row group is one task."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def package_zip(folder: str) -> str:
    """The library as one zip in a folder, for --py-files or ship()."""
    root = Path(__file__).resolve().parent
    path = str(Path(folder) / "reelframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    return path


def ship(spark: SparkSession) -> None:
    """Hands the library to the Python workers of a session whose executors do not have it installed."""
    spark.sparkContext.addPyFile(package_zip(tempfile.mkdtemp(prefix="reelframe-zip-")))
