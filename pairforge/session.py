"""Session settings that hold at any scale; sizes that depend on a cluster stay with the cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, name: str = "pairforge", **settings: str) -> SparkSession:
    """The active session or a new one; ``settings`` use ``__`` for dots."""
    build = SparkSession.builder.appName(name)
    if master:
        build = build.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        build = build.config(key, value)
    return ship(build.getOrCreate())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application, so that their Python finds it wherever they
    run and whatever the driver's working folder is."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="pairforge-code-")) / "pairforge.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread over all cores before costly functions: small tables would otherwise be merged into one
    partition. The number follows the session's settings, which grow with the data."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
