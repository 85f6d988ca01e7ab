"""What every Spark job here needs: the shared folder, lineage cuts, and the package on the executors."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset on one machine, as in tests, a
    temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.getCheckpointDir() is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder; the result survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    top = Path(__file__).resolve().parent
    with zipfile.ZipFile(to := Path(tempfile.mkdtemp(prefix="tessera-ship-")) / f"{top.name}.zip", "w") as z:
        for path in top.rglob("*.py"):
            z.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)
