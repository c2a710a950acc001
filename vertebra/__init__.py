"""Vertebra: a property-graph analytics library for Spark, with operators for large text corpora in vertebra.llm."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's source to the executors, once per Spark application.

    Texts may be long, so Arrow batches are bounded to 1 MB in sessions that leave that setting at its default of 64 MB.
    """
    if spark.conf.get(_BATCH_BYTES, None) == "67108864b":
        spark.conf.set(_BATCH_BYTES, "1m")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp()) / "vertebra.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark
