"""Arrow batches of a bounded size for Python functions on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most BATCH_ROWS rows.

    Texts are long: Spark's default of 10,000 rows is tens of MB in the JVM and again in each worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(key)) > BATCH_ROWS or int(conf.get(key)) <= 0:
        conf.set(key, str(BATCH_ROWS))
    return df
