"""Dead letters that are sent again: a folder of letters, a ledger of what was delivered, tries with growing delays.

    {path}/letters/...    rows that a sink didn't take, with letter_id and attempts
    {path}/ledger/...     letter_ids that it took
    {path}/position       where the stream over the letters stands

flush() reads what letters have come since the last flush (an available-now stream), leaves out what the ledger holds
and letters that occur twice, and sends the rest. A batch that fails is tried again after 1, 2, 4 seconds and so on;
what is still refused goes back among the letters with one more attempt, for a later flush. Files are named after the
batch that writes them, so a batch that is run again after a failure replaces its own. A letter whose delivery was
not yet in the ledger when the job died is sent once more; the letter_id lets the receiver tell.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

DELAYS = (1, 2, 4)
Send = Callable[[DataFrame], "DataFrame | None"]
"""A sink: takes rows, raises if it took none of them, or returns the letter_ids it refused."""


def letter_schema(rows: StructType) -> StructType:
    return StructType([StructField("letter_id", StringType()), StructField("attempts", LongType()), *rows.fields])


def post(rows: DataFrame, path: str, name: str) -> None:
    """Rows become letters; equal rows are one letter. `name` says which batch writes them."""
    letter = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}), 256)
    rows.withColumn("letter_id", letter).withColumn("attempts", F.lit(0).cast("long")).select("letter_id", "attempts", *(F.col(f"`{c}`") for c in rows.columns)).write.mode("overwrite").parquet(f"{path}/letters/{name}")


def deliver(send: Send, rows: DataFrame, delays: tuple[int, ...] = DELAYS, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame | None, str | None]:
    """Sends until all is taken or the delays are used up: the letter_ids still refused (None: none), and the last error.
    Only what was refused is sent again."""
    refused: DataFrame | None = None
    error = None
    for k in range(len(delays) + 1):
        try:
            refused, error = send(rows if refused is None else rows.join(refused, "letter_id", "left_semi")), None
        except Exception as e:  # whatever the outside sink raises: it took nothing
            refused, error = refused if refused is not None else rows.select("letter_id"), str(e)
        if refused is None or refused.isEmpty():
            return None, None
        if k < len(delays):
            sleep(delays[k])
    return refused, error


def flush(spark: SparkSession, path: str, rows: StructType, send: Send, delays: tuple[int, ...] = DELAYS, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """Sends the letters that have come in since the last flush; counts of letters delivered and refused."""
    counts = {"delivered": 0, "refused": 0}

    def run(batch: DataFrame, number: int) -> None:
        own = batch.groupBy("letter_id").agg(F.max(F.struct("attempts", *(F.col(f"`{f.name}`") for f in rows.fields))).alias("x")).select("letter_id", "x.*")
        ledger = known(batch.sparkSession, path, number)
        kept = own.join(ledger, "letter_id", "left_anti").persist()
        try:
            if kept.isEmpty():
                return
            refused, _ = deliver(send, kept, delays, sleep)
            taken = kept if refused is None else kept.join(refused, "letter_id", "left_anti")
            taken.select("letter_id").write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")
            counts["delivered"] += taken.count()
            if refused is not None:
                again = kept.join(refused, "letter_id", "left_semi").withColumn("attempts", F.col("attempts") + 1)
                again.select("letter_id", "attempts", *(F.col(f"`{f.name}`") for f in rows.fields)).write.mode("overwrite").parquet(f"{path}/letters/again-{number}")
                counts["refused"] += again.count()
        finally:
            kept.unpersist()

    letters = spark.readStream.schema(letter_schema(rows)).option("recursiveFileLookup", "true").parquet(f"{path}/letters")
    query = letters.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/position").trigger(availableNow=True).start()
    query.awaitTermination()
    return counts


def known(spark: SparkSession, path: str, number: int) -> DataFrame:
    """letter_ids that batches before this one delivered."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "letter_id string")
    return spark.read.schema("letter_id string, batch long").parquet(f"{path}/ledger").where(F.col("batch") < number).select("letter_id").distinct()
