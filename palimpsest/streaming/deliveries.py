"""Deliveries to outside systems from a stream: a ledger of attempts, so that nothing that was told is told again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds to wait after the first, second and third failure, and attempts at most (fixed values).
WAITS, MOST = (10, 30, 90), 3
LEDGER = "delivery_id long, payload string, attempt int, status string, http_status int, error string, at timestamp"
#: Sends one payload: its HTTP status, or an exception.
Send = Callable[[int, str], int]


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    """All attempts that are in the ledger; none before the first batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER + ", batch string")
    return spark.read.schema(LEDGER + ", batch string").parquet(path)


def last_attempts(ledger: DataFrame) -> DataFrame:
    """The latest attempt of each delivery."""
    last = F.max_by(F.struct("payload", "attempt", "status", "http_status", "error", "at"), "attempt").alias("l")
    return ledger.groupBy("delivery_id").agg(last).select("delivery_id", "l.*")


def due_retries(ledger: DataFrame, now: str, waits: tuple[int, ...] = WAITS, most: int = MOST) -> DataFrame:
    """(delivery_id, payload, attempt): deliveries whose last attempt failed, that have attempts left, and whose wait is over
    at ``now`` (a timestamp in words), with the number of the next attempt."""
    wait = F.element_at(F.array(*map(F.lit, waits)), F.least(F.col("attempt"), F.lit(len(waits))))
    due = F.timestamp_micros(F.unix_micros("at") + wait * 1_000_000) <= F.lit(now).cast("timestamp")
    return last_attempts(ledger).filter((F.col("status") == "failed") & (F.col("attempt") < most) & due).select("delivery_id", "payload", (F.col("attempt") + 1).alias("attempt"))


def deliverer(path: str, send: Send, clock: Callable[[], str]) -> Callable[[DataFrame, int | str], None]:
    """A function for ``foreachBatch`` that sends each delivery (delivery_id, payload) once and writes the attempt to the
    ledger at ``path``; ``due_retries`` may be handed to it too, under a batch name of their own.

    A batch that is in the ledger is not sent again when the stream replays it, and a delivery that an earlier batch has
    tried is only sent under a higher attempt.  A batch that fails before its attempts are written is sent again as a
    whole: at least once, as outside systems can't take part in the commit.  Each task sends its rows; what ``send``
    raises is a failed attempt, not a failed batch.
    """

    def attempts(batches: Iterator[pd.DataFrame], now: str) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                code, error = None, None
                try:
                    code = int(send(r.delivery_id, r.payload))
                except Exception as e:  # noqa: BLE001  whatever the other side does is an outcome
                    error = f"{type(e).__name__}: {e}"[:500]
                good = code is not None and 200 <= code < 300
                out.append((r.delivery_id, r.payload, r.attempt, "success" if good else "failed", code, error if code is None else None if good else f"HTTP {code}", pd.Timestamp(now)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])
            yield frame.astype({"http_status": "Int32"})

    def run(batch: DataFrame, name: int | str) -> None:
        spark = batch.sparkSession
        known = ledger_of(spark, path)
        if not known.filter(F.col("batch") == str(name)).isEmpty():
            return
        rows = batch.withColumn("attempt", F.lit(1)) if "attempt" not in batch.columns else batch
        rows = rows.select("delivery_id", "payload", F.col("attempt").cast("int").alias("attempt")).dropDuplicates(["delivery_id"])
        tried = known.groupBy("delivery_id").agg(F.max("attempt").alias("tried"))
        rows = rows.join(tried, "delivery_id", "left").filter("tried is null or attempt > tried").select("delivery_id", "payload", "attempt")
        now = clock()
        rows.mapInPandas(lambda batches: attempts(batches, now), LEDGER).write.mode("overwrite").parquet(f"{path}/batch={name}")

    return run
