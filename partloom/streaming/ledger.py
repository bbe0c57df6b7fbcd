"""The stock ledger as a stream: each batch of line changes is folded into a table of movements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from partloom.operators.dml import ledger
from partloom.operators.publish import Store

#: So many batches stand beside the base before they are folded into it.
COMPACT_EVERY = 4


def fold(changes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write the movements of a stream of changes to a Parquet folder, a subfolder for each batch.

    A batch that is run again after a failure replaces its own subfolder, so that it counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        ledger(batch).groupBy("part_id").sum("delta").toDF("part_id", "delta").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _summed(frames: list[DataFrame]) -> DataFrame:
    """(part_id, delta) of several tables of movements."""
    return reduce(DataFrame.unionByName, frames).groupBy("part_id").agg(F.sum("delta").alias("delta"))


def through(names: list[str]) -> int:
    """The last batch that the tables hold, -1 if none."""
    return max((int(n.rpartition("-")[2]) for n in names), default=-1)


def apply_batch(store: Store, changes: DataFrame, number: int, every: int = COMPACT_EVERY) -> None:
    """Adds the movements of a batch to the store as its next version. A batch that is in it already, run again after a failure, changes nothing.

    Each batch is a small table of sums; every so many are folded into one base with those before, which then replaces them.
    """
    names = store.names()
    if number <= through(names):
        return
    run, compact = f"batch-{number}", sum(n.startswith("delta-") for n in names) + 1 >= every
    table = f"{'base' if compact else 'delta'}-{number:09d}"
    if table not in store.progress(run):
        held = list(store.tables().values()) if compact else []
        store.keep(run, table, _summed([*held, ledger(changes)]), {"batch": number})
    store.publish(run, names if compact else ())


def fold_versions(changes: DataFrame, store: Store, checkpoint: str, every: int = COMPACT_EVERY) -> StreamingQuery:
    """Folds a stream of line changes into the store, a version for each batch, until what there is has been read."""
    write = lambda batch, number: apply_batch(store, batch, number, every)
    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def movements(store: Store) -> DataFrame:
    """(part_id, delta): what has left the stock by the last version."""
    return _summed(list(store.tables().values()))
