"""Tables that are published together: readers see the last whole version, and a run that is killed goes on where it was.

A version is a manifest, a small file that names the folder of each table. It is written aside and renamed, which is one step, to the next number;
who reads opens the highest number. The tables of a run are written to folders of their own first, each with a row in the run's
progress, so that the next attempt skips what is whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

#: A table's rows, and what is to be reported of it.
Made = tuple[DataFrame, Mapping[str, int]]


class Store:
    """Versions of a set of tables in a folder that all executors share, by whatever file system Spark has for it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{folder}/versions"))

    def _write(self, path: str, text: str) -> None:
        """The whole file or none: it is renamed into its place."""
        aside = f"{path}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._fs.rename(self._path(aside), self._path(path)):
            self._fs.delete(self._path(aside), False)
            raise FileExistsError(path)

    def _read(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(path).collect())  # one small file

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(folder))]

    def version(self) -> int:
        """The last version, 0 if nothing is published."""
        return max((int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/versions") if n.endswith(".json")), default=0)

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, all of the same one; of the last if none is named."""
        version = version or self.version()
        if not version:
            return {}
        return {n: self.spark.read.parquet(p) for n, p in json.loads(self._read(f"{self.folder}/versions/{version}.json")).items()}

    def progress(self, run: str) -> dict[str, dict]:
        """What a run has whole: {table: {path, counts}}."""
        folder = f"{self.folder}/runs/{run}"
        return {n.removesuffix(".json"): json.loads(self._read(f"{folder}/{n}")) for n in self._names(folder) if n.endswith(".json")}

    def keep(self, run: str, table: str, df: DataFrame, counts: Mapping[str, int]) -> dict:
        """Writes a table of a run, and then that it is whole. A folder left by an attempt that was killed is not used."""
        path = f"{self.folder}/data/{table}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        told = {"path": path, "counts": dict(counts)}
        self._write(f"{self.folder}/runs/{run}/{table}.json", json.dumps(told))
        return told

    def names(self) -> list[str]:
        """The tables of the last version."""
        last = self.version()
        return sorted(json.loads(self._read(f"{self.folder}/versions/{last}.json"))) if last else []

    def publish(self, run: str, drop: Iterable[str] = ()) -> int:
        """The run's tables, and those of the last version that it does not have, less those to drop, as the next version. Of two that publish at once one fails."""
        last, gone = self.version(), set(drop)
        held = json.loads(self._read(f"{self.folder}/versions/{last}.json")) if last else {}
        held = {t: p for t, p in held.items() if t not in gone}
        held |= {t: x["path"] for t, x in self.progress(run).items()}
        self._write(f"{self.folder}/versions/{last + 1}.json", json.dumps(held, sort_keys=True))
        return last + 1


def run_tables(store: Store, run: str, tables: Mapping[str, Callable[[], Made]], go_on: Callable[[], bool] = lambda: True) -> dict[str, tuple[str, dict[str, int]]]:
    """Makes the tables of a run in order, publishes them once all are whole, and tells of each (state, counts).

    `done before` is what an earlier attempt at the run left whole, `left` what go_on, which is asked before each table, gave no time for;
    nothing is published then, and a later attempt goes on.
    """
    known, out, stopped = store.progress(run), {}, False
    for name, make in tables.items():
        if name in known:
            out[name] = "done before", known[name]["counts"]
            continue
        stopped = stopped or not go_on()
        if stopped:
            out[name] = "left", {}
            continue
        out[name] = "done", store.keep(run, name, *make())["counts"]
    if not stopped:
        store.publish(run)
    return out
