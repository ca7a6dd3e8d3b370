"""Tables that change together, and output batches that count once.

What is new is written to a folder of its own; then one small file, renamed into place, makes it valid. A crash before
the rename leaves what was valid before, and a batch that comes again finds its file and adds nothing. Everything goes
through the store's own interface, so any store that Spark writes to will do whose rename is atomic and does not
replace a file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

KEPT = 2  # versions of the tables: the valid one, and the one that readers may still hold


class Store:
    """Files of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        """In order."""
        return sorted(x.getPath().getName() for x in self._files.listStatus(self.at(folder))) if self._files.exists(self.at(folder)) else []

    def read(self, name: str) -> dict:
        stream = self._files.open(self.at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_once(self, name: str, content: dict) -> bool:
        """Puts a file in place as a whole; False if there was one."""
        if self._files.exists(self.at(name)):
            return False
        draft = f"_drafts/{uuid.uuid4().hex}"
        stream = self._files.create(self.at(draft))
        try:
            stream.write(json.dumps(content).encode())
        finally:
            stream.close()
        self._files.mkdirs(self.at(name).getParent())
        try:
            done = self._files.rename(self.at(draft), self.at(name))
        except Exception:  # some stores raise where others return False; the caller is told either way
            done = False
        if not done:
            self._files.delete(self.at(draft), False)
        return done

    def delete(self, name: str) -> None:
        self._files.delete(self.at(name), True)


def _newest(store: Store) -> tuple[int, dict]:
    names = store.names("_commits")
    return (int(names[-1].split(".")[0]), store.read(f"_commits/{names[-1]}")) if names else (0, {"batch": None, "tables": {}})


def last_batch(spark: SparkSession, path: str) -> int | None:
    """The batch of the valid version."""
    return _newest(Store(spark, path))[1]["batch"]


def load(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of the valid version; empty with that schema where there is none."""
    folder = _newest(Store(spark, path))[1]["tables"].get(table)
    return spark.read.schema(schema).parquet(f"{path}/{folder}") if folder else spark.createDataFrame([], schema)


def count(spark: SparkSession, path: str, table: str) -> int:
    """Rows of a table of the valid version."""
    folder = _newest(Store(spark, path))[1]["tables"].get(table)
    return spark.read.parquet(f"{path}/{folder}").count() if folder else 0


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame | None], batch: int | None = None) -> None:
    """A new version of the tables, all at once: those given are replaced (None: forgotten), others stay. Older versions go.

    Another writer's commit in the meantime is an error, as this one rests on what was valid before it.
    """
    store = Store(spark, path)
    number, valid = _newest(store)
    now = dict(valid["tables"])
    for name, df in tables.items():
        now.pop(name, None)
        if df is not None:
            now[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{path}/{now[name]}")
    if not store.write_once(f"_commits/{number + 1:020d}.json", {"batch": batch if batch is not None else valid["batch"], "tables": now}):
        raise RuntimeError(f"version {number + 1} of {path} was written by another")
    names = store.names("_commits")
    held = {f for n in names[-KEPT:] for f in store.read(f"_commits/{n}")["tables"].values()}
    for n in names[:-KEPT]:
        store.delete(f"_commits/{n}")
    for name in {*now, *valid["tables"]}:
        for folder in store.names(name):
            if f"{name}/{folder}" not in held:
                store.delete(f"{name}/{folder}")


def add_batch(df: DataFrame, path: str, batch: int, *partition_by: str) -> bool:
    """Output of a numbered batch; False, and nothing added, where the batch is there already."""
    store = Store(df.sparkSession, path)
    name, folder = f"_batches/{batch:020d}.json", f"data/added={uuid.uuid4().hex}"
    if name.split("/")[1] in store.names("_batches"):
        return False
    df.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    if store.write_once(name, {"folder": folder}):
        return True
    store.delete(folder)
    return False


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that count."""
    store = Store(spark, path)
    folders = [f"{path}/{store.read(f'_batches/{n}')['folder']}" for n in store.names("_batches")]
    none = spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(none.columns) if folders else none
