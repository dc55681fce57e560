"""Snapshot tables: atomic rewrite, partial upsert, append, and a memo of runs.

A table is a folder of immutable snapshots and a pointer file that names the
current one. A writer stores a new snapshot, then moves the pointer; readers
never see half a table. One writer a table at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators.evidence import last_update, partial_upsert


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str | None:
        p = self._Path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        """Write beside, then rename over."""
        temporary = self._Path(f"{path}.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._Path(path)
        if self._fs.exists(target):
            self._fs.delete(target, False)
        self._fs.rename(temporary, target)

    def manifest(self, table: str) -> dict | None:
        text = self._text(f"{self.root}/{table}/manifest.json")
        return json.loads(text) if text else None

    def fingerprint(self, table: str) -> str:
        """Changes whenever the table's snapshot does; empty for a table that isn't there."""
        m = self.manifest(table)
        return m["snapshot"] if m else ""

    def read(self, table: str) -> DataFrame:
        from pyspark.sql.types import StructType

        m = self.manifest(table)
        if m is None:
            raise FileNotFoundError(table)
        return self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(*[f"{self.root}/{table}/{s}" for s in m["parts"]])

    def _publish(self, table: str, parts: list[str], df: DataFrame) -> None:
        self._write(f"{self.root}/{table}/manifest.json", json.dumps({"snapshot": uuid.uuid4().hex, "parts": parts, "schema": df.schema.jsonValue()}))

    def overwrite(self, table: str, df: DataFrame) -> None:
        part = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{table}/{part}")
        self._publish(table, [part], df)

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows; nothing already there is rewritten."""
        m = self.manifest(table)
        part = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{table}/{part}")
        self._publish(table, [*(m["parts"] if m else []), part], df)

    def upsert(self, table: str, updates: DataFrame, keys: list[str], supplied: list[str], sequence: str | None = None) -> None:
        """Overwrite the supplied columns of rows with these keys, add the others; of several updates the last by ``sequence``."""
        u = last_update(updates, keys, sequence) if sequence else updates
        if self.manifest(table) is None:
            self.overwrite(table, u.select(*keys, *supplied))
        else:
            self.overwrite(table, partial_upsert(self.read(table), u, keys, supplied))

    def insert_missing(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Add rows whose keys aren't there yet."""
        fresh = rows.dropDuplicates(keys)
        self.append(table, fresh.join(self.read(table).select(*keys), keys, "left_anti") if self.manifest(table) else fresh)


class RunMemo:
    """Skips a stage whose inputs have succeeded before. Failures are not remembered."""

    def __init__(self, store: SnapshotStore):
        self.store = store

    def key(self, stage: str, inputs: dict, tables: list[str]) -> str:
        facts = {"stage": stage, "inputs": inputs, "tables": {t: self.store.fingerprint(t) for t in sorted(tables)}}
        return hashlib.sha256(json.dumps(facts, sort_keys=True, default=str).encode()).hexdigest()

    def run(self, stage: str, inputs: dict, tables: list[str], action, force: bool = False):
        """Call ``action`` unless memoised; (ran, result)."""
        path = f"{self.store.root}/_runs/{self.key(stage, inputs, tables)}.json"
        done = self.store._text(path)
        if done is not None and not force:
            return False, json.loads(done)["result"]
        result = action()
        self.store._write(path, json.dumps({"stage": stage, "result": result}))
        return True, result


def replay_key(prompt, prefix, purpose, resumed):
    """The first 16 hex digits of the SHA-256 of a request, as a column."""
    from pyspark.sql import functions as F

    return F.substring(F.sha2(F.to_json(F.struct(prompt.alias("prompt"), prefix.alias("prefix"), purpose.alias("purpose"), resumed.alias("resumed"))), 256), 1, 16)
