"""A store on disk that is changed in place: rows are added, and touched buckets replaced, one switch at a time.

Rows lie in folders of one change each, ``data/<change>/<table>/bucket=<n>``, and are never overwritten. Which
folders make up the store is told by a list; the newest list counts. A change writes its rows first and its
list last, under a name of its own that is then moved to the next number. So readers see a change as a whole or
not at all, a change that breaks off leaves the store as it was, and of two changes at once the later one fails.

An import adds folders and rewrites nothing. A deletion rewrites the buckets of the candidates that it removes;
candidates and their rows are in the bucket of the candidate's id. ``compact`` gathers each bucket in one folder.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.operators.store import TABLES_COLUMNS, TalentStore, additions, delete_candidates
from vitaeflow.schema import TABLES

BUCKETS = 64
#: The column whose remainder is the bucket.
OWNERS = {t: "candidate_id" if "candidate_id" in columns else "id" for t, columns in TABLES_COLUMNS.items()}


class Conflict(RuntimeError):
    """Another change was made in the meantime."""


@dataclass(frozen=True)
class StoreFolder:
    spark: SparkSession
    path: str

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _lists(self) -> list[int]:
        path, files = self._at("lists")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(path) if f.getPath().getName().isdigit()) if files.exists(path) else []

    def current(self) -> tuple[int, dict[str, dict[str, list[str]]]]:
        """The number of the newest list, and the folders of each table and bucket."""
        numbers = self._lists()
        if not numbers:
            return 0, {t: {} for t in TABLES}
        return numbers[-1], json.loads(self.spark.read.text(f"{self.path}/lists/{numbers[-1]}", wholetext=True).first()[0])

    def _table(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> TalentStore:
        _, tables = self.current()
        return TalentStore(**{t: self._table(t, sorted({f for own in tables[t].values() for f in own})) for t in TABLES})

    def _write(self, change: str, name: str, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows by bucket; the folders by bucket."""
        target = f"data/{change}/{name}"
        bucket = F.pmod(F.col(OWNERS[name]), F.lit(BUCKETS)).cast("int")
        rows.select(*TABLES_COLUMNS[name]).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{target}")
        path, files = self._at(target)
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return {n.removeprefix("bucket="): [f"{target}/{n}"] for n in names if n.startswith("bucket=")}

    def _switch(self, number: int, tables: dict) -> None:
        """Make ``tables`` the list after ``number``."""
        own = f"lists/new-{uuid.uuid4().hex}"
        path, files = self._at(own)
        out = files.create(path, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        target, _ = self._at(f"lists/{number + 1}")
        if files.exists(target) or not files.rename(path, target):
            files.delete(path, False)
            raise Conflict(f"list {number + 1} was written by another change")

    def add(self, extractions: DataFrame, source_file: str = "doc_key", refuse_known: bool = False) -> int:
        """Import all documents; how many candidates were added. ``refuse_known`` leaves out documents whose
        source is in the store."""
        number, tables = self.current()
        store = self.read()
        if refuse_known:
            known = store.candidates.select(F.col("source_file").alias("_known")).distinct()
            extractions = extractions.join(known, F.col(source_file) == F.col("_known"), "left_anti")
        change = uuid.uuid4().hex
        for name, rows in additions(extractions, store, source_file).items():
            for bucket, folders in self._write(change, name, rows).items():
                tables[name].setdefault(bucket, []).extend(folders)
        self._switch(number, tables)
        written = self._table("candidates", [f for own in tables["candidates"].values() for f in own if f.startswith(f"data/{change}/")])
        return written.count()

    def delete(self, ids: DataFrame) -> int:
        """Remove the candidates of (id) and their rows; how many there were. Only their buckets are rewritten."""
        number, tables = self.current()
        found = self.read().candidates.join(ids.select("id").distinct(), "id", "left_semi").select("id")
        touched = [str(r[0]) for r in found.select(F.pmod("id", F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # at most BUCKETS
        if not touched:
            return 0
        removed = found.count()
        part = TalentStore(**{t: self._table(t, [f for b in touched for f in tables[t].get(b, ())] if t != "skills" else []) for t in TABLES})
        left, change = delete_candidates(part, found), uuid.uuid4().hex
        for name in TABLES:
            if name != "skills":
                fresh = self._write(change, name, getattr(left, name))
                for bucket in touched:
                    tables[name].pop(bucket, None)
                tables[name] |= fresh
        self._switch(number, tables)
        return removed

    def compact(self) -> None:
        """Rewrite the buckets that lie in several folders."""
        number, tables = self.current()
        change = uuid.uuid4().hex
        for name, own in tables.items():
            many = {b: folders for b, folders in own.items() if len(folders) > 1}
            if many:
                own |= self._write(change, name, self._table(name, [f for folders in many.values() for f in folders]))
        self._switch(number, tables)
