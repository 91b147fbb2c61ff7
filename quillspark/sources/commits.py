"""Numbered commits in a shared folder: tables that several writers extend and readers see whole or not at all.

A commit is one small JSON file, ``<root>/_commits/<number>.json``.  Its number is
taken by creating the file under a name that must not exist yet, so of two
writers that want the same number one gets it and the other learns of it.  Data
are written to folders of their own before; a folder that no commit names, as of
a writer that died in between, is never read.

On a local file system the file is made complete elsewhere and then linked to
its name; on others it is renamed, which HDFS refuses if the name is taken.  Stores
without such a rename (plain object stores) need one writer at a time.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Commits:
    """The commits below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._folder = f"{self.root}/_commits"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self._folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _local(self, path: str) -> str | None:
        """The path on this machine, if the store is its file system."""
        whole = self._store.makeQualified(self._path(path)).toUri()
        return whole.getPath() if whole.getScheme() == "file" else None

    def _write(self, path: str, text: str) -> None:
        out = self._store.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _publish(self, temporary: str, final: str) -> bool:
        """Give the file its name unless that is taken."""
        a, b = self._local(temporary), self._local(final)
        if a is None or b is None:
            return not self._store.exists(self._path(final)) and self._store.rename(self._path(temporary), self._path(final))
        try:
            os.link(a, b)
        except FileExistsError:
            return False
        return True

    def take(self, number: int, body: dict[str, Any]) -> bool:
        """Make the commit ``number`` with ``body``; False if another writer has it."""
        final = f"{self._folder}/{number:012d}.json"
        temporary = f"{self._folder}/.{uuid.uuid4().hex}"
        self._write(temporary, json.dumps(body, ensure_ascii=False))
        try:
            return self._publish(temporary, final)
        finally:
            self._store.delete(self._path(temporary), False)

    def numbers(self) -> list[int]:
        if not self._store.exists(self._path(self._folder)):
            return []
        names = (s.getPath().getName() for s in self._store.listStatus(self._path(self._folder)))
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def read(self, number: int) -> dict[str, Any]:
        raw = self.spark.read.text(f"{self._folder}/{number:012d}.json", wholetext=True).first()[0]
        return json.loads(raw)

    def all(self) -> list[dict[str, Any]]:
        """All commits in order."""
        numbers = self.numbers()
        if not numbers:
            return []
        rows = self.spark.read.text([f"{self._folder}/{n:012d}.json" for n in numbers], wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()
        return [json.loads(r.value) for r in sorted(rows, key=lambda r: r.name)]

    def latest(self) -> tuple[int, dict[str, Any] | None]:
        """The last number (0: none) and its commit."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)


class SharedLog:
    """An append-only table of rows told apart by ``key``, for any number of writers.

    Each append is a folder of Parquet files and a commit that names it.  A writer
    that loses the race for a number looks at what the winner has added, drops
    those rows and tries the next number, so each key is in the log once.  A
    batch id makes an append idempotent: the second one with the same id changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, key: list[str]):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.commits = Commits(spark, root)

    def _rows(self, bodies: list[dict[str, Any]]) -> DataFrame:
        folders = [f"{self.root}/{b['folder']}" for b in bodies]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All committed rows."""
        return self._rows(self.commits.all())

    def append(self, rows: DataFrame, batch: str | None = None, before_commit: Callable[[], None] | None = None) -> int | None:
        """Append what the log doesn't have yet; the number of the commit, or None if the batch is already there.

        ``before_commit`` runs between writing and committing, for tests.
        """
        rows, seen = rows.dropDuplicates(self.key), 0
        while True:
            numbers = self.commits.numbers()
            new = [self.commits.read(n) for n in numbers if n > seen]
            if batch is not None and any(b["batch"] == batch for b in new):
                return None
            if new:
                rows = rows.join(self._rows(new).select(*self.key), self.key, "left_anti")
            seen = numbers[-1] if numbers else 0
            folder = f"batch-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folder}")
            if before_commit is not None:
                before_commit()
            if self.commits.take(seen + 1, {"folder": folder, "batch": batch}):
                return seen + 1

    def sink(self, name: str) -> Callable[[DataFrame, int], None]:
        """A handler for ``foreachBatch``; a batch that is repeated after a failure changes nothing."""

        def handle(batch: DataFrame, number: int) -> None:
            self.append(batch, f"{name}-{number}")

        return handle
