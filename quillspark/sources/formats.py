"""Formats for ``spark.read`` and ``spark.readStream``: trees of HTML files, and JSON lines that are still being appended to.

``register(spark)`` makes them known.

* ``html_tree``: (path, raw, doc_ord) of all ``*.html`` below ``path``.  Documents are
  numbered in order of path, those of the folder named by ``first`` before the others;
  the number doesn't depend on filters.  Files are dealt to partitions by bytes, and
  filters on ``path`` (equal, in, starts with) are applied to the listing, so other files aren't opened.
  Bytes that aren't UTF-8 become U+FFFD, unreadable files are skipped; an empty file is a row.
* ``json_log``: the lines of ``*.json`` and ``*.jsonl`` files below ``path`` as the schema has them, and in ``bad`` (if
  the schema has it) a line that isn't a JSON object; without that column such lines are skipped.
  A file is cut by bytes: a line belongs to the partition in which it begins.  As a stream, the offset is how many bytes
  of each file have been read, to the last whole line, so lines appended to a file are new rows.

Options: ``path``, ``first``, ``bytes`` (of a partition, 64 MB).  Folders are listed on the driver through
Arrow's file systems, with the size and name of each file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from io import BufferedReader

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

from quillspark.sources.io import EXTRACTION

BYTES = 64 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _files(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path below ``path``, bytes) of the files with these endings, by path."""
    store, root = _store(path.rstrip("/"))
    told = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path[len(root) :].lstrip("/"), f.size) for f in told if f.type == fs.FileType.File and f.path.endswith(endings) and not f.base_name.startswith((".", "_")))


@dataclass
class Documents(InputPartition):
    files: list[tuple[str, int]] = field(default_factory=list)  # path and number


@dataclass
class Lines(InputPartition):
    file: str
    start: int
    end: int


class HtmlTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "html_tree"

    def schema(self) -> str:
        return "path string, raw string, doc_ord long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HtmlTreeReader(self.options)


class HtmlTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.first, self.bytes = options["path"], options.get("first"), int(options.get("bytes", BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, path: str) -> bool:
        for f in self.tests:
            if isinstance(f, EqualTo) and path != f.value or isinstance(f, In) and path not in f.value or isinstance(f, StringStartsWith) and not path.startswith(f.value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        files = sorted(_files(self.root, (".html",)), key=lambda x: (self.first is None or not x[0].startswith(self.first + "/"), x[0]))
        out, held = [Documents()], 0
        for number, (path, size) in enumerate(files):
            if self._passes(path):
                if held and held + size > self.bytes:
                    out.append(Documents())
                    held = 0
                out[-1].files.append((path, number))
                held += size
        return out

    def read(self, partition: Documents) -> Iterator[tuple]:
        store, root = _store(self.root.rstrip("/"))
        for path, number in partition.files:
            try:
                with store.open_input_stream(f"{root}/{path}") as f:
                    raw = f.read()
            except OSError:
                continue
            yield path, raw.decode("utf-8", "replace"), number


_KINDS = {StringType: (str,), LongType: (int,), IntegerType: (int,), DoubleType: (int, float), FloatType: (int, float), BooleanType: (bool,)}


class JsonLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_log"

    def schema(self) -> str:
        return EXTRACTION + ", bad string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return JsonLogReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return JsonLogStream(self.options, schema)


class _JsonLines:
    def __init__(self, options: dict[str, str], schema: StructType):
        self.root, self.bytes = options["path"], int(options.get("bytes", BYTES))
        self.fields = [(f.name, type(f.dataType)) for f in schema.fields]
        if unknown := [n for n, kind in self.fields if kind not in _KINDS]:
            raise ValueError(f"json_log has no columns of the type of {unknown}")

    def _row(self, line: bytes) -> tuple | None:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        try:
            found = json.loads(text)
        except ValueError:
            found = None
        keeps_bad = any(n == "bad" for n, _ in self.fields)
        if not isinstance(found, dict):
            return tuple(text if n == "bad" else None for n, _ in self.fields) if keeps_bad and text.strip() else None
        out = []
        for name, kind in self.fields:
            value = found.get(name)
            fits = isinstance(value, _KINDS[kind]) and (kind is BooleanType or not isinstance(value, bool))
            out.append((float(value) if kind in (DoubleType, FloatType) else value) if fits else None)
        return tuple(out)

    def read(self, partition: Lines) -> Iterator[tuple]:
        store, root = _store(self.root.rstrip("/"))
        with BufferedReader(store.open_input_file(f"{root}/{partition.file}")) as raw:
            at = partition.start
            if at:  # a line that begins before belongs to the part before
                raw.seek(at - 1)
                at += len(raw.readline()) - 1
            else:
                raw.seek(0)
            while at < partition.end and (line := raw.readline()):
                at += len(line)
                if (row := self._row(line)) is not None:
                    yield row

    def _cut(self, file: str, start: int, end: int) -> list[InputPartition]:
        return [Lines(file, a, min(end, a + self.bytes)) for a in range(start, end, self.bytes)]


class JsonLogReader(_JsonLines, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [p for file, size in _files(self.root, (".json", ".jsonl")) for p in self._cut(file, 0, size)] or [Lines("", 0, 0)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        return super().read(partition) if partition.file else iter(())


class JsonLogStream(_JsonLines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {file: whole for file, size in _files(self.root, (".json", ".jsonl")) if (whole := self._whole(file, size))}

    def _whole(self, file: str, size: int) -> int:
        """The bytes of a file up to the end of its last whole line."""
        store, root = _store(self.root.rstrip("/"))
        with store.open_input_file(f"{root}/{file}") as raw:
            end = size
            while end > 0:
                start = max(0, end - (1 << 16))
                raw.seek(start)
                cut = raw.read(end - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [p for file, to in sorted(end.items()) for p in self._cut(file, start.get(file, 0), to)]


def register(spark: SparkSession) -> None:
    """Make both formats known, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (HtmlTree, JsonLog):
        spark.dataSource.register(source)
