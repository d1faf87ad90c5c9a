"""New and changed files of a folder as a stream: workbooks row by row, stored responses whole.

    spark.readStream.format("bidloom_arrivals").option("path", folder).option("log", log).load()

An offset is the number of a listing. Whenever Spark asks for the latest offset the folder is listed; what is new, or has
another size or time of change than when it was last listed, is written under the next number in ``log``, which must outlive the query
as its checkpoint does. A batch reads the files of the listings between two offsets and nothing else, so a second run parses what has
come since, and a repeated batch reads the same files. Every tenth listing is followed by a summary of all before, from which a
restart goes on. A file that is removed leaves what it gave. Files are dealt to tasks by size, workbooks fewer to a task, as they are packed.

Rows are ``(file, version, sheet, row, cells, sheet_no, error)`` with option ``rows`` = ``cells`` (workbooks; the default), and
``(file, version, modified, content)`` with ``content``. ``version`` is the number of the listing: of a file that came again,
rows of the higher version hold. A workbook that cannot be read gives one row with ``error``.
"""

from __future__ import annotations

import datetime
import fnmatch
import json
from collections.abc import Iterator, Sequence

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from bidloom import shared
from bidloom.sources import sink, xlsx
from bidloom.streaming.store import Store

CELLS = "file string, version long, sheet string, row int, cells array<string>, sheet_no int, error string"
CONTENT = "file string, version long, modified timestamp, content binary"
#: Bytes of files for one task, and the least that a file counts.
TASK_BYTES, FILE_BYTES = 64 << 20, 256 << 10
#: Bytes of workbooks for one task: a megabyte holds some fifty thousand rows, and parsing them takes seconds.
BOOK_BYTES = 1 << 20
SUMMARY = 10


class Listings:
    """The numbered listings of a folder."""

    def __init__(self, folder: str, log: str, pattern: str):
        self.fs, self.at = sink.reached(folder)
        self.log_fs, self.log = sink.reached(log)
        self.pattern = pattern
        self.last, self.known = 0, {}
        self._load()

    def _load(self) -> None:
        names = sink._names(self.log_fs, self.log)
        sums = [int(x[4:-5]) for x in names if x.startswith("all-") and x.endswith(".json")]
        if sums:
            self.last = max(sums)
            self.known = {f: tuple(s) for f, s in self._read(f"all-{self.last}.json")}
        while f"{self.last + 1}.json" in names:
            self.last += 1
            self.known.update((f, tuple(s)) for f, s in self._read(f"{self.last}.json"))

    def _read(self, name: str) -> list:
        with self.log_fs.open_input_stream(f"{self.log}/{name}") as f:
            return json.loads(f.read())

    def refresh(self) -> int:
        """Lists the folder; the number of the last listing that found anything."""
        selector = pyarrow.fs.FileSelector(self.at, allow_not_found=True)
        found = {x.base_name: (x.size, x.mtime_ns) for x in self.fs.get_file_info(selector) if x.is_file and fnmatch.fnmatch(x.base_name, self.pattern) and x.base_name[0] not in "_.~"}
        new = sorted((f, s) for f, s in found.items() if self.known.get(f) != s)
        if new:
            self.log_fs.create_dir(self.log)
            sink._put(self.log_fs, self.log, f"{self.last + 1}.json", json.dumps(new))
            self.last += 1
            self.known.update(new)
            if self.last % SUMMARY == 0:
                sink._put(self.log_fs, self.log, f"all-{self.last}.json", json.dumps(sorted(self.known.items())))
        return self.last

    def between(self, start: int, end: int) -> list[tuple[str, int, int, int]]:
        """(file, size, time, version) of the listings after ``start`` up to ``end``; of a file listed twice the last."""
        last: dict[str, tuple[str, int, int, int]] = {}
        for n in range(start + 1, end + 1):
            last.update((f, (f, s[0], s[1], n)) for f, s in self._read(f"{n}.json"))
        return sorted(last.values())


class Arrivals(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.log, self.pattern, self.kind = options["path"], options["log"], options.get("pattern", "*.xls[xm]"), options.get("rows", "cells")
        self._listings: Listings | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_listings": None}

    @property
    def listings(self) -> Listings:
        self._listings = self._listings or Listings(self.folder, self.log, self.pattern)
        return self._listings

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": self.listings.refresh()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        tasks: list[list[tuple]] = []
        room, most = 0, TASK_BYTES if self.kind == "content" else min(TASK_BYTES, BOOK_BYTES)
        for x in self.listings.between(start["listing"], end["listing"]):
            size = max(x[1], FILE_BYTES)
            if size > room or not tasks:
                tasks.append([])
                room = most
            tasks[-1].append(x)
            room -= size
        return [InputPartition(t) for t in tasks]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, at = sink.reached(self.folder)
        for file, _, mtime, version in partition.value:
            with fs.open_input_stream(f"{at}/{file}") as f:
                raw = f.read()
            if self.kind == "content":
                yield file, version, datetime.datetime.fromtimestamp(mtime / 1e9, tz=datetime.timezone.utc), raw
                continue
            try:
                for sheet, n, cells, no in xlsx.rows(raw):
                    yield file, version, sheet, n, cells, no, None
            except Exception as e:  # a broken file is told of and does not stop the others
                yield file, version, None, None, None, None, f"{type(e).__name__}: {e}"[:500]


class ArrivalsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bidloom_arrivals"

    def schema(self) -> str:
        kind = self.options.get("rows", "cells")
        if kind not in ("cells", "content"):
            raise ValueError("rows is cells or content")
        return CELLS if kind == "cells" else CONTENT

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Arrivals(self.options)


def stream(spark: SparkSession, folder: str, log: str, **options: str) -> DataFrame:
    """The stream of a folder's new and changed files."""
    spark.dataSource.register(ArrivalsSource)
    return spark.readStream.format("bidloom_arrivals").options(path=folder, log=log, **options).load()


def items(arrived: DataFrame) -> DataFrame:
    """Items of the workbooks of one batch, ``(file, version, item_id, ...)``; files that could not be read give none."""
    good = arrived.where("error is null")
    versions = good.groupBy("file").agg(F.max("version").alias("version"))
    return xlsx.items(good.drop("version", "error")).join(versions, "file")


def merge(store: Store, arrived: DataFrame, batch: int) -> bool:
    """Merges the items of one batch in ``store``, for ``foreachBatch``. Rows, versions and schemas are each read from the batch, so it is written first: workbooks are parsed once."""
    held = shared.cut(arrived, "batch")
    done = store.merge(items(held), batch)
    shared.drop(held)
    return done


def current(held: DataFrame) -> DataFrame:
    """Of rows kept by file and version, those of each file's last version: what an earlier version had and the last has not goes."""
    last = held.groupBy("file").agg(F.max("version").alias("version"))
    return held.join(last, ["file", "version"], "left_semi")
