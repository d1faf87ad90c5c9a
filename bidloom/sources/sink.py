"""Workbooks as a sink with a commit.

``df.write.format("bidloom_xlsx").mode("append").save(folder)`` takes cell rows ``(file, sheet_no, sheet, ord, cells)`` or
finished workbooks ``(file, content)``. Tasks write under a staging folder of the job, each attempt in a folder of its
own, and never a final name; the message of an attempt that Spark accepts names what it has staged. The commit checks all
of it, writes down what it is going to do in one file, and renames. What a lost, repeated or speculative attempt has staged is
never named and goes with the staging folder. A driver that dies between two renames leaves its record:
``recover`` carries it out, and doing so twice does no harm. Where the check fails nothing is renamed.

Mode ``append`` refuses names that exist, or replaces them with option ``existing`` = ``replace``; mode ``overwrite`` also
removes workbooks of other names once its own are in place. Rows of one workbook must lie together and in order in one partition, as
``clustered`` deals them; a workbook is then written row by row, whatever its length. ``paged`` deals sheets of over
``most`` rows to several workbooks, so that no task has to write more than that of a sheet.

Folders are reached by any file system that Arrow knows, from the driver and every executor.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from bidloom import shared
from bidloom.sources import workbook

RECORD, STAGING, DONE = "_commit-", "_staging-", "_SUCCESS"
#: Rows of a sheet that ``save_rows`` puts in one workbook.
PAGE = 200_000


def reached(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder.removeprefix("file:"))


def _exists(fs: pyarrow.fs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound


def _names(fs: pyarrow.fs.FileSystem, at: str) -> list[str]:
    return [x.base_name for x in fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True))]


def _put(fs: pyarrow.fs.FileSystem, at: str, name: str, content: str) -> None:
    """A small file that is there whole or not at all."""
    with fs.open_output_stream(f"{at}/{STAGING}{name}") as f:
        f.write(content.encode())
    _move(fs, f"{at}/{STAGING}{name}", f"{at}/{name}")


def _move(fs: pyarrow.fs.FileSystem, source: str, target: str) -> None:
    if not isinstance(fs, pyarrow.fs.LocalFileSystem) and _exists(fs, target):
        fs.delete_file(target)  # local renames replace; others may refuse
    fs.move(source, target)


@dataclass
class Staged(WriterCommitMessage):
    """What one accepted attempt has staged: places under the staging folder, final names, rows."""

    files: list[tuple[str, str, int]]


class BookWriter(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool, existing: str = "error"):
        names = set(schema.names)
        self.cells = {"file", "sheet_no", "sheet", "ord", "cells"} <= names
        if not self.cells and not {"file", "content"} <= names:
            raise ValueError("workbooks are written from (file, sheet_no, sheet, ord, cells) or (file, content)")
        if existing not in ("error", "replace"):
            raise ValueError("existing is error or replace")
        self.folder, self.overwrite, self.existing, self.job = folder, overwrite, existing, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        fs, at = reached(self.folder)
        staging, files, seen = f"{at}/{STAGING}{self.job}/{attempt}", [], set()
        for file, rows in groupby(iterator, lambda r: r["file"]):
            if not file or "/" in file or file.startswith(("_", ".")):
                raise ValueError(f"not a name of a workbook: {file!r}")
            if file in seen:
                raise ValueError(f"the rows of {file} do not lie together: deal them with clustered()")
            seen.add(file)
            if not files:
                fs.create_dir(staging)
            n = 0
            with fs.open_output_stream(f"{staging}/{file}") as out:
                if self.cells:
                    n = _pack(out, rows)
                else:
                    for n, row in enumerate(rows, 1):
                        if n > 1:
                            raise ValueError(f"two contents of one name: {file}")
                        out.write(row["content"] or b"")
            files.append((f"{attempt}/{file}", file, n))
        return Staged(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = reached(self.folder)
        staged = [x for m in messages if m is not None for x in m.files]
        finals = [name for _, name, _ in staged]
        here = set(_names(fs, at))
        if twice := sorted({x for x in finals if finals.count(x) > 1} if len(set(finals)) < len(finals) else ()):
            self._give_up(fs, at, f"several tasks wrote {', '.join(twice[:5])}: deal rows with clustered()")
        if not self.overwrite and self.existing == "error" and (known := sorted(here & set(finals))):
            self._give_up(fs, at, f"already there: {', '.join(known[:5])}")
        stale = sorted(x for x in here - set(finals) if x.lower().endswith((".xlsx", ".xlsm"))) if self.overwrite else []
        fs.create_dir(at)
        done = {"files": len(finals), "rows": sum(n for _, _, n in staged)}
        _put(fs, at, f"{RECORD}{self.job}.json", json.dumps({"job": self.job, "moves": [x[:2] for x in staged], "stale": stale, "done": done}))
        _carry_out(fs, at, f"{RECORD}{self.job}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = reached(self.folder)
        if not _exists(fs, f"{at}/{RECORD}{self.job}.json") and _exists(fs, f"{at}/{STAGING}{self.job}"):
            fs.delete_dir(f"{at}/{STAGING}{self.job}")

    def _give_up(self, fs: pyarrow.fs.FileSystem, at: str, why: str) -> None:
        self.abort([])
        raise ValueError(why)


def _pack(out, rows: Iterator[Row]) -> int:
    """Writes rows that are ordered by sheet as a workbook; their number."""
    n, last = 0, None

    def cells(own: Iterator[Row]) -> Iterator[list[str | None]]:
        nonlocal n, last
        for r in own:
            here = (r["sheet_no"], r["ord"])
            if last is not None and here < last:
                raise ValueError(f"the rows of {r['file']} are not in order: deal them with clustered()")
            n, last = n + 1, here
            yield list(r["cells"] or ())

    workbook.pack(out, ((str(first["sheet"]), cells(own)) for first, own in _sheets(rows)))
    return n


def _sheets(rows: Iterator[Row]) -> Iterator[tuple[Row, Iterator[Row]]]:
    for _, own in groupby(rows, lambda r: r["sheet_no"]):
        first = next(own)
        yield first, (x for part in ((first,), own) for x in part)


def _carry_out(fs: pyarrow.fs.FileSystem, at: str, record: str) -> None:
    """Does what a record says; what is done already is left."""
    with fs.open_input_stream(f"{at}/{record}") as f:
        plan = json.loads(f.read())
    staging = f"{at}/{STAGING}{plan['job']}"
    for source, target in plan["moves"]:
        if _exists(fs, f"{staging}/{source}"):
            _move(fs, f"{staging}/{source}", f"{at}/{target}")
        elif not _exists(fs, f"{at}/{target}"):
            raise FileNotFoundError(f"{target} was neither staged nor written")
    for name in plan["stale"]:
        if _exists(fs, f"{at}/{name}"):
            fs.delete_file(f"{at}/{name}")
    if _exists(fs, staging):
        fs.delete_dir(staging)
    _put(fs, at, DONE, json.dumps(plan["done"]))
    fs.delete_file(f"{at}/{record}")


def recover(folder: str) -> int:
    """Carries out the commits that a lost driver has left in ``folder`` and drops staging folders without one; the number of commits. No job may be writing there."""
    fs, at = reached(folder)
    records = [x for x in _names(fs, at) if x.startswith(RECORD)]
    for record in records:
        _carry_out(fs, at, record)
    for name in _names(fs, at):
        if name.startswith(STAGING):
            path = f"{at}/{name}"
            (fs.delete_dir if fs.get_file_info(path).type == pyarrow.fs.FileType.Directory else fs.delete_file)(path)
    return len(records)


def paged(rows: DataFrame, most: int = PAGE, header: int = 1) -> DataFrame:
    """Cell rows whose long sheets are dealt to several workbooks ``name-0001.xlsx`` and so on, ``most`` rows each under the first ``header`` rows of the sheet.

    A row's place in its sheet is its place in its part of a range partition plus what the parts before hold, so no task sorts a
    sheet. The rows are written once, so that a repeated task finds them in the same parts.
    """
    order, sheet = ["file", "sheet_no", "ord"], ["file", "sheet_no"]
    # Rows of one key would fall into one range; a hash of the cells splits ties, which a sheet does not order anyway.
    dealt = rows.select(*order, "sheet", "cells").repartitionByRange(*order, F.xxhash64("cells")).sortWithinPartitions(*order, F.xxhash64("cells"))
    held = shared.cut(dealt.withColumn("id", F.monotonically_increasing_id()), "pages").withColumns({"part": F.shiftright("id", 33), "at": F.col("id").bitwiseAND((1 << 33) - 1)})
    parts = held.groupBy(*sheet, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*sheet).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*sheet, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy(*sheet)).alias("rows"))
    parts = parts.withColumn("pages", F.greatest(F.lit(1), F.ceil((F.max("rows").over(W.partitionBy("file")) - header) / most)).cast("int"))
    own = F.greatest(F.lit(1), F.ceil((F.col("rows") - header) / most)).cast("int")
    place = F.col("at") + F.col("shift")
    pages = F.when(place < header, F.sequence(F.lit(1), own)).otherwise(F.array((F.floor((place - header) / most) + 1).cast("int")))
    name = F.when(F.col("pages") == 1, F.col("file")).otherwise(F.regexp_replace("file", r"^(.*?)(\.[^.]*)?$", F.concat(F.lit("$1-"), F.lpad(F.col("page").cast("string"), 4, "0"), F.lit("$2"))))
    j = held.join(parts, [*sheet, "part"]).select("*", F.explode(pages).alias("page"))
    return j.select(name.alias("file"), "sheet_no", "sheet", "ord", "cells")


def clustered(rows: DataFrame) -> DataFrame:
    """Rows of a workbook in one partition, in the order of its sheets."""
    return rows.repartition("file").sortWithinPartitions("file", "sheet_no", "ord", F.xxhash64("cells"))


def write(rows: DataFrame, folder: str, overwrite: bool = False, existing: str = "replace") -> dict:
    """Writes clustered cell rows, or finished workbooks, by the sink; ``{"files": n, "rows": m}``."""
    from bidloom.sources import xlsx

    xlsx.register(rows.sparkSession)
    rows.write.format("bidloom_xlsx").mode("overwrite" if overwrite else "append").option("existing", existing).save(folder)
    fs, at = reached(folder)
    with fs.open_input_stream(f"{at}/{DONE}") as f:
        return json.loads(f.read())


def save_rows(rows: DataFrame, folder: str, most: int = PAGE, overwrite: bool = False, existing: str = "replace") -> dict:
    """Cell rows as workbooks of at most ``most`` rows a sheet and its header."""
    return write(clustered(paged(rows, most)), folder, overwrite, existing)
