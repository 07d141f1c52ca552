"""A file for each name, or each row of several names (a folder in a folder), written as a whole or not at all.

Tasks write their files below a folder of the job. Only when all tasks are done does the driver move them to where they belong, a rename each, and drop that
folder; a job that fails, or a task that is killed, leaves nothing behind, and a task that runs twice has its second files dropped. A name's
file is ``column=name/part-0.txt``, the same on each run, so that writing again replaces a file by a whole one, or with ``keep`` leaves it as it is, and runs that
meet end with one of their files, never with both or a half. Spark reads the folders back as a partitioned table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from canopy.sources.blocks import opened

#: What Spark escapes in the folders of a partitioned table.
_ESCAPED = re.compile("[\x00-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
MOVERS = 16


def folder(column: str, name: str | int | None) -> str:
    name = name if name is None else str(name)
    value = "__HIVE_DEFAULT_PARTITION__" if name is None or name == "" else _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name)
    return f"{column}={value}"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its own folder and for each of the files there, named by their numbers, the folder where it is to stand."""

    own: str
    folders: list[str]


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], keep: bool, overwrite: bool):
        self.path, self.columns, self.keep, self.overwrite = path, columns, keep, overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, at = opened(self.path)
        own = f"{at}/{self.job}/{uuid.uuid4().hex}"
        folders: list[str] = []
        seen: set = set()
        out, last = None, None
        try:
            for batch in iterator:
                names = zip(*[batch.column(c).to_pylist() for c in self.columns])
                for name, value in zip(names, batch.column("value").to_pylist()):
                    if out is None or name != last:
                        if name in seen:
                            raise ValueError(f"lines of {'/'.join(map(str, name))} do not stand together")
                        if out is None:
                            system.create_dir(own)
                        else:
                            out.close()
                        seen.add(name)
                        last = name
                        out = system.open_output_stream(f"{own}/{len(folders)}")
                        folders.append("/".join(map(folder, self.columns, name)))
                    if value is not None:
                        out.write(value.encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Written(own, folders)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = opened(self.path)
        done = [m for m in messages if m is not None]
        if len({to for m in done for to in m.folders}) < sum(len(m.folders) for m in done):
            raise ValueError("lines of one name come from several tasks")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if old.base_name.startswith(f"{self.columns[0]}="):
                    system.delete_dir(old.path)

        def move(folder: str, file: str) -> None:
            to = f"{at}/{folder}"
            if self.keep and system.get_file_info(f"{to}/part-0.txt").is_file:
                return
            system.create_dir(to)
            system.move(file, f"{to}/part-0.txt")

        with ThreadPoolExecutor(MOVERS) as pool:
            for m in done:
                list(pool.map(move, m.folders, (f"{m.own}/{i}" for i in range(len(m.folders)))))
        self._drop()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        system, at = opened(self.path)
        if system.get_file_info(f"{at}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.job}")


class NamedFiles(DataSource):
    """Format ``named_files`` of rows (columns of names, value); options path, column (one or several, by commas) and keep."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        columns = self.options["column"].split(",")
        if not {*columns, "value"} <= set(schema.names):
            raise ValueError(f"columns {self.options['column']} and value are wanted")
        return NamedWriter(self.options["path"], columns, self.options.get("keep", "false") == "true", overwrite)


def write_named(rows: DataFrame, path: str, column: str | tuple[str, ...], order: tuple[str, ...] = (), keep: bool = False, overwrite: bool = False) -> None:
    """A file of the lines (value) of each name in column (or row of names in several), in an order; with keep, files that are there stay as they are."""
    rows.sparkSession.dataSource.register(NamedFiles)
    columns = (column,) if isinstance(column, str) else column
    own = rows.repartition(*columns).sortWithinPartitions(*columns, *order).select(*columns, "value")
    writer = own.write.format("named_files").mode("overwrite" if overwrite else "append").option("path", path).option("column", ",".join(columns))
    writer.option("keep", str(keep).lower()).save()
