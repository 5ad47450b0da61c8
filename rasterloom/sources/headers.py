"""Spark data sources for image files: headers of compressed files without their samples, and a sink of whole files.

`spark.read.format("jpegls").load(folder)` reads only the first bytes of each file, so the cost of a metadata query goes
with the number of files and not with their size. `df.write.format("imagefiles").save(folder)` writes each row's
content as a file of its own.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import container
from ..operators.errors import StreamError

#: Bytes of a file that are read at first; the whole file only where its header goes on.
HEAD_BYTES, FILES_PER_TASK = 1 << 16, 256
HEADER = "path string, length long, width int, height int, bits_per_sample int, component_count int, near int, interleave_mode int, restart_interval int, colour_transform int, spiff_valid boolean, error_code int"


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = f"file://{posixpath.abspath(path)}"
    return fs.FileSystem.from_uri(path)


class JpegLsSource(DataSource):
    """Options: path (a file, or a folder and all below it), filesPerTask, headBytes."""

    @classmethod
    def name(cls) -> str:
        return "jpegls"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(dict(self.options))


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.per_task, self.head = int(options.get("filespertask", FILES_PER_TASK)), int(options.get("headbytes", HEAD_BYTES))

    def partitions(self) -> Sequence[Files]:
        """Only names and sizes are listed here."""
        from pyarrow import fs

        system, top = _filesystem(self.path)
        info = system.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Files(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _filesystem(self.path)
        for path, size in partition.paths:
            with system.open_input_file(path) as f:
                reader, code = self._header(f.read(self.head))
                if code is not None and size > self.head:
                    f.seek(0)
                    reader, code = self._header(f.read())
            scan = reader.scans[0] if reader.scans else None
            yield path, size, reader.width, reader.height, reader.bits, reader.count, scan and scan.near, scan and scan.mode, reader.interval, reader.transform, reader.spiff_is_valid(), code

    @staticmethod
    def _header(data: bytes) -> tuple[container.Reader, int | None]:
        reader = container.Reader(data)
        try:
            return reader.header(), None
        except StreamError as e:
            return reader, int(e.code)


class ImageFilesSink(DataSource):
    """Columns: name (of the file, below the path) and content. A repeated name is an error of the job."""

    @classmethod
    def name(cls) -> str:
        return "imagefiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], [schema.fieldNames().index(c) for c in ("name", "content")])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    staged: str


class FileWriter(DataSourceWriter):
    """A task writes below a folder of its own; what the job commits is moved into place, so a task that is done again
    leaves nothing behind."""

    def __init__(self, path: str, places: list[int]) -> None:
        self.path, self.places, self.job = path, places, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, top = _filesystem(self.path)
        staged, names = f"{top}/_staged-{self.job}/{uuid.uuid4().hex}", []
        for row in rows:
            name, content = (row[i] for i in self.places)
            if name is None or content is None or posixpath.isabs(name) or ".." in name.split("/"):
                raise ValueError(f"a row needs content and a name below the folder, not {name!r}")
            target = f"{staged}/{name}"
            system.create_dir(posixpath.dirname(target), recursive=True)
            with system.open_output_stream(target) as f:
                f.write(bytes(content))
            names.append(name)
        return Written(names, staged)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, top = _filesystem(self.path)
        names = [n for m in messages if m for n in m.names]
        if len({*names}) != len(names):
            self.abort(messages)
            raise ValueError("two rows have one name")
        for folder in {posixpath.dirname(n) for n in names}:
            system.create_dir(f"{top}/{folder}", recursive=True)
        for m in messages:
            for n in m.names if m else ():
                system.move(f"{m.staged}/{n}", f"{top}/{n}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, top = _filesystem(self.path)
        if system.get_file_info(f"{top}/_staged-{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/_staged-{self.job}")


def register(spark: SparkSession) -> None:
    for source in (JpegLsSource, ImageFilesSink):
        spark.dataSource.register(source)
