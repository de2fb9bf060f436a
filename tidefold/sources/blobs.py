"""The raw archive: files named by their content under two levels of folders."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidefold.functions import scalars as X
from tidefold.operators.uploads import MAX_BYTES

CHUNK = 65_536


def _system(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


#: Bytes of contents that a task holds at once, beside the file that it reads.
HELD = 16 << 20


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def top_folders(root: str) -> list[str]:
    """The folders right below ``root``, and ``""`` for the files that lie there: at most a few hundred in an archive's layout, however many files it holds."""
    system, base = _system(root)
    found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return ["", *sorted(x.base_name for x in found if x.type == pafs.FileType.Directory and not _hidden(x.base_name))]


def files_in(root: str, folder: str) -> Iterator[pafs.FileInfo]:
    """The files of one of ``top_folders``, at any depth, folder by folder; Spark's readers pass over the same hidden names."""
    system, base = _system(root)
    todo = [f"{base}/{folder}" if folder else base]
    while todo:
        for x in system.get_file_info(pafs.FileSelector(todo.pop())):
            if not _hidden(x.base_name):
                if x.is_file:
                    yield x
                elif folder and x.type == pafs.FileType.Directory:
                    todo.append(x.path)


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as Spark names it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _dealt(spark: SparkSession, root: str) -> DataFrame:
    """The top folders, each for a task of its own: the driver sees these names, and never the files'. Spark takes the files for as few as the folders: what is made of them needs the hint
    ``merge``, or a join sends them all through the driver."""
    folders = [(x,) for x in top_folders(root)]
    return spark.createDataFrame(folders, "folder string").repartition(min(len(folders), 256))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of all files below ``root``, listed by tasks; no file is opened."""
    top, base = qualified(spark, root), _system(root)[1].rstrip("/")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files = files_in(root, folder)
                while some := [top + x.path[len(base) :] for x in islice(files, 10_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["path"])

    return _dealt(spark, root).mapInArrow(look, "path string").hint("merge")


def read_bodies(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path``, ``modified_at``, ``size_bytes``, ``sha256``, ``content``, ``code`` of all files, empty ones too, which the tasks that list them read. Larger ones than ``max_bytes`` are not opened: their code is
    ``file_too_large``, their hash and content are null."""
    top, base = qualified(spark, path), _system(path)[1].rstrip("/")
    kinds = [("path", pa.string()), ("modified_at", pa.timestamp("us", "UTC")), ("size_bytes", pa.int64()), ("content", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _system(path)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows, held = [], 0
                for x in files_in(path, folder):
                    body = None
                    if x.size <= max_bytes:
                        with system.open_input_stream(x.path) as f:
                            body = f.read()
                    rows.append((top + x.path[len(base) :], x.mtime, x.size, body))
                    held += len(body or b"") + 1000
                    if held >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    files = _dealt(spark, path).mapInArrow(read, "path string, modified_at timestamp, size_bytes long, content binary")
    code = F.when(F.col("size_bytes") > max_bytes, "file_too_large").otherwise("ok").alias("code")
    return files.select("path", "modified_at", "size_bytes", X.sha256_hex("content").alias("sha256"), "content", code).hint("merge")


def with_bodies(files: DataFrame) -> DataFrame:
    """Rows of ``path``, as ``listed`` gives them, to ``path`` and ``content``, a few at once; of a stream, too."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies, held = [], [], 0
            for name in batch.column(0).to_pylist():
                # Hadoop's names of local files have one slash
                system, at = (pafs.LocalFileSystem(), name[5:]) if name.startswith("file:") else pafs.FileSystem.from_uri(name)
                with system.open_input_stream(at) as f:
                    bodies.append(f.read())
                names.append(name)
                held += len(bodies[-1]) + 1000
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])
                    names, bodies, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])

    return files.select("path").mapInArrow(read, "path string, content binary")


def stored_paths(spark: SparkSession, root: str) -> DataFrame:
    """The relative paths that the archive holds; file contents are not read."""
    return listed(spark, root).select(F.regexp_extract("path", r"([0-9a-f]{2}/[0-9a-f]{2}/[0-9a-f]{64}[^/]*)$", 1).alias("path")).filter("path <> ''")


class Files(DataSource):
    """The names of all files below ``path`` as a stream: a trigger lists them all, a task each of the top folders. What came before is left to the reader's state
    (``streaming.uploads.archive_stream``), so that the driver holds no name."""

    @classmethod
    def name(cls) -> str:
        return "archive_files"

    def schema(self) -> str:
        return "path string"

    def streamReader(self, schema: T.StructType) -> FilesStream:  # noqa: N802
        return FilesStream(self.options["path"], self.options["top"])


@dataclass
class Folder(InputPartition):
    folder: str


class FilesStream(DataSourceStreamReader):
    def __init__(self, root: str, top: str):
        self.root, self.top = root, top

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listed": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"listed": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(x) for x in top_folders(self.root)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        base = _system(self.root)[1].rstrip("/")
        for x in files_in(self.root, partition.folder):
            yield (self.top + x.path[len(base) :],)

    def commit(self, end: dict) -> None:
        pass


def store(blobs: DataFrame, root: str) -> DataFrame:
    """Write ``path`` and ``content`` under ``root``, a folder that all executors share, each file by its task: to a temporary name, then renamed, so that a
    repeated task does no harm. Gives ``path`` and ``written`` (false: it was there); nothing happens before an action."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _system(root)
        for batch in batches:
            done = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                target = f"{base}/{path}"
                there = fs.get_file_info(target).type != pafs.FileType.NotFound
                if not there:
                    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    # a name that readers pass over
                    made = "/.".join(target.rsplit("/", 1)) + ".part"
                    with fs.open_output_stream(made) as out:
                        out.write(content.as_buffer())
                    fs.move(made, target)
                done.append(not there)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done)], names=["path", "written"])

    return blobs.select("path", "content").mapInArrow(write, "path string, written boolean")


def chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of ``sha256``, ``content`` as pieces of ``size`` bytes: sha256, index, chunk."""
    count = F.ceil(F.octet_length("content") / size).cast("int")
    numbered = files.select("sha256", "content", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("index"))
    return numbered.select("sha256", "index", F.expr(f"substring(content, index * {size} + 1, {size})").alias("chunk"))
