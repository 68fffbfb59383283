"""Matrices in NumPy's ``.npy`` files as a Spark source and sink.

``read_npy`` reads a file, or a folder of part files in name order, as ``row`` (from 0, over all parts) with ``values`` (an array, for a
matrix) or ``value`` (for a vector). Only headers are read on the driver; every task reads its own range of whole rows by seeking to
its bytes, and picks its columns there, so a matrix of any size is read by as many tasks as wanted.

``write_npy`` writes one part file per task, in the order of the partitions. A task writes under a name of its own attempt; the
commit step, on the driver, gives the files of the successful attempts their part names, so a lost or repeated task leaves nothing
behind that a reader sees. NumPy loads each part as it is.

Paths are those that Arrow's file systems know (``file``, ``hdfs``, ``s3``, ``gs``), and have to be reachable from every executor.
"""

from __future__ import annotations

import ast
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of rows that one task reads.
TASK_BYTES = 32 << 20
_BATCH_BYTES = 4 << 20

# Number formats of the files and their column types.
_KINDS = {"f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "b1": "boolean"}
_MAGIC = b"\x93NUMPY"


@dataclass
class Header:
    """Shape and number format of a file, and where its numbers begin."""

    shape: tuple[int, ...]
    kind: str
    start: int

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.kind).itemsize * (self.shape[1] if len(self.shape) == 2 else 1)

    @property
    def spark_kind(self) -> str:
        return _KINDS[self.kind[1:]]


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system for a path; Hadoop's short form of local paths is one of Arrow's long forms."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:") :]
    if path.startswith("file:///") or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), path.removeprefix("file://")
    return pyarrow.fs.FileSystem.from_uri(path)


def read_header(system: pyarrow.fs.FileSystem, path: str) -> Header:
    with system.open_input_file(path) as file:
        magic = file.read(8)
        if magic[:6] != _MAGIC:
            raise ValueError(f"{path} is no .npy file")
        size, form = (2, "<H") if magic[6] == 1 else (4, "<I")
        length = struct.unpack(form, file.read(size))[0]
        said = ast.literal_eval(file.read(length).decode("utf-8" if magic[6] >= 3 else "latin1"))
    shape, kind = tuple(said["shape"]), said["descr"]
    if not isinstance(kind, str) or kind[1:] not in _KINDS:
        raise ValueError(f"{path} holds {kind}, not one of {sorted(_KINDS)}")
    if len(shape) not in (1, 2):
        raise ValueError(f"{path} has {len(shape)} axes, not one or two")
    if said["fortran_order"] and len(shape) == 2 and min(shape) > 1:
        raise ValueError(f"{path} is stored by columns; rows can't be read apart")
    return Header(shape, kind, 8 + size + length)


def parts_of(path: str) -> list[tuple[str, Header]]:
    """The part files of a path in order, with their headers."""
    system, place = _file_system(path)
    info = system.get_file_info(place)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(f"could not find {path}")
    if info.type == pyarrow.fs.FileType.File:
        return [(place, read_header(system, place))]
    inside = system.get_file_info(pyarrow.fs.FileSelector(place))
    names = [f.path for f in inside if f.base_name.endswith(".npy") and f.base_name[0] not in "._"]
    return [(name, read_header(system, name)) for name in sorted(names, key=lambda n: (len(n), n))]


def chosen_columns(text: str | None, width: int) -> list[int] | None:
    """Column numbers from ``0,3,8:12``, or None for all."""
    if not text:
        return None
    out: list[int] = []
    for part in text.split(","):
        low, _, high = part.partition(":")
        out += range(int(low or 0), int(high or width)) if ":" in part else [int(low)]
    if not out or min(out) < 0 or max(out) >= width:
        raise ValueError(f"columns {text} of a matrix with {width}")
    return out


class _Rows(InputPartition):
    def __init__(self, path: str, header: Header, first: int, rows: int, before: int) -> None:
        self.path, self.header, self.first, self.rows, self.before = path, header, first, rows, before


class NpyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        self.root = options["path"]

    def partitions(self) -> Sequence[InputPartition]:
        most, out, before = int(self.options.get("taskbytes", TASK_BYTES)), [], 0
        for path, header in parts_of(self.root):
            rows = header.shape[0]
            step = max(1, most // max(header.row_bytes, 1))
            out += [_Rows(path, header, at, min(step, rows - at), before + at) for at in range(0, rows, step)]
            before += rows
        return out or [_Rows("", Header((0,), "<f8", 0), 0, 0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        header, done = partition.header, 0
        if not partition.rows:
            return
        width = header.shape[1] if len(header.shape) == 2 else None
        columns = chosen_columns(self.options.get("columns"), width) if width is not None else None
        step = max(1, _BATCH_BYTES // max(header.row_bytes, 1))
        with _file_system(self.root)[0].open_input_file(partition.path) as file:
            file.seek(header.start + partition.first * header.row_bytes)
            while done < partition.rows:
                count = min(step, partition.rows - done)
                raw = file.read(count * header.row_bytes)
                if len(raw) != count * header.row_bytes:
                    raise EOFError(f"{partition.path} ends before its header says")
                numbers = np.frombuffer(raw, np.dtype(header.kind)).astype(np.dtype(header.kind[1:]), copy=False)
                places = pa.array(np.arange(partition.before + done, partition.before + done + count))
                if width is None:
                    values, name = pa.array(numbers), "value"
                else:
                    table = numbers.reshape(count, width)
                    table = table if columns is None else table[:, columns]
                    ends = pa.array(np.arange(0, table.size + 1, max(table.shape[1], 1), dtype=np.int32)[: count + 1])
                    if not table.shape[1]:
                        ends = pa.array(np.zeros(count + 1, np.int32))
                    values, name = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(table).ravel())), "values"
                yield pa.RecordBatch.from_arrays([places, values], names=["row", name])
                done += count


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    path: str | None
    width: int | None


class NpyWriter(DataSourceArrowWriter):
    """One column: numbers (a vector) or arrays of numbers of one length (a matrix)."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        if len(schema) != 1:
            raise ValueError(f"a .npy file has one column, not {schema.names}")
        kind = schema[0].dataType
        self.listed = kind.typeName() == "array"
        named = (kind.elementType if self.listed else kind).simpleString()
        kinds = {v: k for k, v in _KINDS.items()}
        if named not in kinds:
            raise ValueError(f"{schema.names[0]} holds {named}, not one of {sorted(kinds)}")
        self.kind = ("|" if kinds[named][1] == "1" else "<") + kinds[named]
        self.root, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def _header(self, rows: int, width: int | None) -> bytes:
        """A header of fixed size for any number of rows, so it can be written again over itself."""
        shape = f"({rows:>20}, {width:>10})" if self.listed else f"({rows:>20},)"
        said = f"{{'descr': '{self.kind}', 'fortran_order': False, 'shape': {shape}, }}".encode()
        body = said + b" " * (-(len(said) + 11) % 64) + b"\n"
        return _MAGIC + b"\x01\x00" + struct.pack("<H", len(body)) + body

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = _file_system(self.root)
        folder = f"{root}/_temporary-{self.run}"
        system.create_dir(folder, recursive=True)
        path, rows, width = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}", 0, None
        with system.open_output_stream(f"{path}.numbers") as out:
            for batch in batches:
                column = batch.column(0)
                if column.null_count:
                    raise ValueError("a null row has no place in a .npy file")
                flat = column
                if self.listed:
                    widths = set(column.value_lengths().to_pylist())
                    widths |= {width} - {None}
                    if len(widths) > 1:
                        raise ValueError(f"rows of different lengths {sorted(widths)[:5]}")
                    width, flat = next(iter(widths), width), column.flatten()
                    if flat.null_count:
                        raise ValueError("a null number has no place in a .npy file")
                out.write(np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), np.dtype(self.kind)).tobytes())
                rows += len(column)
        if not rows:
            system.delete_file(f"{path}.numbers")
            return _Written(context.partitionId(), None, None)
        with system.open_output_stream(f"{path}.npy") as out, system.open_input_stream(f"{path}.numbers") as numbers:
            out.write(self._header(rows, width))
            while block := numbers.read(_BATCH_BYTES):
                out.write(block)
        system.delete_file(f"{path}.numbers")
        return _Written(context.partitionId(), f"{path}.npy", width)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _file_system(self.root)
        found = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.partition)
        widths = {m.width for m in found}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError(f"rows of different lengths {sorted(widths)[:5]}")
        system.create_dir(root, recursive=True)
        inside = system.get_file_info(pyarrow.fs.FileSelector(root))
        old = [f.path for f in inside if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(".npy")]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.root} already has part files")
        for path in old:
            system.delete_file(path)
        for number, message in enumerate(found):
            system.move(message.path, f"{root}/part-{number:08d}.npy")
        if not found:
            with system.open_output_stream(f"{root}/part-{0:08d}.npy") as out:
                out.write(self._header(0, 0))
        self._drop(system, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop(*_file_system(self.root))

    def _drop(self, system: pyarrow.fs.FileSystem, root: str) -> None:
        folder = f"{root}/_temporary-{self.run}"
        if system.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
            system.delete_dir(folder)


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        parts = parts_of(self.options["path"])
        forms = {(h.spark_kind, h.shape[1:]) for _, h in parts if h.shape[0]} or {(h.spark_kind, h.shape[1:]) for _, h in parts}
        if len(forms) != 1:
            raise ValueError(f"part files of {self.options['path']} don't fit each other: {sorted(forms)}")
        kind, rest = forms.pop()
        if rest:
            chosen_columns(self.options.get("columns"), rest[0])
        return f"row bigint, values array<{kind}>" if rest else f"row bigint, value {kind}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(schema, dict(self.options), overwrite)


def read_npy(spark: SparkSession, path: str, columns: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``row`` and ``values`` or ``value``; ``columns`` such as ``0,3,8:12`` picks some of a matrix."""
    spark.dataSource.register(NpyDataSource)
    reader = spark.read.format("npy").option("taskbytes", str(task_bytes))
    return (reader.option("columns", columns) if columns else reader).load(path)


def write_npy(df: DataFrame, path: str, column: str, order: Sequence[str], parts: int | None = None) -> None:
    """One column of a table as part files, rows by ``order``, which has to be total. Files that were there are replaced.

    Rows are ordered by ranges, one part file each (``parts`` of them, or as many as Spark finds right), so no task holds more than
    its range. Nulls are refused.
    """
    df.sparkSession.dataSource.register(NpyDataSource)
    rows = df.select(column, *[c for c in order if c != column])
    ranged = rows.repartitionByRange(*([parts] if parts else []), *order)
    ordered = ranged.sortWithinPartitions(*order).select(column)
    ordered.write.format("npy").mode("overwrite").save(path)
