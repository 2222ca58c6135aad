"""Records of molecule files as a Python data source: read by byte ranges, written packed with an index.

``spark.read.format("molecule_records").option("kind", "sdf").load(path)`` gives a row a record, ``file, start, record``. A file is cut into
ranges of ``range_bytes``; a task finds the first record that starts in its range and reads on until the last one that does is complete, so that
one large file is read by many tasks and no record is read twice. Kinds: ``sdf`` (ended by a line ``$$$$``, and only by a whole line), ``smi``
(a line each), ``points`` (begun by a line ``dim:name``) and ``pdb`` (ended by a line ``END``).

``df.write.format("molecule_records").mode("append").save(path)`` takes ``mol_id, record`` and packs the records of a task in one file, with a
Parquet index ``mol_id, file, start, length`` beside it. Tasks write under a name of the attempt in a temporary folder; only files of attempts
that the driver commits are moved into place, and an aborted job leaves nothing.

Paths are those that ``pyarrow.fs`` opens: local ones and URIs of network stores.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 64 << 20
#: Lines that end a record, and lines that begin one.
_ENDS = {"sdf": re.compile(rb"\$\$\$\$\s*\Z"), "pdb": re.compile(rb"END\s*\Z"), "smi": re.compile(rb"")}
_BEGINS = {"points": re.compile(rb"\d+:")}
#: No line that ends a record is longer.
_BACK = 64
_BLOCK, _BATCH = 1 << 20, 500
_COLUMNS = ["file", "start", "record"]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Data files at a path and their sizes; names that begin with a dot or an underscore, and indexes, are none."""
    system, name = _opened(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = system.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(name, recursive=True))
    inside = lambda i: i.path[len(name) :].split("/")
    return sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File and i.size and not any(p.startswith(("_", ".")) for p in inside(i)) and not i.path.endswith(".index"))


def lines_from(file, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Lines of a file from the byte ``at`` on, each with its place and its end; the first may be the rest of a line."""
    held, place = b"", at
    while at < size:
        block = file.read_at(min(_BLOCK, size - at), at)
        at += len(block)
        *lines, held = (held + block).split(b"\n")
        for line in lines:
            yield place, line + b"\n"
            place += len(line) + 1
    if held:
        yield place, held


def records_in(file, size: int, start: int, end: int, kind: str) -> Iterator[tuple[int, bytes]]:
    """Records of a file that start from ``start`` on and before ``end``, with their places.

    Lines are read from a little before ``start``, so that a line that ends a record there is seen whole; the first may be the rest of a longer
    one and is passed over.
    """
    ends, begins = _ENDS.get(kind), _BEGINS.get(kind)
    back = max(0, start - _BACK)
    lines = lines_from(file, back, size)
    if back:
        next(lines, None)
    fresh, began = not back or kind == "smi", None  # whether a record begins with the next line, and where the one at hand began, if that is known
    held: list[bytes] = []
    for place, line in lines:
        if fresh or begins and begins.match(line):
            if held:
                yield began, b"".join(held)
            held, began, fresh = [], place, False
            if began >= end:
                return
        if began is not None and began >= start:
            held.append(line)
        fresh = bool(ends and ends.match(line))
    if b"".join(held).strip():
        yield began, b"".join(held)


@dataclass
class _Range(InputPartition):
    path: str
    size: int
    start: int
    end: int

    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, range_bytes: int):
        if kind not in {*_ENDS, *_BEGINS}:
            raise ValueError(f"unknown kind of records {kind}")
        self.path, self.kind, self.range_bytes = path, kind, range_bytes

    def partitions(self) -> list[_Range]:
        return [_Range(p, size, at, min(size, at + self.range_bytes)) for p, size in _files(self.path) for at in range(0, size, self.range_bytes)] or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        system, name = _opened(part.path)
        with system.open_input_file(name) as file:
            rows: list[tuple[int, bytes]] = []
            for row in records_in(file, part.size, part.start, part.end, self.kind):
                if self.kind == "smi" and not row[1].strip():
                    continue
                rows.append(row)
                if len(rows) == _BATCH:
                    yield self._batch(part.path, rows)
                    rows = []
            if rows:
                yield self._batch(part.path, rows)

    def _batch(self, path: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        texts = [r.decode("utf-8", errors="replace") for _, r in rows]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.int64()), pa.array(texts, pa.string())], _COLUMNS)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        name, at, index = f"part-{uuid.uuid4().hex}", 0, []
        system, folder = _opened(self.job)
        system.create_dir(folder, recursive=True)
        ids = None
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                ids = batch.schema.field("mol_id")
                for mol_id, record in zip(batch.column("mol_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                    raw = (record or "").encode()
                    raw += b"" if raw.endswith(b"\n") else b"\n"
                    out.write(raw)
                    index.append((mol_id, name, at, len(raw)))
                    at += len(raw)
        if ids is None:
            system.delete_file(f"{folder}/{name}")
            return _Written("", 0)
        columns = list(zip(*index, strict=True))
        table = pa.table([pa.array(columns[0], ids.type), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["mol_id", "file", "start", "length"])
        with system.open_output_stream(f"{folder}/{name}.index") as out:
            pq.write_table(table, out)
        return _Written(name, len(index))

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = _opened(self.job)
        target = _opened(self.path)[1]
        old = [p for p, _ in _files(self.path)] if self.overwrite and system.get_file_info(target).type == fs.FileType.Directory else []
        for m in messages:
            if m is not None and m.name:
                system.move(f"{folder}/{m.name}.index", f"{target}/{m.name}.index")
                system.move(f"{folder}/{m.name}", f"{target}/{m.name}")
        for p in old:
            for name in (_opened(p)[1], f"{_opened(p)[1]}.index"):
                if system.get_file_info(name).type == fs.FileType.File:
                    system.delete_file(name)
        self._clean()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Remove what attempts that were not committed have written."""
        system, folder = _opened(self.job)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class MoleculeRecords(DataSource):
    """The data source; ``register`` makes it known to a session."""

    @classmethod
    def name(cls) -> str:
        return "molecule_records"

    def schema(self) -> str:
        return "file string, start long, record string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("kind", "sdf"), int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def read_records(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, start, record`` of all records at ``path``."""
    spark.dataSource.register(MoleculeRecords)
    return spark.read.format("molecule_records").option("kind", kind).option("range_bytes", range_bytes).load(path)


def write_records(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write ``mol_id, record``, many to a file."""
    records.sparkSession.dataSource.register(MoleculeRecords)
    records.select("mol_id", F.col("record").cast("string").alias("record")).write.format("molecule_records").mode("overwrite" if overwrite else "append").save(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``mol_id, file, start, length`` of all records written at ``path``."""
    return spark.read.option("pathGlobFilter", "*.index").parquet(path)


def point_records(points: DataFrame, dim: int = 3) -> DataFrame:
    """Molecules' points as records: a header ``dim:mol_id`` and a line a point."""
    line = F.format_string("%s %.4f %.4f %.4f", "feat", "x", "y", "z")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("point_no", line.alias("s")))), lambda p: p["s"]), "\n")
    return points.groupBy("mol_id").agg(body.alias("body")).select("mol_id", F.concat(F.lit(f"{dim}:"), F.coalesce(F.col("mol_id").cast("string"), F.lit("")), F.lit("\n"), F.col("body")).alias("record"))


def parsed_points(records: DataFrame) -> DataFrame:
    """``name, point_no, feat, x, y, z`` of point records; lines that are no point are left out."""
    lines = records.select(F.split("record", "\r?\n").alias("l"))
    named = lines.select(F.get(F.split(F.get("l", F.lit(0)), ":", 2), F.lit(1)).alias("name"), F.posexplode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("point_no", "value"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = named.filter(F.trim("value") != "").select("name", "point_no", F.get(parts, F.lit(0)).alias("feat"), *[F.get(parts, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")])
    return rows.filter("x is not null and y is not null and z is not null")
