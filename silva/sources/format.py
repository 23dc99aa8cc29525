"""Point-cloud files as a Spark data source: ``spark.read.format("silva")`` and ``df.write.format("silva")``.

Files of fixed record width (LAS, binary PLY and PCD) are read in ranges of records, so a file of any size is many tasks, and only
the columns asked for are decoded. Comparisons of x, y and z with numbers reach the reader: files whose header says that their box holds nothing of it
aren't opened by tasks, and records beyond are dropped before they reach Spark. Tasks write beside the folder, and a commit of all moves their files
into it; a job that fails leaves nothing. Driver and executors open files by pyarrow, so the store must be one that it knows;
:func:`clouds.read_points` reads from any store that Spark knows.
"""

from __future__ import annotations

import fnmatch
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from . import clouds
from .clouds import XYZ

NAME = "silva"
#: Bytes of records in one partition, unless the option ``rowsPerPartition`` says how many rows.
PARTITION_BYTES = 64 << 20
#: The file beside the points that tells their count and box.
INDEX = "_points.json"


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand filters to it."""
    spark.dataSource.register(PointSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _listed(path: str) -> list[tuple[str, int]]:
    """Name and size of a file, of the files of a folder, or of those that a pattern in the last part of the path matches; names that begin with a dot or an underscore are left out."""
    store, at = clouds._store(path)
    lead = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    folder, pattern = (at, "*") if info.type == fs.FileType.Directory else at.rsplit("/", 1)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"]
    return [(lead + f.path, f.size) for f in sorted(names, key=lambda f: f.base_name)]


def _layout(path: str, kind: str) -> tuple[clouds.Layout, tuple | None]:
    """How a file holds its points, and the box that a LAS header tells: (least, largest) of each axis."""
    store, at = clouds._store(path)
    with store.open_input_file(at) as file:
        head = file.read(clouds.HEADER_BYTES)
        if kind == "las" and len(head) >= 100 and (start := struct.unpack_from("<I", head, 96)[0]) > len(head):
            head += file.read(start - len(head))
    box = None
    if kind == "las":
        told = struct.unpack_from("<6d", head, 179)
        box = tuple((told[2 * i + 1], told[2 * i]) for i in range(3))
    return clouds.LAYOUTS[kind](head), box


@dataclass
class Range(ds.InputPartition):
    """Records of one file."""

    path: str
    kind: str
    number: int
    first: int
    stop: int | None


class PointSource(ds.DataSource):
    """Options: ``path``; ``kind`` where the suffix doesn't tell it; ``columns``, names with commas between, all if it is missing; ``rowsPerPartition``; for writing ``rowsPerFile``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _files(self) -> list[tuple[str, int]]:
        files = _listed(self.options["path"])
        if not files:
            raise ValueError(f"no point files at {self.options['path']}")
        return files

    def schema(self) -> T.StructType:
        path = self._files()[0][0]
        names = _layout(path, clouds._kind(path, self.options.get("kind")))[0].names
        if "columns" in self.options:
            names = [c.strip() for c in self.options["columns"].split(",")]
        return T.StructType([T.StructField("pid", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def reader(self, schema: T.StructType) -> PointReader:
        return PointReader(self._files(), dict(self.options), [f.name for f in schema.fields])

    def writer(self, schema: T.StructType, overwrite: bool) -> PointWriter:
        return PointWriter(dict(self.options), schema, overwrite)


class PointReader(ds.DataSourceReader):
    """Ranges of records; pid is the file's number, by name, times 2**40 plus the record's place."""

    def __init__(self, files: list[tuple[str, int]], options: dict, names: list[str]):
        self.files, self.options, self.names = files, {k.lower(): v for k, v in options.items()}, names
        self.bounds = {a: (-np.inf, np.inf) for a in XYZ}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            axis = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if axis in self.bounds and isinstance(getattr(f, "value", None), (int, float)):
                low, high = self.bounds[axis]
                if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)):
                    low = max(low, f.value)
                if isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)):
                    high = min(high, f.value)
                self.bounds[axis] = low, high
            yield f  # Spark looks at what is left once more

    def partitions(self) -> list[Range]:
        out = []
        for number, (path, size) in enumerate(self.files):
            kind = clouds._kind(path, self.options.get("kind"))
            layout, box = _layout(path, kind)
            if missing := [c for c in self.names if c != "pid" and c not in layout.names]:
                raise ValueError(f"no column {', '.join(missing)} in {path}; it has {', '.join(layout.names)}")
            # a header's box is rounded to the file's resolution
            if box is not None and any(box[i][1] + clouds.LAS_SCALE < self.bounds[a][0] or box[i][0] - clouds.LAS_SCALE > self.bounds[a][1] for i, a in enumerate(XYZ)):
                continue
            if layout.dtype is None:  # text: a record's place isn't known
                out.append(Range(path, kind, number, 0, None))
                continue
            width = layout.dtype.itemsize
            held = (size - layout.start) // width
            if layout.count is not None and held < layout.count:
                raise ValueError(f"{path} ends after {held} of {layout.count} points")
            many = held if layout.count is None else layout.count
            step = int(self.options.get("rowsperpartition", max(1, PARTITION_BYTES // width)))
            out += [Range(path, kind, number, at, min(at + step, many)) for at in range(0, many, step)]
        return out or [Range("", "", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        wanted = [c for c in self.names if c != "pid"]
        read = list(dict.fromkeys([*wanted, *[a for a in XYZ if self.bounds[a] != (-np.inf, np.inf)]]))
        layout, _ = _layout(partition.path, partition.kind)
        store, at = clouds._store(partition.path)
        with store.open_input_file(at) as file:
            for first, columns in self._records(file, layout, partition, read):
                held = dict(zip(read, columns))
                keep = np.ones(len(columns[0]) if columns else 0, dtype=bool)
                for a, (low, high) in self.bounds.items():
                    if a in held and (low, high) != (-np.inf, np.inf):
                        keep &= (held[a] >= low) & (held[a] <= high)
                pids = (partition.number << 40) + first + np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(pids if c == "pid" else held[c][keep]) for c in self.names], self.names)

    def _records(self, file: pa.NativeFile, layout: clouds.Layout, partition: Range, names: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
        if layout.dtype is None:
            first = 0
            for columns in layout.columns(file.read(), names or XYZ):
                yield first, columns
                first += len(columns[0])
            return
        width = layout.dtype.itemsize
        file.seek(layout.start + partition.first * width)
        for first in range(partition.first, partition.stop, clouds.ROWS):
            many = min(clouds.ROWS, partition.stop - first)
            part = clouds.Layout(layout.names, layout.dtype, 0, many, layout.scaled)
            yield first, next(part.columns(file.read(many * width), names or XYZ))


@dataclass
class Written(ds.WriterCommitMessage):
    """Files of one task: name, rows, and least and largest x, y and z."""

    files: list[tuple[str, int, list[float], list[float]]]


class PointWriter(ds.DataSourceArrowWriter):
    """Files of ``rowsPerFile`` rows at most, moved into the folder when all tasks are done, with an index of their counts and boxes and those of all."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        options = {k.lower(): v for k, v in options.items()}
        self.folder, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("kind", "ply"), overwrite
        if self.kind not in clouds.WRITERS:
            raise ValueError(f"file type {self.kind} isn't known; there are {', '.join(clouds.WRITERS)}")
        self.rows, self.side = int(options.get("rowsperfile", 1_000_000)), f"{self.folder}/_writing-{uuid.uuid4().hex}"
        self.names = [f.name for f in schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name != "pid"]
        if missing := [c for c in XYZ if c not in self.names]:
            raise ValueError(f"points lack {', '.join(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, files, kept, held = TaskContext.get(), [], [], 0

        def flush() -> None:
            nonlocal kept, held
            columns = {c: np.concatenate([k[i] for k in kept]) for i, c in enumerate(self.names)}
            name = f"part-{task.partitionId():06d}-{len(files):04d}-{task.taskAttemptId()}.{self.kind}"
            store, at = clouds._store(f"{self.side}/{name}")
            store.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(at, compression=None) as out:
                out.write(clouds.WRITERS[self.kind](columns))
            files.append((name, held, [float(columns[a].min()) for a in XYZ], [float(columns[a].max()) for a in XYZ]))
            kept, held = [], 0

        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in self.names]
            at = 0
            while at < batch.num_rows:
                many = min(self.rows - held, batch.num_rows - at)
                kept.append([c.slice(at, many).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
                held, at = held + many, at + many
                if held == self.rows:
                    flush()
        if held:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        store, at = clouds._store(self.folder)
        store.create_dir(at, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File] if self.overwrite else []
        _, side = clouds._store(self.side)
        for name, *_ in files:
            store.move(f"{side}/{name}", f"{at}/{name}")
        for path in old:
            store.delete_file(path)
        box = {"least": [min(v) for v in zip(*(f[2] for f in files))], "largest": [max(v) for v in zip(*(f[3] for f in files))]}
        listed = [{"name": n, "rows": r, "least": lo, "largest": hi} for n, r, lo, hi in files]
        with store.open_output_stream(f"{at}/{INDEX}", compression=None) as out:
            out.write(json.dumps({"rows": sum(f[1] for f in files), **box, "files": listed}).encode())
        self._clear(store, side)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*clouds._store(self.side))

    @staticmethod
    def _clear(store: fs.FileSystem, side: str) -> None:
        if store.get_file_info(side).type == fs.FileType.Directory:
            store.delete_dir(side)
