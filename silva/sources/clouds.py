"""Point-cloud files: PLY, PCD and LAS in and out, text out.

Files are read by Spark's ``binaryFile`` reader, so any store that Spark reaches works; a file is one
task's work and may have up to 2 GB, larger scans come as several files. Files are written by the tasks
that hold the rows, at most ``rows_per_file`` rows each, so no task gathers more than that.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

XYZ = ["x", "y", "z"]
RGB = ["red", "green", "blue"]
#: Bytes that a header must fit in when only the column names are asked for.
HEADER_BYTES = 1 << 16
#: Rows that a reader hands to Spark at a time.
ROWS = 100_000
#: Resolution of coordinates in LAS files.
LAS_SCALE = 0.001

# Type names of PLY properties.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
# Record lengths of LAS point formats 0 to 10, places of their colours, types of extra bytes from 1 on.
LAS_LENGTHS = [20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67]
LAS_COLOURS = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
LAS_EXTRA_TYPES = ["u1", "i1", "u2", "i2", "u4", "i4", "u8", "i8", "f4", "f8"]
LAS_HEADER = "<4sHHIHH8sBB32s32sHHHIIBHI5I12dQQIQ15Q"


class Layout:
    """How one file holds its points: names, a numpy record type (None: text), where points start, how many, and how to scale."""

    def __init__(self, names: list[str], dtype: np.dtype | None, start: int, count: int | None, scaled: dict[str, tuple[float, float]] | None = None):
        self.names, self.dtype, self.start, self.count, self.scaled = names, dtype, start, count, scaled or {}

    def rows(self, content: bytes) -> int:
        held = (len(content) - self.start) // self.dtype.itemsize
        if self.count is not None and held < self.count:
            raise ValueError(f"the file ends after {held} of {self.count} points")
        return held if self.count is None else self.count

    def columns(self, content: bytes, wanted: list[str]) -> Iterator[list[np.ndarray]]:
        """The wanted columns as doubles, ROWS rows at a time."""
        if missing := [c for c in wanted if c not in self.names]:
            raise ValueError(f"no column {', '.join(missing)} in the file; it has {', '.join(self.names)}")
        if self.dtype is None:
            table = np.array(content[self.start :].split(), dtype="f8").reshape(-1, len(self.names))[: self.count]
            for at in range(0, len(table), ROWS):
                yield [table[at : at + ROWS, self.names.index(c)] for c in wanted]
            return
        records = np.frombuffer(content, dtype=self.dtype, offset=self.start, count=self.rows(content))
        for at in range(0, len(records), ROWS):
            part = records[at : at + ROWS]
            yield [part[c].astype("f8") * self.scaled[c][0] + self.scaled[c][1] if c in self.scaled else part[c].astype("f8") for c in wanted]


def _header(content: bytes, last: bytes) -> tuple[list[list[str]], int]:
    """The words of each header line up to the one that starts with ``last``, and where the next line begins."""
    found = re.search(rb"^" + last + rb"[^\n]*\n", content, re.MULTILINE)
    if found is None:
        raise ValueError(f"no line {last.decode()} in the header")
    return [line.split() for line in content[: found.end()].decode("latin-1").splitlines()], found.end()


def ply_layout(content: bytes) -> Layout:
    """Vertices of an ascii or binary little-endian PLY file; meshes and list properties raise ValueError."""
    lines, start = _header(content, b"end_header")
    count, kind, properties = None, "", []
    for words in filter(None, lines):
        if words[0] == "format":
            kind = words[1]
        elif words[0] == "element" and words[1] == "vertex":
            count = int(words[2])
        elif words[0] == "element":
            raise ValueError("the PLY file holds more than vertices; meshes aren't point clouds")
        elif words[0] == "property":
            if words[1] not in PLY_TYPES:
                raise ValueError(f"PLY property type {words[1]} isn't supported")
            properties.append((words[2], "<" + PLY_TYPES[words[1]]))
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"PLY format {kind} isn't supported")
    return Layout([n for n, _ in properties], None if kind == "ascii" else np.dtype(properties), start, count)


def pcd_layout(content: bytes) -> Layout:
    """Points of an ascii or binary PCD file; compressed ones raise ValueError. Fields without SIZE and TYPE are float32."""
    lines, start = _header(content, b"DATA")
    head = {words[0]: words[1:] for words in lines if words}
    names, count, kind = head["FIELDS"], int(head["WIDTH"][0]) * int(head.get("HEIGHT", ["1"])[0]), head["DATA"][0]
    if kind not in ("ascii", "binary"):
        raise ValueError(f"PCD data of kind {kind} isn't supported")
    types = [f"<{t.lower()}{s}" for t, s in zip(head.get("TYPE", ["f"] * len(names)), head.get("SIZE", ["4"] * len(names)))]
    return Layout(names, None if kind == "ascii" else np.dtype(list(zip(names, types))), start, count)


def las_layout(content: bytes) -> Layout:
    """x, y, z, intensity, colours and extra dimensions of a LAS file of version 1.2 to 1.4; compressed ones raise ValueError."""
    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor, (size, start, vlrs, kind, length, count) = content[25], struct.unpack_from("<HIIBHI", content, 94)
    if kind >= len(LAS_LENGTHS):
        raise ValueError(f"LAS point format {kind} isn't supported (compressed files aren't)")
    if minor >= 4:
        count = struct.unpack_from("<Q", content, 247)[0]
    scales, offsets = struct.unpack_from("<3d", content, 131), struct.unpack_from("<3d", content, 155)
    fields = [(c, "<i4", 4 * i) for i, c in enumerate(XYZ)] + [("intensity", "<u2", 12)]
    fields += [(c, "<u2", LAS_COLOURS[kind] + 2 * i) for i, c in enumerate(RGB) if kind in LAS_COLOURS]
    scaled = {c: (scales[i], offsets[i]) for i, c in enumerate(XYZ)}
    at, place = size, LAS_LENGTHS[kind]
    for _ in range(vlrs):
        user, record, held = struct.unpack_from("<16sHH", content, at + 2)
        if user.rstrip(b"\0") == b"LASF_Spec" and record == 4:
            for k in range(at + 54, at + 54 + held, 192):
                code, options = content[k + 2], content[k + 3]
                if not 1 <= code <= len(LAS_EXTRA_TYPES):
                    place += options if code == 0 else 0
                    continue
                name = content[k + 4 : k + 36].split(b"\0")[0].decode("utf-8", "replace")
                fields.append((name, "<" + LAS_EXTRA_TYPES[code - 1], place))
                place += np.dtype(LAS_EXTRA_TYPES[code - 1]).itemsize
                if options & 24:
                    scaled[name] = (struct.unpack_from("<d", content, k + 112)[0] if options & 8 else 1.0, struct.unpack_from("<d", content, k + 136)[0] if options & 16 else 0.0)
        at += 54 + held
    names, formats, places = zip(*fields)
    return Layout(list(names), np.dtype({"names": names, "formats": formats, "offsets": places, "itemsize": length}), start, count, scaled)


LAYOUTS = {"ply": ply_layout, "pcd": pcd_layout, "las": las_layout}


def _kind(path: str, kind: str | None = None) -> str:
    found = kind or path.rsplit(".", 1)[-1].lower()
    if found not in LAYOUTS:
        raise ValueError(f"file type {found} isn't known; there are {', '.join(LAYOUTS)}")
    return found


def column_names(spark: SparkSession, path: str, kind: str | None = None) -> list[str]:
    """Names of the columns of one file; only its header reaches the driver."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, HEADER_BYTES)).first()
    return LAYOUTS[_kind(path, kind)](bytes(head[0])).names


def read_points(spark: SparkSession, path: str, extra: list[str] = (), kind: str | None = None) -> DataFrame:
    """Points of a file or of all files that a pattern matches: pid, x, y, z and the ``extra`` columns, all doubles but pid.

    The type follows the suffix, or ``kind``. Files count in the order of their names; pid is a file's number
    times 2**40 plus the row in it, so the rows of a single file count from 0. No points: no rows. A column that
    a file lacks, and an unknown type, raise ValueError.
    """
    layout, wanted = LAYOUTS[_kind(path, kind)], [*XYZ, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held, at = content.as_py(), 0
                for columns in layout(held).columns(held, wanted):
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n), pa.array(np.arange(at, at + n)), *map(pa.array, columns)], ["file", "row", *wanted])
                    at += n

    files = spark.read.format("binaryFile").load(path)
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in wanted]])
    points = files.select("path", "content").mapInArrow(run, schema)
    number = files.select(F.col("path").alias("file"), (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("_file"))  # one row a file, contents aren't read
    return points.join(number, "file").select((F.col("_file") * (1 << 40) + F.col("row")).alias("pid"), *wanted)


def _ply(columns: dict[str, np.ndarray]) -> bytes:
    """A binary PLY file: coordinates and others as doubles, colours as ints."""
    names = [*XYZ, *[c for c in RGB if c in columns], *[c for c in columns if c not in XYZ + RGB]]
    types = [(c, "<i4" if c in RGB else "<f8") for c in names]
    records = np.zeros(len(columns["x"]), dtype=types)
    for c in names:
        records[c] = columns[c]
    listed = "".join(f"property {'int' if t == '<i4' else 'float64'} {c}\n" for c, t in types)
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {len(records)}\n{listed}end_header\n".encode() + records.tobytes()


def _pcd(columns: dict[str, np.ndarray]) -> bytes:
    """A binary PCD file of float32 x, y, z and, where there is one, intensity."""
    names = [*XYZ, *[c for c in columns if c == "intensity"]]
    n, k = len(columns["x"]), len(names)
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(names)}\nSIZE{' 4' * k}\nTYPE{' F' * k}\nCOUNT{' 1' * k}\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    return head.encode() + np.column_stack([columns[c] for c in names]).astype("<f4").tobytes()


def _las(columns: dict[str, np.ndarray]) -> bytes:
    """A LAS 1.4 file of point format 7: offsets are the least coordinates, colours are native, others extra doubles."""
    extra = [c for c in columns if c not in XYZ + RGB]
    xyz = np.column_stack([columns[c] for c in XYZ])
    if not np.isfinite(xyz).all():
        raise ValueError("LAS holds no null or infinite coordinates")
    low, high = xyz.min(axis=0), xyz.max(axis=0)
    whole = np.rint((xyz - low) / LAS_SCALE)
    if whole.max() > np.iinfo(np.int32).max:
        raise ValueError("the points of one LAS file lie too far apart")
    colours = [c for c in RGB if c in columns]
    names = [*XYZ, "returns", *colours, *extra]
    formats = ["<i4"] * 3 + ["u1"] + ["<u2"] * len(colours) + ["<f8"] * len(extra)
    places = [0, 4, 8, 14, *[LAS_COLOURS[7] + 2 * RGB.index(c) for c in colours], *[LAS_LENGTHS[7] + 8 * i for i in range(len(extra))]]
    length = LAS_LENGTHS[7] + 8 * len(extra)
    records = np.zeros(len(xyz), dtype=np.dtype({"names": names, "formats": formats, "offsets": places, "itemsize": length}))
    records["returns"] = 0x11  # the first return of one
    for i, c in enumerate(XYZ):
        records[c] = whole[:, i]
    for c in colours + extra:
        records[c] = columns[c]
    told = b"".join(struct.pack("<HBB32s", 0, 10, 0, c.encode()[:32]) + bytes(156) for c in extra)
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(told), b"") + told if extra else b""
    size, n = struct.calcsize(LAS_HEADER), len(records)
    box = [v for pair in zip(high, low) for v in pair]
    head = struct.pack(LAS_HEADER, b"LASF", 0, 16, 0, 0, 0, bytes(8), 1, 4, b"", b"", 1, 2000, size, size + len(vlr), int(bool(extra)), 7, length, 0, *[0] * 5, *[LAS_SCALE] * 3, *low, *box, 0, 0, 0, n, n, *[0] * 14)
    return head + vlr + records.tobytes()


WRITERS = {"ply": _ply, "pcd": _pcd, "las": _las}


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_points(points: DataFrame, folder: str, kind: str, rows_per_file: int = 1_000_000) -> list[str]:
    """Write ``points`` (x, y, z and others) to ``folder``, which all executors reach, and tell the files' names.

    ``kind`` is ply, pcd, las or csv. Columns that aren't numbers or booleans are left out of all but csv, which has no
    header and blanks between values. Null numbers become NaN; LAS takes neither null coordinates nor null colours
    (ValueError). A partition makes one file for each ``rows_per_file`` rows, none if it is empty. Files of tasks that
    were run again aren't in the list, and are deleted.
    """
    if kind == "csv":
        points.write.option("sep", " ").option("header", False).csv(folder)
        return []
    if kind not in WRITERS:
        raise ValueError(f"file type {kind} isn't known; there are csv, {', '.join(WRITERS)}")
    encode = WRITERS[kind]
    names = [f.name for f in points.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if missing := [c for c in XYZ if c not in names]:
        raise ValueError(f"points lack {', '.join(missing)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, kept, held = TaskContext.get(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, kept, held
            columns = {c: np.concatenate([b[i] for b in kept]) for i, c in enumerate(names)}
            uri = f"{folder}/part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.{kind}"
            store, path = _store(uri)
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path, compression=None) as out:
                out.write(encode(columns))
            number, kept, held = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([uri])], ["file"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows_per_file - held)
                kept.append([part.column(i).to_numpy(zero_copy_only=False).astype("f8") for i in range(len(names))])
                held, at = held + part.num_rows, at + part.num_rows
                if held == rows_per_file:
                    yield flush()
        if held:
            yield flush()

    written = sorted(r.file for r in points.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, "file string").collect())  # a name for each file
    store, path = _store(folder)
    if written:
        good = {f.rsplit("/", 1)[-1] for f in written}
        for found in store.get_file_info(fs.FileSelector(path)):
            if found.base_name.startswith("part-") and found.base_name.endswith(f".{kind}") and found.base_name not in good:
                store.delete_file(found.path)
    return written
