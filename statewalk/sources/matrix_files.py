"""A data source of matrix files, one matrix a file: text (a line for each row) and .npy arrays, in any store that Arrow opens.

Reading, the shape of a .npy file comes from its header and its rows from ranges of bytes, so a long file is many partitions;
text files are dealt to partitions by their size. A matrix of fewer rows than columns has its steps in columns and is turned.
Files that aren't two-dimensional, or have other features than the first usable file, are passed by. A filter on sid prunes
files before any is opened. With the option `shapes` only shapes are read: headers of arrays, and of text its line ends.

Writing, each task streams its rows to files of its own under a folder for the attempt; only the commit of the whole job moves
them to their names, and an abort removes them.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of files that a partition reads, about; a text file isn't divided.
PARTITION_BYTES = 32 << 20
#: Bytes of a text that are looked through at once, and values that a batch of rows holds.
BLOCK, CELLS = 1 << 20, 1 << 18
ROWS, SHAPES = "sid string, name string, t int, y array<double>", "sid string, name string, bytes long, n_dim int, rows long, p long, turned boolean"
SEPARATORS = re.compile(r"[\s,]+")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path within it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def reachable(paths: str | list[str]) -> bool:
    """Whether Arrow opens the store of the paths."""
    try:
        opened(paths if isinstance(paths, str) else paths[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def listed(paths: list[str]) -> list[tuple[str, int]]:
    """Path and size of the files that paths, folders or patterns name, by name."""
    found: dict[str, int] = {}
    for path in paths:
        store, inner = opened(path)
        fixed = re.split(r"[*?\[]", inner, maxsplit=1)[0]
        top = inner if fixed == inner else posixpath.dirname(fixed)
        infos = store.get_file_info(fs.FileSelector(top, recursive=fixed != inner)) if fixed != inner or store.get_file_info(top).type == fs.FileType.Directory else [store.get_file_info(top)]
        for info in infos:
            name = posixpath.basename(info.path)
            if info.type == fs.FileType.File and (fixed == inner or fnmatch.fnmatchcase(info.path, inner)) and not name.startswith((".", "_")):
                found[info.path] = info.size
    return sorted(found.items(), key=lambda x: (posixpath.basename(x[0]), x[0]))


def sid_of(path: str) -> str:
    """What stands before the first underscore of the file's name."""
    return posixpath.basename(path).split("_", 1)[0]


@dataclass
class Shape:
    n_dim: int
    rows: int
    columns: int
    # of an array: where its values begin, their kind, and whether columns follow one another
    start: int = 0
    kind: str = ""
    by_column: bool = False

    @property
    def turned(self) -> bool:
        return self.rows < self.columns

    @property
    def features(self) -> int:
        return min(self.rows, self.columns) if self.n_dim == 2 else -1


def array_header(file) -> Shape:
    """The shape of a .npy file: nothing beyond its header is read."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(file)
    two = len(shape) == 2
    return Shape(len(shape), shape[0] if two else 0, shape[1] if two else 0, file.tell(), kind.str, by_column)


def text_shape(file) -> Shape:
    """Lines that aren't blank, and the numbers in the first of them; the file is read in blocks and no number is parsed."""
    rows, columns, rest = 0, 0, b""
    while True:
        block = file.read(BLOCK)
        lines = (rest + block).split(b"\n")
        rest = lines.pop() if block else b""
        for line in lines:
            if line.strip():
                columns = columns or len(values_of(line.decode()))
                rows += 1
        if not block:
            return Shape(2, rows, columns)


def values_of(line: str) -> list[str]:
    return [x for x in SEPARATORS.split(line.strip()) if x]


def shape_of(store: fs.FileSystem, path: str) -> Shape:
    if path.endswith(".npy"):
        with store.open_input_file(path) as file:
            return array_header(file)
    with store.open_input_stream(path) as file:
        return text_shape(file)


@dataclass
class Part(InputPartition):
    """Files of a partition, and the features that usable ones have; of one array, steps from `first` on, `count` of them."""

    value: int = 0
    files: list[tuple[str, int]] = field(default_factory=list)
    first: int = 0
    count: int = -1
    features: int | None = None


class MatrixReader(DataSourceReader):
    def __init__(self, options, shapes: bool):
        self.paths = options.get("path", "").split("\n")
        self.shapes, self.orient = shapes, options.get("orient", "true").lower() == "true"
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.sids: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            wanted = {f.value} if isinstance(f, (EqualTo, EqualNullSafe)) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("sid",):
                yield f
            else:
                self.sids = wanted if self.sids is None else self.sids & wanted

    def store(self) -> fs.FileSystem:
        return opened(self.paths[0])[0]

    def partitions(self):
        files, store = listed(self.paths), self.store()
        features = None
        if not self.shapes:  # the first usable file of all says how many features there are, whatever is asked for
            features = next((s.features if self.orient else s.columns for s in (shape_of(store, path) for path, _ in files) if s.n_dim == 2 and s.rows), None)
        if self.sids is not None:
            files = [f for f in files if sid_of(f[0]) in self.sids]
        out, some, size = [], [], 0
        for path, length in files:
            if not self.shapes and path.endswith(".npy") and length > self.bytes:
                out += self._ranges(store, path, length)
                continue
            some.append((path, length))
            size += 1 if self.shapes else length
            if size >= (1 << 10 if self.shapes else self.bytes):
                out.append(Part(0, some))
                some, size = [], 0
        out += [Part(0, some)] if some or not out else []
        for part in out:
            part.features = features
        return out

    def _ranges(self, store, path: str, length: int) -> list[Part]:
        """A long array as ranges of steps; one whose steps don't lie together in the file is read as a whole."""
        with store.open_input_file(path) as file:
            shape = array_header(file)
        turned = self.orient and shape.turned
        if shape.n_dim != 2 or not shape.rows or turned != shape.by_column:
            return [Part(0, [(path, length)])]
        steps = shape.columns if turned else shape.rows
        each = max(1, -(-steps * self.bytes // length))
        return [Part(0, [(path, length)], lo, min(each, steps - lo)) for lo in range(0, steps, each)]

    def read(self, partition):
        store = self.store()
        for path, length in partition.files:
            if self.shapes:
                s = shape_of(store, path)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (sid_of(path), posixpath.basename(path))] + [pa.array([length], pa.int64()), pa.array([s.n_dim], pa.int32()), *(pa.array([x], pa.int64()) for x in (s.rows, s.columns)), pa.array([self.orient and s.turned])], ["sid", "name", "bytes", "n_dim", "rows", "p", "turned"])
                continue
            for first, y in self._array(store, path, partition) if path.endswith(".npy") else self._text(store, path):
                if y.shape[1] != partition.features:
                    break
                yield from self._batches(path, first, y)

    def _batches(self, path: str, first: int, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, y.shape[1]))
        for lo in range(0, len(y), step):
            part = y[lo : lo + step]
            n, p = part.shape
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * p, pa.int32()), pa.array(np.ascontiguousarray(part).ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([sid_of(path)] * n), pa.array([posixpath.basename(path)] * n), pa.array(np.arange(first + lo, first + lo + n), pa.int32()), values], ["sid", "name", "t", "y"])

    def _array(self, store, path: str, part: Part) -> Iterator[tuple[int, np.ndarray]]:
        with store.open_input_file(path) as file:
            s = array_header(file)
            if s.n_dim != 2:
                return
            turned, kind = self.orient and s.turned, np.dtype(s.kind)
            steps, p = (s.columns, s.rows) if turned else (s.rows, s.columns)
            if turned != s.by_column:  # a step's values lie apart
                raw = np.frombuffer(file.read_at(s.rows * s.columns * kind.itemsize, s.start), kind).reshape((s.rows, s.columns), order="F" if s.by_column else "C")
                yield 0, (raw.T if turned else raw).astype(np.float64)
                return
            each = max(1, BLOCK // max(1, p * kind.itemsize))
            end = steps if part.count < 0 else part.first + part.count
            for lo in range(part.first, end, each):
                n = min(each, end - lo)
                yield lo, np.frombuffer(file.read_at(n * p * kind.itemsize, s.start + lo * p * kind.itemsize), kind).reshape(n, p).astype(np.float64)

    def _text(self, store, path: str) -> Iterator[tuple[int, np.ndarray]]:
        """A text as a whole: which way it lies shows only at its end."""
        with store.open_input_stream(path) as file:
            lines = [x for line in io.TextIOWrapper(file, encoding="utf-8") if (x := values_of(line))]
        if len({len(x) for x in lines}) > 1:
            raise ValueError(f"lines of different lengths in {path}")
        y = np.array(lines, np.float64).reshape(len(lines), -1 if lines else 0)
        if len(y):
            yield 0, y.T if self.orient and len(y) < y.shape[1] else y


@dataclass
class Written(WriterCommitMessage):
    """Files of an attempt: where they are, and the names they get."""

    files: list[tuple[str, str]]


class MatrixWriter(DataSourceWriter):
    """Rows (name, y), those of a name together and in order, as text of six decimals: a file for each name."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.decimals = int(options.get("decimals", 6))
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        store, top = opened(self.path)
        folder = f"{top}/_temporary-{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        files, name, out = [], None, None
        try:
            for row in iterator:
                if row["name"] != name:
                    if out is not None:
                        out.close()
                    name = row["name"]
                    if not name or "/" in name or name.startswith((".", "_")):
                        raise ValueError(f"not a file's name: {name}")
                    files.append((f"{folder}/{name}", name))
                    out = store.open_output_stream(files[-1][0])
                out.write((" ".join("nan" if v is None else f"{v:.{self.decimals}f}" for v in row["y"]) + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        store, top = opened(self.path)
        if self.overwrite:
            new = {name for m in messages if m for _, name in m.files}
            for path, _ in listed([self.path]):
                if posixpath.basename(path) not in new:
                    store.delete_file(path)
        for m in messages:
            for path, name in m.files if m else ():
                store.move(path, f"{top}/{name}")
        store.delete_dir(f"{top}/_temporary-{self.job}")

    def abort(self, messages):
        store, top = opened(self.path)
        if store.get_file_info(f"{top}/_temporary-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/_temporary-{self.job}")


class MatrixFiles(DataSource):
    """Options: path (files, folders or patterns, one a line), orient (default true), shapes, partitionBytes; writing: decimals."""

    @classmethod
    def name(cls) -> str:
        return "matrix_files"

    def schema(self) -> str:
        return SHAPES if self._shapes() else ROWS

    def _shapes(self) -> bool:
        return self.options.get("shapes", "false").lower() == "true"

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options, self._shapes())

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


def source(spark: SparkSession, paths: str | list[str], **options):
    """A reader of the source; filters on sid reach it."""
    spark.dataSource.register(MatrixFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("matrix_files").options(path="\n".join([paths] if isinstance(paths, str) else paths), **options)


def series(spark: SparkSession, paths: str | list[str], orient: bool = True) -> DataFrame:
    """sid, name, t, y of every usable file."""
    return source(spark, paths, orient=str(orient)).load()


def shapes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """sid, name, bytes, n_dim, rows (steps), p (features), turned: of every file, as they are read."""
    found = source(spark, paths, shapes="true").load()
    return found.withColumns({"rows": F.greatest("rows", "p"), "p": F.least("rows", "p")})


def write(rows: DataFrame, path: str) -> None:
    """rows (name, t, y) as a file for each name, in place of what is there; values are written in the order of t."""
    rows.sparkSession.dataSource.register(MatrixFiles)
    dealt = rows.select("name", "t", "y").repartition("name").sortWithinPartitions("name", "t").select("name", "y")
    dealt.write.format("matrix_files").mode("overwrite").save(path)
