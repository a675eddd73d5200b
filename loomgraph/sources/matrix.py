"""Vector matrices in NumPy's format with JSON metadata beside them, as a Python data source.

The source reads the headers of the .npy files when the query is planned and deals ranges of rows to tasks; a
task seeks to its rows and reads no others. Files are opened with pyarrow.fs, by path or URI. A vector is told by
its file (`part`, the name without .npy) and its place in it (`at`, from 0).

Refused with a ValueError: what isn't a matrix of 32-bit floats in rows, files whose vectors differ in length,
an index without vectors, and metadata that isn't exactly one record for each vector.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 65_536
NAME = "vector_matrix"
BLOCK = 1024


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def matrices(path: str) -> list[tuple[str, str]]:
    """(name without ending, path) of a .npy file, or of all in a folder, by name."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        found = [at]
    else:
        found = sorted(x.path for x in system.get_file_info(fs.FileSelector(at)) if x.path.endswith(".npy"))
    return [(x.rsplit("/", 1)[-1].removesuffix(".npy"), x) for x in found]


def header(system: fs.FileSystem, path: str) -> tuple[int, int, int]:
    """(rows, columns, where the numbers begin) of a matrix."""
    with system.open_input_file(path) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, kind = read(f)
        if len(shape) != 2 or kind != np.dtype("<f4") or (fortran and min(shape) > 1):
            raise ValueError(f"{path}: not a matrix of 32-bit floats in rows: {kind}, {shape}")
        return shape[0], shape[1], f.tell()


class Rows(InputPartition):
    def __init__(self, part: str, path: str, first: int, last: int, columns: int, start: int):
        self.part, self.path, self.first, self.last, self.columns, self.start = part, path, first, last, columns, start


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))

    def partitions(self) -> list[Rows]:
        system, _ = opened(self.path)
        heads = [(part, path, *header(system, path)) for part, path in matrices(self.path)]
        if len({columns for _, _, n, columns, _ in heads if n}) > 1:
            raise ValueError(f"{self.path}: vectors of different lengths")
        if not sum(n for _, _, n, _, _ in heads):
            raise ValueError(f"{self.path}: no vectors")
        return [Rows(part, path, a, min(a + self.rows, n), columns, start) for part, path, n, columns, start in heads for a in range(0, n, self.rows)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as f:
            for a in range(partition.first, partition.last, BLOCK):
                n = min(BLOCK, partition.last - a)
                f.seek(partition.start + a * partition.columns * 4)
                flat = np.frombuffer(f.read(n * partition.columns * 4), "<f4")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, partition.columns, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([partition.part] * n), pa.array(np.arange(a, a + n)), vectors], ["part", "at", "embedding"])


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "part string, at long, embedding array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)


def read_vectors(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """part, at, embedding of a .npy file or of those in a folder; at most `rows` of one file in a task."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format(NAME).option("rows", rows).load(path)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """part, at and the fields of schema: JSON Lines with fields part and at, or one JSON array (.json) in the order of a matrix of its name."""
    if not path.endswith(".json"):
        return spark.read.schema(f"part string, at long, {schema}").json(path)
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("at", "x"))
    part = path.rsplit("/", 1)[-1].removesuffix(".json")
    return whole.select(F.lit(part).alias("part"), F.col("at").cast("long").alias("at"), "x.*")


def read_index(spark: SparkSession, vectors: str, metadata: str, schema: str, rows: int = ROWS) -> DataFrame:
    """part, at, embedding and the metadata's fields; ValueError if vectors and records don't match one to one."""
    index, about = read_vectors(spark, vectors, rows), read_metadata(spark, metadata, schema)
    met = index.select("part", "at", F.lit(1).alias("v")).join(about.select("part", "at", F.lit(1).alias("m")), ["part", "at"], "full").agg(F.count("*"), F.count("v"), F.count("m")).first()
    if len(set(met)) != 1:
        raise ValueError(f"not a sound index: {met[1]} vectors, {met[2]} records, {met[0]} of both")
    return index.join(about, ["part", "at"])


def write_index(records: DataFrame, folder: str) -> None:
    """records (embedding, other fields) as a matrix and a file of JSON Lines for each partition, under vectors/ and metadata/."""
    names = [c for c in records.columns if c != "embedding"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(folder)
        part, n, columns = f"part-{TaskContext.get().partitionId():05d}", 0, None
        for kind in ("vectors", "metadata"):
            system.create_dir(f"{at}/{kind}", recursive=True)
        raw = f"{at}/vectors/{part}.raw"
        with system.open_output_stream(raw) as numbers, system.open_output_stream(f"{at}/metadata/{part}.jsonl") as lines:
            for batch in batches:
                for v, *about in zip(*(batch.column(c).to_pylist() for c in ("embedding", *names)), strict=True):
                    if columns not in (None, len(v)):
                        raise ValueError(f"vectors of {columns} and {len(v)} numbers")
                    columns = len(v)
                    numbers.write(np.array(v, "<f4").tobytes())
                    lines.write(json.dumps({"part": part, "at": n, **dict(zip(names, about, strict=True))}, default=str).encode() + b"\n")
                    n += 1
        # The header tells the number of rows, so the numbers, written as they came, follow it at the end.
        with system.open_output_stream(f"{at}/vectors/{part}.npy") as f, system.open_input_file(raw) as numbers:
            np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (n, columns or 0)})
            while some := numbers.read(1 << 20):
                f.write(some)
        system.delete_file(raw)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n])], ["part", "n"])

    records.mapInArrow(each, "part string, n long").write.format("noop").mode("overwrite").save()
