"""Reading and writing documents, chunks, graphs and vector indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """doc_id (the file's name without suffix), path, text: a row for each file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}").select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("doc_id"), "path", "text")


def read_uploads(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """doc_id, path, length, content of files that aren't empty; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).filter("length > 0")
    return files.select(F.md5("path").alias("doc_id"), "path", "length", "modificationTime", "content")


def write_files(rows: DataFrame, folder: str, suffix: str = ".pdf") -> None:
    """A file in folder for each row (name, content) with a name of the suffix and some content; others are refused.

    Tasks write through pyarrow.fs, under a name of their own that becomes the file's when it is whole, so
    a repeated task is harmless.
    """
    import uuid

    import pandas as pd

    def each(batches):
        from pyarrow import fs

        to, path = fs.FileSystem.from_uri(folder)
        to.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                part = f"{path}/.{uuid.uuid4().hex}"
                with to.open_output_stream(part) as out:
                    out.write(bytes(content))
                to.move(part, f"{path}/{name}")
            yield pd.DataFrame({"n": [len(batch)]})

    sound = F.lower("name").endswith(suffix) & ~F.col("name").contains("/") & (F.length("content") > 0)
    rows.filter(sound).select("name", "content").mapInPandas(each, "n long").agg(F.sum("n")).collect()


def read_pages(uploads: DataFrame) -> DataFrame:
    """doc_id, page, text, ocr_text of PDF uploads, where PyMuPDF is installed on the workers."""
    import pandas as pd

    def each(batches):
        import fitz

        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                with fitz.open(stream=bytes(content), filetype="pdf") as pdf:
                    rows += [(doc_id, n + 1, page.get_text("text"), None) for n, page in enumerate(pdf)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "ocr_text"])

    return uploads.select("doc_id", "content").mapInPandas(each, "doc_id string, page int, text string, ocr_text string")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=True)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A JSON object a line, in as many files as there are partitions; nulls are kept as fields."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_index(records: DataFrame, path: str) -> None:
    """Embedding records with vectors as 32-bit floats."""
    records.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A vector index; ValueError if it has no rows or vectors of different lengths."""
    index = spark.read.parquet(path)
    size = index.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("z")).first()
    if not size["n"] or size["a"] != size["z"]:
        raise ValueError(f"not a sound index: {size['n']} rows, vectors of {size['a']} to {size['z']} numbers")
    return index


def stale_outputs(spark: SparkSession, paths: list[str], current: str) -> DataFrame:
    """path, run_id, length of files of other runs (32 hex digits lead their names); nothing is deleted."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    run = F.regexp_extract("path", r"/([0-9a-fA-F]{32})[^/]*$", 1)
    return files.select("path", run.alias("run_id"), "length").filter((F.col("run_id") != "") & (F.lower("run_id") != current.lower()))


def retention(spark: SparkSession, paths: list[str], current: str) -> DataFrame:
    """stale, n, length: how many files of other runs there are, and how many are kept."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    run = F.regexp_extract("path", r"/([0-9a-fA-F]{32})[^/]*$", 1)
    return files.groupBy(((run != "") & (F.lower(run) != current.lower())).alias("stale")).agg(F.count("*").alias("n"), F.sum("length").alias("length"))
