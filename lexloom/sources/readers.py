"""Sources: text lines, delimited files, JSON, zip members and raw matrices, all as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: Mapping[str, str], encoding: str = "utf-8") -> DataFrame:
    """(source, file, text): the lines of each named path (a file, folder or glob).

    UTF-8 is split by the text reader, in parallel within a file. Of other encodings (``cp1252``) each file is decoded
    whole by Arrow batches, undecodable bytes are dropped. A missing path fails when the plan is made.
    """
    parts = []
    for name, path in paths.items():
        if encoding == "utf-8":
            df = spark.read.text(path).select(F.lit(name).alias("source"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        else:
            df = spark.read.format("binaryFile").load(path).select(F.lit(name).alias("source"), F.col("path").alias("file"), "content").mapInArrow(_decoded(encoding), "source string, file string, text string")
        parts.append(df)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _decoded(encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, file, content in zip(*(b.column(i) for i in range(3)), strict=True):
                lines = content.as_py().decode(encoding, "ignore").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()] * len(lines), pa.string()) for x in (source, file)] + [pa.array(lines, pa.string())], names=["source", "file", "text"])

    return run


def inventory(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(source, file, size_mib, modified) of each file."""
    out = None
    for name, path in paths.items():
        meta = spark.read.format("binaryFile").load(path).select(F.lit(name).alias("source"), F.col("path").alias("file"), F.round(F.col("length") / 1048576, 3).alias("size_mib"), F.col("modificationTime").alias("modified"))
        out = meta if out is None else out.unionByName(meta)
    return out


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """A headed CSV or TSV file, bz2 or gzip too; ``columns`` must be there by name."""
    df = spark.read.csv(path, header=True, schema=schema, sep=sep, enforceSchema=False, multiLine=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    missing = set(columns or ()) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_conversations(spark: SparkSession, path: str, keep: DataFrame | None = None) -> DataFrame:
    """(conversation_id, turn, text) of a JSON array of conversations; ``keep`` restricts to its conversation_ids."""
    df = spark.read.schema("conversation_id string, utterances array<struct<text:string>>").json(path, multiLine=True)
    if keep is not None:
        df = df.join(keep.select("conversation_id"), "conversation_id", "left_semi")
    return df.select("conversation_id", F.posexplode("utterances").alias("turn", "u")).select("conversation_id", "turn", F.col("u.text").alias("text"))


def read_zip_lines(spark: SparkSession, path: str, member: str, encoding: str = "utf-8") -> DataFrame:
    """(file, text): lines of the members whose names end in ``member``, streamed out of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if not name.endswith(member):
                            continue
                        lines: list[str] = []
                        with io.TextIOWrapper(z.open(name), encoding, "replace") as f:
                            for line in f:
                                lines.append(line.rstrip("\r\n"))
                                if len(lines) == 10_000:
                                    yield pa.RecordBatch.from_pydict({"file": [file.as_py()] * len(lines), "text": lines})
                                    lines = []
                        if lines:
                            yield pa.RecordBatch.from_pydict({"file": [file.as_py()] * len(lines), "text": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, text string")


def read_matrix(spark: SparkSession, path: str, width: int, dtype: str = "float32") -> DataFrame:
    """(file, row, vector) of raw little-endian matrices of ``width`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                m = np.frombuffer(content.as_py(), dtype).reshape(-1, width).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, width, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(m), pa.string()), pa.array(np.arange(len(m))), vectors], names=["file", "row", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row bigint, vector array<float>")
