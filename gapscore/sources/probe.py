"""Are stored files readable? Each is opened in a task, and one that cannot be read is a row, not an error."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

PROBED = "path STRING, bytes LONG, rows LONG, names ARRAY<STRING>, error STRING"
_FIELDS = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("rows", pa.int64()), ("names", pa.list_(pa.string())), ("error", pa.string())])


def probe_files(spark: SparkSession, folder: str, column: str | None = None) -> DataFrame:
    """``PROBED`` rows of the parquet files of a folder: rows, the distinct values of ``column``, or what is wrong.

    A whole file is read by its task, so a damaged page is found as well as a damaged footer. A folder that
    is not there has no files. Files of models and dictionaries are small; one beyond 2 GB is an error row of Spark.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, length, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = names = error = None
                try:
                    table = pq.ParquetFile(pa.BufferReader(content)).read()
                    rows = table.num_rows
                    names = sorted({str(v) for v in table.column(column).to_pylist() if v is not None}) if column else []
                except Exception as problem:  # noqa: BLE001 - what a reader would meet is the answer
                    error = f"{type(problem).__name__}: {str(problem).splitlines()[0]}"
                found.append((path, length, rows, names, error))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _FIELDS.types)], schema=_FIELDS)

    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    try:
        listed = reader.load(folder).select("path", "length", "content")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PROBED)
    return listed.mapInArrow(read, PROBED)
