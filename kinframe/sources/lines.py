"""Text sources: outline files, PDF pages, file discovery."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.functions.text import file_slug

LINES = "src string, pos long, line string"


def split_lines(files: DataFrame, text: str = "value") -> DataFrame:
    """(src, text) to (src, pos, line); order is made explicit by pos."""
    rows = files.select("src", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line"))
    return rows.select("src", F.col("pos").cast("long").alias("pos"), "line")


def read_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Whole text files with their paths: (src, value)."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("src"), "value")


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Whole text files below a folder with their paths: (src, value); no list of paths is made."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return files.text(folder, wholetext=True).select(F.input_file_name().alias("src"), "value")


def write_files(rows: DataFrame, by: str, folder: str) -> None:
    """Text files (value), one folder for each value of ``by``, in a new folder.

    Each task puts its own files in place: the plain committer leaves that to the driver, one after another.
    """
    rows.write.partitionBy(by).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)


def read_outline_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of outline text files."""
    return split_lines(read_text(spark, paths))


def _pdf_text(content: bytes) -> list[str]:
    try:
        import pdfplumber
    except ImportError as missing:
        raise ImportError("reading PDF outlines needs pdfplumber, or pass another extract function") from missing
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [line for page in pdf.pages for line in (page.extract_text() or "").splitlines()]


def read_outline_pdf(spark: SparkSession, paths: str | Sequence[str], extract: Callable[[bytes], list[str]] = _pdf_text) -> DataFrame:
    """Lines of PDF outlines, one file at a time in Arrow batches; ``extract`` gives a file's lines."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = extract(content)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["src", "pos", "line"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, LINES)


def read_outline(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of outlines, by suffix: PDF or text."""
    pdf = [p for p in paths if p.lower().endswith(".pdf")]
    rest = [p for p in paths if p not in pdf]
    parts = ([read_outline_text(spark, rest)] if rest else []) + ([read_outline_pdf(spark, pdf)] if pdf else [])
    if not parts:
        return spark.createDataFrame([], LINES)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def discover(spark: SparkSession, folder: str, pattern: str = "*.{pdf,txt}", done: DataFrame | None = None) -> DataFrame:
    """(path, modified, length, expected) of source files, less those in the manifest ``done`` (path)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    found = files.select("path", F.col("modificationTime").alias("modified"), "length", file_slug(F.col("path")).alias("expected"))
    return found if done is None else found.join(done.select("path"), "path", "left_anti")
