"""Files as sources: JSON exports of records, and folders of documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .tables import exists

RAW = {"confluence": schemas.DOCS, "jira": schemas.TICKETS, "github": schemas.COMMITS, "logs": schemas.LOGS}
EXTENSIONS = (".txt", ".md", ".pdf")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array; an empty table of the schema if it isn't there. ord: the place in the array."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema + ", ord long")
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def read_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The exports that the folder holds, by name; those that are missing are left out."""
    return {name: read_json_array(spark, f"{folder}/{name}.json", schema) for name, schema in RAW.items() if exists(spark, f"{folder}/{name}.json")}


def write_records(records: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace the records at path; what they were made from isn't written."""
    records.drop("raw").write.mode("overwrite").format(form).save(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def _folder(spark: SparkSession, folder: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or not fs.getFileStatus(hadoop).isDirectory():
        raise ValueError(f"{folder} is not a folder")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(folder)
    return files.where(extension(F.col("path")).isin(*EXTENSIONS)).withColumn("filename", base_name(F.col("path")))


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, ord (from 0, by path) of text, Markdown and PDF files below a folder, whatever the case of their
    extension; no contents are read. Raises ValueError for what isn't a folder."""
    # One row a file, as the driver lists them anyway.
    return _folder(spark, folder).select("path", "filename", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("ord"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, content of the files of list_folder that can be read and are short enough for a row.

    Files of one name in two folders share it.
    """
    longest = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1)))
    return _folder(spark, folder).where(F.col("length") <= longest).select("path", "filename", "content")


def from_uploads(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """path, filename, content of files in memory."""
    return spark.createDataFrame([(n, os.path.basename(n), bytearray(b)) for n, b in files], "path string, filename string, content binary")


@F.pandas_udf(T.StringType())
def _pdf_text(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Pages' texts with an empty line between; null where that fails or no reader is installed."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError:
        PdfReader = None

    def one(content: bytes) -> str | None:
        try:
            return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages).strip()
        except Exception:
            return None

    for batch in contents:
        yield batch.map(one, na_action="ignore") if PdfReader else pd.Series([None] * len(batch), dtype=object)


#: A PDF file of fewer characters may be a scan.
LITTLE_TEXT = 50


def with_text(files: DataFrame) -> DataFrame:
    """Files with `text`: UTF-8 with U+FFFD for what isn't; of PDF files the pages' text if a reader is installed and can. `warning` says what
    may be wrong with a PDF file: it couldn't be read as one, or has hardly any text. Null for all others."""
    plain = F.expr("make_valid_utf8(cast(content AS string))")
    is_pdf = extension(F.col("filename")) == ".pdf"
    # Only PDF files pass through Python.
    texts = files.where(~is_pdf | is_pdf.isNull()).withColumns({"text": plain, "warning": F.lit(None).cast("string")})
    pages = files.where(is_pdf).withColumn("pages", _pdf_text("content"))
    warning = F.when(F.col("pages").isNull(), "not read as PDF; its bytes are taken as text").when(F.length("pages") < LITTLE_TEXT, "hardly any text; it may hold pictures of pages")
    pdfs = pages.withColumns({"text": F.coalesce("pages", plain), "warning": warning}).drop("pages")
    return texts.unionByName(pdfs).drop("content")


def file_problems(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, problem of the files of list_folder that read_folder leaves out, and of those that with_text warns of. Reads all contents."""
    whole = read_folder(spark, folder)
    left_out = list_folder(spark, folder).join(whole.select("path"), "path", "left_anti")
    return left_out.select("path", "filename", F.lit("can't be read, or is too long for a row").alias("problem")).unionByName(with_text(whole).where("warning IS NOT NULL").select("path", "filename", F.col("warning").alias("problem")))
