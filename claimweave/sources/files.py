"""Files of a folder, and what their names and document properties say."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.text import title_from_filename
from ..operators.segmentation import strip


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """source_path, title, size, modified of the files below folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("source_path"), title_from_filename("path").alias("title"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def items_of_json(content: bytes) -> Iterator[tuple[int, float, str, float, float, float, float]]:
    """Items of a file {"pages": [{"height": h, "items": [{"str", "x", "y", "width", "height"}, ...]}, ...]}; pages count from 1."""
    for number, page in enumerate(json.loads(content)["pages"], 1):
        for item in page["items"]:
            yield number, float(page["height"]), item["str"], *(float(item[k]) for k in ("x", "y", "width", "height"))


def laid_out(spark: SparkSession, folder: str, pattern: str = "*.json", decode: Callable[[bytes], Iterator[tuple]] = items_of_json, rows: int = 10_000) -> DataFrame:
    """The positioned items of the files below folder: document_id (the path), page, page_height, str, x, y, width, height.

    Spark lists and reads the files, from any file system it knows; decode turns one file's bytes into tuples of
    (page, page_height, str, x, y, width, height), so that another decoder reads another format. Items leave a task in
    batches of rows, page after page: a task holds one file's bytes. A file that decode refuses is the reader's error.
    layout_pages makes pages of the result; a file without items has none.
    """
    names = ["document_id", "page", "page_height", "str", "x", "y", "width", "height"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int32(), pa.float64(), pa.string(), *[pa.float64()] * 4])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        full = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for item in decode(content.as_py()):
                    found.append((path.as_py(), *item))
                    if len(found) == rows:
                        yield full()
                        found = []
        if found:
            yield full()

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(run, "document_id string, page int, page_height double, str string, x double, y double, width double, height double")


def metadata(title: Column | str, created: Column | str) -> Column:
    """struct<title, published_at>: the title if it isn't blank, and the day of a date property such as D:20240517103000."""
    day = lambda k: F.nullif(F.regexp_extract(col(created), r"D:(\d{4})(\d{2})(\d{2})", k), F.lit(""))
    return F.struct(F.nullif(strip(title), F.lit("")).alias("title"), F.when(day(1).isNotNull(), F.concat_ws("-", day(1), day(2), day(3))).alias("published_at"))
