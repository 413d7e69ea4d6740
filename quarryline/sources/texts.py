"""Text files whose encoding isn't known: UTF-8, else GB18030."""

from __future__ import annotations

import codecs
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.scratch import scratch_path


def first_look(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, utf8, quoted_lines): the first line of each file, whether all its lines are
    UTF-8, and whether one holds an odd number of quotes, as where a quoted field goes on.  Files are
    read in splits, so they may have any size."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "_metadata.file_block_start", "value", F.monotonically_increasing_id().alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    first = F.min_by(F.regexp_replace("value", "^\ufeff", ""), F.struct("file_block_start", "at"))
    return lines.groupBy("file").agg(first.alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("quoted_lines"))


def decodable(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding): the first of UTF-8 and GB18030 that each file's bytes decode in, null for
    neither.  A file is decoded piece by piece on the executor that reads it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(1):
                raw, name = x.as_buffer().to_pybytes(), None
                for encoding in ("utf-8-sig", "gb18030"):
                    try:
                        decoder = codecs.getincrementaldecoder(encoding)()
                        for at in range(0, len(raw), 1 << 20):
                            decoder.decode(raw[at : at + (1 << 20)])
                        decoder.decode(b"", True)
                        name = encoding
                        break
                    except UnicodeDecodeError:
                        continue
                found.append(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "encoding"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, "path string, encoding string")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, text): the files below a folder, each a whole text in the first encoding of
    :func:`decodable` that its bytes are; the text is null where there is none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if e is None else x.as_py().decode(e) for x, e in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], ["path", "encoding", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.join(decodable(spark, path), "path").select("path", "content", "encoding").mapInArrow(run, "path string, encoding string, text string")


def in_utf8(spark: SparkSession, path: str) -> str:
    """The files below a folder, in the shared folder and in UTF-8, one for each; where they are in
    UTF-8 already, the folder itself.  A file that is neither is an error.  Files in UTF-8 may have any
    size; one that has to be decoded, 2 GB at most."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    if lines.where(~F.is_valid_utf8("value")).isEmpty():
        return path
    found = {r["encoding"] for r in decodable(spark, path).select("encoding").distinct().collect()}  # three at most
    if None in found:
        raise ValueError(f"{path} is neither UTF-8 nor GB18030")
    if "gb18030" not in found:
        return path
    out = f"{scratch_path(spark)}/utf8-{uuid.uuid4().hex}"
    # a folder for each file, so that none goes on behind another one's end
    text_files(spark, path).select(F.substring_index("path", "/", -1).alias("file"), "text").write.partitionBy("file").text(out)
    return out
