"""Readers and writers of market files; bad values become null, missing columns raise."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Header and name of each column of a daily price file, with its type (fixed values).
PRICE_COLUMNS = (
    ("TradDt", "trade_date", "date"), ("BizDt", "business_date", "date"), ("Sgmt", "segment", "string"), ("Src", "source", "string"),
    ("FinInstrmTp", "instrument_type", "string"), ("FinInstrmId", "instrument_id", "long"), ("ISIN", "isin", "string"), ("TckrSymb", "symbol", "string"),
    ("SctySrs", "series", "string"), ("OpnPric", "open", "double"), ("HghPric", "high", "double"), ("LwPric", "low", "double"),
    ("ClsPric", "close", "double"), ("LastPric", "last_price", "double"), ("PrvsClsgPric", "previous_close", "double"),
    ("TtlTradgVol", "volume", "long"), ("TtlTrfVal", "turnover", "double"), ("FinInstrmNm", "instrument_name", "string"),
)


def read_prices(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Daily price files as typed rows; all values are read as text first, so no value can fail the scan."""
    raw = spark.read.option("recursiveFileLookup", "true").csv(path, header=True, encoding=encoding, inferSchema=False)
    return typed_prices(raw)


def typed_prices(raw: DataFrame) -> DataFrame:
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    missing = [h for h, _, _ in PRICE_COLUMNS if h not in names]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    as_type = {"date": T.parsed_date, "long": T.safe_long, "double": T.safe_double, "string": lambda c: F.nullif(F.trim(c), F.lit(""))}
    return raw.select(*[as_type[kind](F.col(f"`{names[h]}`")).alias(n) for h, n, kind in PRICE_COLUMNS])


def valid_prices(prices: DataFrame, segment: str = "CM", kind: str = "STK") -> DataFrame:
    """Cash-market stocks with a date, a symbol and positive prices."""
    return prices.filter((F.col("segment") == segment) & (F.col("instrument_type") == kind)).filter("trade_date IS NOT NULL AND symbol IS NOT NULL AND high > 0 AND low > 0 AND close > 0")


def _members(path: str, content: bytes) -> Iterator[bytes]:
    """The CSV of a file: itself, or of an archive the member with the shallowest and then shortest path."""
    if not path.lower().endswith(".zip"):
        yield content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        inside = [n for n in archive.namelist() if n.lower().endswith(".csv")]
        if inside:
            yield archive.read(min(inside, key=lambda n: (n.count("/"), len(n), n)))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The price columns of each file by its own header; a missing one raises, and bytes that are not UTF-8 are cp1252."""
    heads = [h for h, _, _ in PRICE_COLUMNS]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            for data in _members(path, content.as_py()):
                try:
                    text = data.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = data.decode("cp1252", "replace")
                reader = csv.DictReader(io.StringIO(text, newline=""))
                names = {(c or "").strip(): c for c in reader.fieldnames or []}
                if missing := [h for h in heads if h not in names]:
                    raise ValueError(f"columns are missing in {path}: {missing}")
                rows = list(reader)
                yield pa.RecordBatch.from_arrays([pa.array([r[names[h]] for r in rows], pa.string()) for h in heads], names=heads)


def read_price_files(spark: SparkSession, path: str, glob: str = "*.{csv,CSV,zip,ZIP}") -> DataFrame:
    """All price files below a folder, plain and zipped, by their own headers. A file is one task's work, as daily files are small."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return typed_prices(files.mapInArrow(_parsed, ", ".join(f"`{h}` string" for h, _, _ in PRICE_COLUMNS)))


def read_zipped_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price files in ZIP archives: of each archive the CSV with the shallowest and then shortest path."""
    return read_price_files(spark, path, "*.zip")


def newest_file(spark: SparkSession, path: str, glob: str = "*.csv") -> str | None:
    """The path of the file that was written last; of several the greatest path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()["path"]


def read_corporate_actions(spark: SparkSession, path: str) -> DataFrame:
    """The ``data`` array of corporate-action documents, a dash meaning null, dates parsed; no record at all raises."""
    fields = ("symbol", "series", "isin", "comp", "subject", "faceVal", "ind", "exDate", "recDate", "bcStartDate", "bcEndDate", "ndStartDate", "ndEndDate", "caBroadcastDate")
    item = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
    rows = spark.read.schema(f"data array<{item}>").json(path, multiLine=True).select(F.explode("data").alias("d")).select("d.*")
    if rows.isEmpty():
        raise ValueError("the corporate-action file holds no record")
    bare = lambda c: F.nullif(F.nullif(F.trim(F.col(c)), F.lit("-")), F.lit(""))
    return rows.select(*[(T.parsed_date(bare(f), ("dd-MMM-yyyy", "yyyy-MM-dd")) if f.endswith("Date") else bare(f)).alias(f) for f in fields])


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """exchange, feed_category and the record of every item of a nested news document."""
    record = "struct<title:string,description:string,published:string,source_url:string,feed_url:string,feed_index:int>"
    rows = spark.read.schema(f"exchanges map<string, map<string, struct<records:array<{record}>>>>").json(path, multiLine=True)
    rows = rows.select(F.explode("exchanges").alias("exchange", "categories")).select("exchange", F.explode("categories").alias("feed_category", "c")).select("exchange", "feed_category", F.explode("c.records").alias("r")).select("exchange", "feed_category", "r.*")
    formats = ("d MMM yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    dated = F.regexp_replace(F.trim("published"), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(dated, r"\s*(?:GMT|UTC|Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    at = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats]).cast("timestamp_ntz")
    return rows.withColumn("published_at", at).withColumn("external_id", F.coalesce(F.nullif(F.trim("source_url"), F.lit("")), "title"))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """title, description, link, published of every ``item`` of RSS files."""
    schema = "title string, description string, link string, pubDate string"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).withColumnRenamed("pubDate", "published")


def read_index_trend(spark: SparkSession, path: str) -> DataFrame:
    """trade_date and close of an index file, whatever the case of its header; bad rows are left out."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    by = {c.strip().lower(): c for c in raw.columns}
    if not {"date", "close"} <= set(by):
        raise ValueError("an index file needs a date and a close column")
    rows = raw.select(T.parsed_date(F.col(f"`{by['date']}`"), ("yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy", "dd-MM-yyyy")).alias("trade_date"), T.safe_double(F.col(f"`{by['close']}`")).alias("close"))
    return rows.filter("trade_date IS NOT NULL AND close IS NOT NULL").orderBy("trade_date")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line; comments after # are skipped and a repeated id raises."""
    ids = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).filter("v <> ''").select(F.col("v").cast("long").alias("id"))
    if not ids.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("an id is listed twice")
    return ids


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each different content of the files: sha256, size, the first path, how many files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return files.groupBy("sha256").agg(F.min("length").alias("file_size"), F.min("path").alias("path"), F.count("*").alias("files"))


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def overwrite_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replace those partitions of a Parquet table that the rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
