"""A written inverted index of the trigrams of texts, for looking up substrings in any case without reading all texts.

``folder/rows`` holds the rows themselves by shelf (a hash of the meeting), ``folder/postings`` the posting lists by bucket (a hash
of the gram). A list of a gram in a meeting is cut into blocks of ``BLOCK`` references; a block holds its first reference, the
others' distances from it as small numbers, and how many rows it has. Within a bucket, files are sorted by gram, so that the
gram's statistics prune row groups.

A lookup reads the buckets of the wanted trigrams only, and of them the numbers of rows first: a gram that no row has ends
it; else the lists of the rarest ones are read and met. What is left names shelves and rows, whose texts are verified.

Meetings are written again by ``upsert``: rows and postings get a new edition, and only a meeting's last edition counts, so that
nothing that is there is rewritten; the list of editions is written last, and what is of no listed edition does not count. ``compact`` writes an index that has one edition only.

Rows need meeting_id and ref (a whole number, not null, once in a meeting) and text; other columns are kept. Null text has no
trigrams and is found by no query.
"""

from __future__ import annotations

import time
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of the index, references in a block at most, and how many of the rarest grams are met before rows are read.
BUCKETS, SHELVES, BLOCK, RAREST = 64, 64, 4_096, 4
#: Candidates that may go to all tasks, at 32 bytes each.
SENT_ROWS = 1_000_000


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    chars = F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0))
    at = lambda c, i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))
    made = lambda c: F.when(F.size(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: at(c, i))))
    once = F.element_at(F.transform(F.array(chars), made), 1)
    return F.coalesce(once, F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram), F.lit(BUCKETS)).cast("int")


def _shelf(meeting: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(meeting.cast("string"), F.lit(""))), F.lit(SHELVES)).cast("int")


def _write(rows: DataFrame, folder: str, edition: int) -> None:
    rows = rows.withColumn("edition", F.lit(edition).cast("long"))
    rows.withColumn("shelf", _shelf(F.col("meeting_id"))).repartition("shelf").write.mode("append").partitionBy("shelf").parquet(f"{folder}/rows")
    each = rows.select("meeting_id", F.col("ref").cast("long").alias("ref"), F.explode(grams_of(F.col("text"))).alias("gram"), "edition")
    blocks = each.groupBy("gram", "meeting_id", "edition", F.floor(F.col("ref") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("ref")).alias("refs"))
    coded = blocks.select("gram", "meeting_id", "edition", F.get("refs", F.lit(0)).alias("first"), F.transform("refs", lambda r: (r - F.get("refs", F.lit(0))).cast("smallint")).alias("far"), F.size("refs").alias("n"))
    coded.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")
    rows.select("meeting_id", "edition").distinct().write.mode("append").parquet(f"{folder}/editions")


def write(rows: DataFrame, folder: str) -> None:
    """A new index of ``rows`` in ``folder``, which must not be there yet."""
    rows.limit(0).write.mode("errorifexists").parquet(f"{folder}/schema")
    _write(rows, folder, 0)


def _read(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """A part of the index, which may have no files yet."""
    own = spark.read.parquet(f"{folder}/schema").schema
    kind = own["meeting_id"].dataType.simpleString()
    schemas = {
        "rows": T.StructType([*own.fields, T.StructField("edition", T.LongType()), T.StructField("shelf", T.IntegerType())]),
        "postings": f"gram string, meeting_id {kind}, edition long, first long, far array<smallint>, n int, bucket int",
        "editions": f"meeting_id {kind}, edition long",
    }
    return spark.read.schema(schemas[part]).parquet(f"{folder}/{part}")


def _editions(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "editions").groupBy("meeting_id").agg(F.max("edition").alias("edition"))


def upsert(rows: DataFrame, folder: str) -> None:
    """The meetings of ``rows`` anew, with these rows instead of those that they had; other meetings stay."""
    last = _read(rows.sparkSession, folder, "editions").agg(F.max("edition")).first()[0] or 0
    _write(rows, folder, max(last + 1, time.time_ns() // 1_000))


def _current(part: DataFrame, folder: str) -> DataFrame:
    """Without what later editions have replaced; an index of one edition is taken as it is."""
    spark = part.sparkSession
    if (_read(spark, folder, "editions").agg(F.max("edition")).first()[0] or 0) == 0:
        return part.filter("edition = 0")
    now = _editions(spark, folder).select(F.col("meeting_id").alias("_m"), F.col("edition").alias("_e"))
    return part.join(now, part["meeting_id"].eqNullSafe(now["_m"]) & (part["edition"] == now["_e"]), "left_semi")


def rows_of(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the index."""
    columns = spark.read.parquet(f"{folder}/schema").columns
    return _current(_read(spark, folder, "rows"), folder).select(columns)


def compact(spark: SparkSession, folder: str, to: str) -> None:
    write(rows_of(spark, folder), to)


def trigrams_of(q: str) -> list[str]:
    low = q.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def postings(spark: SparkSession, folder: str, grams: list[str]) -> DataFrame:
    """Posting lists of ``grams``, of their buckets only."""
    buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
    return _current(_read(spark, folder, "postings").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)), folder)


def candidates(spark: SparkSession, folder: str, q: str) -> tuple[DataFrame, int]:
    """(meeting_id, ref) of rows that have the rarest trigrams of ``q``, of three characters at least, and how many they can be."""
    wanted = trigrams_of(q)
    n = {r["gram"]: r["n"] for r in postings(spark, folder, wanted).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each gram of q
    rarest = sorted(wanted, key=lambda g: (n.get(g, 0), g))[:RAREST]
    most = n.get(rarest[0], 0)
    if not most:  # no row has it: nothing to read
        return _read(spark, folder, "rows").select("meeting_id", F.col("ref").cast("long").alias("ref")).limit(0), 0
    each = postings(spark, folder, rarest).select("gram", "meeting_id", F.col("first"), F.explode("far").alias("far")).select("meeting_id", (F.col("first") + F.col("far")).alias("ref"))
    met = each.groupBy("meeting_id", "ref").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).drop("n")
    return met, most


def lookup(spark: SparkSession, folder: str, q: str) -> DataFrame:
    """Rows whose text holds ``q`` in any case. A query of fewer than three characters reads all rows."""
    holds = F.lower("text").contains(q.lower())
    columns = spark.read.parquet(f"{folder}/schema").columns
    if len(q.lower()) < 3:
        return rows_of(spark, folder).filter(holds)
    found, most = candidates(spark, folder, q)
    found = found.select(F.col("meeting_id").alias("_m"), F.col("ref").alias("_r"), _shelf(F.col("meeting_id")).alias("_s"))
    rows = _read(spark, folder, "rows")
    if most <= SENT_ROWS:  # so many rows can there be, and no more
        shelves = [r["_s"] for r in found.select("_s").distinct().collect()]  # SHELVES at most
        rows, found = rows.filter(F.col("shelf").isin(shelves)), F.broadcast(found)
    same = (rows["shelf"] == found["_s"]) & rows["meeting_id"].eqNullSafe(found["_m"]) & (rows["ref"] == found["_r"])
    return _current(rows.join(found, same, "left_semi").filter(holds), folder).select(columns)
