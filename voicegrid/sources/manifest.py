"""Manifests of utterances: (spk, utt, pos) tables from directory trees and CSV files.

``pos`` ascends in the order of the file or listing; it has gaps.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from . import files

_BLANK = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space, of Unicode too, at either end."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _BLANK, "")


def path_part(path: Column, index: int) -> Column:
    """Part of a path between slashes, counted from 0 or, if negative, from the end; null where there is none."""
    return F.try_element_at(F.split(path, "/"), F.lit(index + 1 if index >= 0 else index))


def speaker_of_basename(path: Column) -> Column:
    """What stands before the first hyphen of the file's name."""
    return F.split_part(path_part(path, -1), F.lit("-"), F.lit(1))


def from_directory(spark: SparkSession, data_dir: str, suffix: str = ".flac") -> DataFrame:
    """(spk, utt, pos) of the files ``data_dir/*/*/*<suffix>``, by names only; folders are listed in tasks."""
    found = files.listing(spark, data_dir, suffix, depth=3).select("utt", F.monotonically_increasing_id().alias("pos"))
    return found.select(speaker_of_basename(F.col("utt")).alias("spk"), "utt", "pos")


def _records(lines: DataFrame, quotes: Column) -> DataFrame:
    """Lines put together to records: those that begin within quotes go on from the line before. Line feeds within become a mark."""
    split = F.col("file_block_start")
    opened = numbers.before(lines, ("file_path",), ("pos",), split, quotes=quotes)
    begins = (F.col("quotes") % 2 == 0).cast("int")
    counted = numbers.before(opened, ("file_path",), ("pos",), split, record=begins).withColumn("record", F.col("record") + begins)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("file_block_start", "pos", "value"))), lambda x: x["value"])
    return counted.groupBy("file_path", "record").agg(F.min("pos").alias("pos"), F.array_join(parts, "\u0001").alias("value"))


def csv_rows(spark: SparkSession, csv_file: str) -> DataFrame:
    """(pos, n_fields, spk, utt) of all records of CSV files, spk and utt stripped, null unless there are exactly two fields.

    Without header; quoted fields may hold commas, doubled quotes and line breaks.
    Empty fields count; records of blanks only have one field. Files are read line by
    line, in as many tasks as they have splits. Where a quoted field goes over several lines,
    the quotes before each line of its file, summed up by splits, tell whether it begins within one.
    """
    lines = spark.read.text(csv_file, lineSep="\n").select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("pos"))
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    if not lines.where(quotes % 2 == 1).isEmpty():
        lines = _records(lines, quotes)
    lines = lines.select("pos", F.regexp_replace("value", "\r$", "").alias("value"))
    # A third field, be it empty, shows in the raw line only, so fields are counted there.
    parsed = F.from_csv("value", "c0 string, c1 string, c2 string", {"escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0000"})
    fields = (1 + F.length(F.regexp_replace(F.regexp_replace("value", r'"(?:[^"]|"")*"', ""), "[^,]", ""))).cast("int")
    rows = lines.withColumn("n_fields", fields).withColumn("f", parsed)
    field = lambda c: F.when(F.col("n_fields") == 2, strip(F.replace(F.col(c), F.lit("\u0001"), F.lit("\n"))))
    return rows.select("pos", "n_fields", field("f.c0").alias("spk"), field("f.c1").alias("utt"))


def from_csv(spark: SparkSession, csv_file: str) -> DataFrame:
    """(spk, utt, pos) of the records of exactly two fields, in the order of the file; repeats stay."""
    return csv_rows(spark, csv_file).where("n_fields = 2").select("spk", "utt", "pos")


def select(spark: SparkSession, csv_file: str | None, data_dir: str, suffix: str = ".flac") -> DataFrame:
    """The CSV file if one is named, else the directory."""
    return from_csv(spark, csv_file) if csv_file else from_directory(spark, data_dir, suffix)


def listed(spark: SparkSession, path_to_dataset: str, audio_format: str, speaker_label_index: int = -2) -> DataFrame:
    """(spk, utt) of all files below a directory whose names end with ``audio_format``."""
    found = files.listing(spark, path_to_dataset, audio_format, hidden=True)
    return found.select(path_part(F.col("utt"), speaker_label_index).alias("spk"), "utt")


def generate_csv(spark: SparkSession, path_to_dataset: str, audio_format: str, output_csv: str, speaker_label_index: int = -2) -> int:
    """Write ``spk,path`` lines, joined by line feeds, to one file; fields with commas or quotes are quoted."""
    rows = listed(spark, path_to_dataset, audio_format, speaker_label_index).orderBy("utt")
    if missing := rows.where("spk is null").first():
        raise IndexError(f"no path part {speaker_label_index} in {missing['utt']}")

    def field(c: str) -> Column:
        return F.when(F.col(c).rlike('[",\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))

    n = 0
    Path(output_csv).parent.mkdir(parents=True, exist_ok=True)
    with open(output_csv, "w", encoding="utf-8") as out:
        # The file is one local one by definition, so its lines pass through here one by one.
        for row in rows.select(F.concat_ws(",", field("spk"), field("utt")).alias("line")).toLocalIterator():
            out.write(("\n" if n else "") + row["line"])
            n += 1
    return n


def grouped(manifest: DataFrame, part: int = 1024) -> DataFrame:
    """(spk, part, utts, n): the utterances of each speaker in order, in lists of those from ``part`` positions."""
    parts = manifest.groupBy("spk", F.floor(F.col("pos") / part).alias("part"))
    return parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "utt"))), lambda x: x["utt"]).alias("utts"), F.count("*").alias("n"))
