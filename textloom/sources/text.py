"""Text sources: rows source_index, source_name, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "source_index int, source_name string, content string"


def from_text(spark: SparkSession, *texts: str, names: tuple[str, ...] = ()) -> DataFrame:
    """Texts at hand, in their order; one without a name is called stdin."""
    rows = [(i, names[i] if i < len(names) else "stdin", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def from_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files, one row each, in the order of `paths`; a path that isn't there, or has no file, is an error.

    Paths may be relative, have a scheme or not, and name folders or patterns, whose
    files follow one another by name. A path given twice is two sources. Spark reads
    files in an order of its own, so that each is joined with its place in the list;
    Spark itself says what a path stands for.
    """
    places, listed = [], {}
    for path in paths:
        if path not in listed:
            listed[path] = sorted(spark.read.text(path, wholetext=True).inputFiles())
            if not listed[path]:
                raise FileNotFoundError(f"no file in {path}")
        places += [(path, file) for file in listed[path]]
    rows = [(i, path if len(listed[path]) == 1 else file, file) for i, (path, file) in enumerate(places)]
    wanted = spark.createDataFrame(rows, "source_index int, source_name string, _file string")
    read = spark.read.text(sorted(listed), wholetext=True).select(F.input_file_name().alias("_path"), F.col("value").alias("content"))
    # a file that two paths name is read twice
    read = read.dropDuplicates(["_path"]) if len(set(file for _, file in places)) < sum(map(len, listed.values())) else read
    # Spark passes empty files over; one that it reads must have its place
    joined = wanted.join(read, F.col("_file") == F.col("_path"), "full_outer")
    found = F.when(F.col("_file").isNull(), F.raise_error(F.concat(F.lit("file without a place: "), "_path"))).otherwise(F.coalesce("content", F.lit("")))
    return joined.select("source_index", "source_name", found.cast("string").alias("content"))


def from_column(df: DataFrame, key: str, content: str) -> DataFrame:
    """A column of any table: every row is a source of its own, under its key."""
    return df.select(F.col(key).alias("source_index"), F.col(key).cast("string").alias("source_name"), F.col(content).alias("content"))


def large_file(spark: SparkSession, path: str, delimiter: str = "\n") -> DataFrame:
    """Records of one file that is too large for a row: source_index, record_pos, record, n_bytes.

    Spark splits the file at the delimiter, in parallel. record_pos sorts the
    records of the file but has gaps.
    """
    read = spark.read.text(path, lineSep=delimiter).filter("value <> ''")
    # position of the piece of the file that Spark read, then of the record in it
    at = F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return read.select(F.lit(0).alias("source_index"), at.alias("record_pos"), F.col("value").alias("record"), F.octet_length("value").cast("long").alias("n_bytes"))


def whole(sources: DataFrame) -> DataFrame:
    """One row content: all sources in order, a line feed after each."""
    ordered = F.array_sort(F.collect_list(F.struct("source_index", F.coalesce("content", F.lit("")).alias("content"))))
    return sources.agg(F.array_join(F.transform(ordered, lambda s: F.concat(s["content"], F.lit("\n"))), "").alias("content"))
