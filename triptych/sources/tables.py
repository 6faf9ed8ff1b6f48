"""Item tables: CSV and Parquet in, Parquet (or an exported CSV) out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triptych.functions.cleaning import missing_if_nan, to_number
from triptych.functions.describing import present
from triptych.sources.versions import fingerprint
from triptych.staging import staged


# Column by which rows find their long texts again.
DIGEST = "_digest"


class MissingSource(FileNotFoundError):
    """A required input does not exist."""


class ChangedSource(RuntimeError):
    """An input was not the same when it was read again."""


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: str | T.StructType | None = None,
    encoding: str = "UTF-8",
    multiline: bool | None = True,
    rescued: str | None = None,
) -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks and doubled quotes.

    Every column is read as text under the name that the header gives it, so that ingest never
    guesses types. A schema picks columns by name, whatever their order in the file, and casts them;
    a column the file lacks is NULL. Text that does not fit its type is NULL, and with `rescued` kept
    in a map column of that name, from column to text. All files of a path have the same header; one
    with another is an error.

    Files without line breaks inside fields are split over tasks with `multiline=False`; with None
    the files are looked at first.
    """
    if multiline is None:
        multiline = holds_line_breaks(spark, path)
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("encoding", encoding)
        .option("enforceSchema", False)
    )
    df = reader.csv(path)
    if schema is not None:
        df = typed(df, schema, rescued)
    return df.select(*columns) if columns else df


def typed(df: DataFrame, schema: str | T.StructType, rescued: str | None = None) -> DataFrame:
    """Text columns cast to the types of the schema, matched by name; what does not fit goes to `rescued`."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    known = {f.name: f.dataType for f in kinds if f.name in df.columns}
    fits = lambda name: F.col(f"`{name}`").try_cast(known[name])
    cast = [(fits(f.name) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds]
    if rescued is None:
        return df.select(*cast)
    misfit = [
        F.when(F.col(f"`{name}`").isNotNull() & fits(name).isNull(), F.struct(F.lit(name).alias("name"), F.col(f"`{name}`").alias("text")))
        for name in known
    ]
    kept = F.map_from_entries(F.array_compact(F.array(*misfit))) if misfit else F.lit(None).cast("map<string,string>")
    return df.select(*cast, F.when(F.size(kept) > 0, kept).alias(rescued))


def rescued_counts(df: DataFrame, rescued: str) -> DataFrame:
    """Values that did not fit the type of their column: column_name, n."""
    return df.select(F.explode(rescued).alias("column_name", "_text")).groupBy("column_name").agg(F.count("*").alias("n"))


def holds_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some quoted field goes over the end of its line.

    While every line has an even number of quotes, each one ends outside of quotes, and so does the
    file. The lines are looked at in parallel, and the first odd one ends the search.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def load_table(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    format: str = "parquet",
    required: bool = True,
    **options,
) -> DataFrame:
    """Table at `path`; when it does not exist, an error or an empty table of the same schema."""
    if not exists(spark, path):
        if required:
            raise MissingSource(path)
        return spark.createDataFrame([], schema)
    if format == "csv":
        return read_csv(spark, path, schema=schema, **options)
    return spark.read.schema(schema).options(**options).format(format).load(path)


def load_first(spark: SparkSession, paths: Sequence[str], schema: str | T.StructType) -> DataFrame:
    """The first of several places that exists, in order of preference."""
    for path in paths:
        if exists(spark, path):
            return load_table(spark, path, schema)
    raise MissingSource(", ".join(paths))


def ensure_columns(df: DataFrame, wanted: Mapping[str, str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Add absent optional columns as typed NULLs, or as their default."""
    defaults = defaults or {}
    missing = {
        name: F.lit(defaults.get(name)).cast(kind) for name, kind in wanted.items() if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def fill_missing(
    df: DataFrame, constants: Mapping[str, object] | None = None, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Replace missing values by a constant, or by the value of another column."""
    filled = {name: F.coalesce(name, F.lit(value)) for name, value in (constants or {}).items()}
    filled |= {name: F.coalesce(name, other) for name, other in (columns or {}).items()}
    return df.withColumns(filled)


def rename_if_absent(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename `old` to `new` unless `new` is already there."""
    if new not in df.columns and old in df.columns:
        return df.withColumnRenamed(old, new)
    return df


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lower() for name in df.columns])


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Existing columns of the list as doubles; unreadable text and NaN become NULL."""
    kinds = dict(df.dtypes)

    def number(name: str) -> Column:
        if kinds[name] == "string":
            return to_number(F.col(name))
        return missing_if_nan(F.col(name).cast("double"))

    return df.withColumns({name: number(name) for name in columns if name in kinds})


def with_source_order(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number of every row in its source, from 0: files by name, rows as they follow each other.

    Only for a frame read straight from files. It is written once, with the split that each row is
    from; counts of the splits, added up, say at which number a split begins. So the numbers depend
    neither on how files are split over tasks, nor on whether the rows lie in one file or in several
    that follow each other by name, nor on the folder.

    There is one row per split to join, 800,000 of them for 100 TB at 128 MB each; Spark broadcasts
    them where its own size check allows.
    """
    place = {
        "_file": F.col("_metadata.file_name"),
        "_path": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_row": F.monotonically_increasing_id(),
    }
    landed = staged(df.select("*", *[value.alias(key) for key, value in place.items()]), "landed")
    split = ["_file", "_path", "_block"]
    # Rows of a split are read one after the other by one task, so their ids have no gap.
    splits = landed.groupBy(*split).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    offsets = staged(splits.select(*split, begins.alias("_offset")), "landed-splits")
    numbered = landed.join(offsets, split).withColumn(name, F.col("_row") + F.col("_offset"))
    return numbered.select(*[c for c in df.columns if c != name], name)


def row_digest(df: DataFrame) -> Column:
    """Digest of all columns: rows with the same one are copies."""
    return fingerprint(*[F.col(f"`{name}`") for name in df.columns])


def set_aside(df: DataFrame, long: Mapping[str, int]) -> DataFrame:
    """`df` with only the first characters of its long text columns, so many of each, and a digest of the row.

    For a frame that can be read again, such as one straight from files: what is written, shuffled
    and sorted on the way to a sample holds no long texts, and those of the sample are put back.
    """
    held = {name: n for name, n in long.items() if name in df.columns}
    if not held:
        return df
    return df.withColumns({DIGEST: row_digest(df)} | {name: F.substring(name, 1, n) for name, n in held.items()})


def put_back(df: DataFrame, whole: DataFrame, long: Mapping[str, int]) -> DataFrame:
    """Rows of a written sample with their long texts whole; `whole` is the frame that `set_aside` got.

    It is read once more, and only rows of the sample leave their task. Equal digests are copies of a
    row, so any one of them has the text. Returns a written table.
    """
    held = [name for name in long if name in whole.columns]
    if not held:
        return df
    wanted = df.select(DIGEST).distinct()
    marked = whole.select(row_digest(whole).alias(DIGEST), *held).join(F.broadcast(wanted), DIGEST, "left_semi")
    found = staged(marked.groupBy(DIGEST).agg(*[F.first(name).alias(name) for name in held]), "long-texts")
    if found.count() < wanted.count():
        raise ChangedSource(", ".join(held))
    return staged(df.drop(*held).join(found, DIGEST).select(*[c for c in df.columns if c != DIGEST]), "whole")


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*present(df.columns, wanted))


def write_table(df: DataFrame, path: str, wanted: Sequence[str] | None = None) -> None:
    """Processed table between stages: Parquet, replaced as a whole."""
    (keep_columns(df, wanted) if wanted else df).write.mode("overwrite").parquet(path)


def export_csv(
    df: DataFrame, path: str, wanted: Sequence[str] | None = None, encoding: str = "UTF-8"
) -> None:
    """Processed table for other tools: CSV with a header and doubled quotes."""
    out = keep_columns(df, wanted) if wanted else df
    writer = out.write.mode("overwrite").option("header", True).option("escape", '"')
    # Spark would trim the texts by default.
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("encoding", encoding).csv(path)
