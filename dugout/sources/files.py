"""CSV and JSON readers, discovery of season files, and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.functions.text import na_to_null

#: Fixed value: names of season files.
SEASON_FILE = r"(?i)^(batting|pitching)_(standard|advanced)_(\d{4})\.csv$"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """A CSV with header, read as text, null tokens nulled, then cast leniently to ``schema``."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    df = spark.read.option("header", True).option("sep", sep).option("enforceSchema", False).schema(raw).csv(path)
    q = lambda n: F.col(f"`{n}`")
    cast = lambda f: na_to_null(q(f.name)) if isinstance(f.dataType, T.StringType) else na_to_null(q(f.name)).try_cast(f.dataType)
    return df.select(*[cast(f).alias(f.name) for f in schema])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of flat objects, with ``_ord`` for the order in the file. One array is one record to Spark, so the
    ordinal is that of its only partition."""
    return spark.read.option("multiLine", True).schema(schema).json(path).withColumn("_ord", F.monotonically_increasing_id())


def season_of(name: Column) -> Column:
    """Struct (type, kind, year) of a season file's name, nulls if it is none."""
    base = F.substring_index(name, "/", -1)
    hit = base.rlike(SEASON_FILE)
    part = lambda i: F.when(hit, F.lower(F.regexp_extract(base, SEASON_FILE, i)))
    return F.struct(part(1).alias("type"), part(2).alias("kind"), part(3).try_cast("int").alias("year"))


def complete_seasons(files: DataFrame, name: str, *by: str) -> DataFrame:
    """(by..., type, year, complete) of each season: complete if both kinds of file are there."""
    s = files.select(*by, season_of(F.col(name)).alias("s")).where("s.type is not null")
    return s.groupBy(*by, F.col("s.type").alias("type"), F.col("s.year").alias("year")).agg(
        (F.count_distinct("s.kind") == 2).alias("complete"))


def year_grid(keys: DataFrame, first: int, last: int) -> DataFrame:
    """Every key in every year of a closed range: a generator, not a join."""
    return keys.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))


def exponent_grid(lo: int = 50, hi: int = 350, scale: int = 100) -> Column:
    """Array of lo/scale .. hi/scale; 301 exact hundredths by default."""
    return F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda i: i / F.lit(float(scale)))


def line_points(lo: Column, hi: Column, n: int = 100) -> Column:
    """Array of n evenly spaced values from lo to hi."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / F.lit(float(n - 1)))


def synthetic(spark: SparkSession, n: int, spec: dict[str, tuple[str, float, float]], seed: int = 42) -> DataFrame:
    """n rows of random columns: ``int`` in [lo, hi) or ``float`` in [lo, hi] rounded to 3; seeded, column by column."""
    out = [F.col("id")]
    for k, (name, (kind, lo, hi)) in enumerate(spec.items()):
        r = F.rand(seed + k) * (hi - lo) + lo
        out.append((F.floor(r).cast("int") if kind == "int" else F.round(r, 3)).alias(name))
    return spark.range(n).select(*out)


def with_ordinal(df: DataFrame, order: str, name: str = "_ord", by: list[str] | None = None) -> DataFrame:
    """Row numbers from 1 within ``by`` in the order of a column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(order)))
