"""Feature-map and scan files as DataFrames, by format name; and their export.

All readers use Spark's own csv and xml sources with explicit schemas, so files of any number are
read in parallel.  A map's columns: mz, t (seconds), charge, intensity, and what the format adds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _number(c: str) -> Column:
    return F.col(c).cast("double")


def _csv(spark: SparkSession, path: str, sep: str, **options) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def maxquant(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated; retention times in minutes; the isotope intensities are ';'-joined and the first is the feature's."""
    df = _csv(spark, path, "\t")
    isotopes = F.transform(F.split("Intensities", ";"), lambda x: x.cast("double"))
    return df.select(
        _number("m/z").alias("mz"), (_number("Retention time") * 60).alias("t"), F.col("Charge").cast("int").alias("charge"),
        F.coalesce(_number("Intensity"), isotopes[0]).alias("intensity"), isotopes.alias("isotopes"),
    )


def progenesis(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """';'-separated behind two lines, with one intensity column per sample: unpivoted to (…, sample, intensity)."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    numbered = lines.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.monotonically_increasing_id())))
    header = numbered.filter("n = 3").select("value").head()[0].split(";")
    cells = numbered.filter("n > 3 AND value <> ''").select(F.split("value", ";").alias("c"))
    at = {h.strip('"'): i for i, h in enumerate(header)}
    cell = lambda name: F.regexp_replace(F.col("c")[at[name]], '"', "")
    wide = cells.select(
        cell("m/z").cast("double").alias("mz"), (cell("Retention time (min)").cast("double") * 60).alias("t"), cell("Charge").cast("int").alias("charge"),
        *(cell(s).cast("double").alias(s) for s in samples),
    )
    return wide.unpivot(["mz", "t", "charge"], samples, "sample", "intensity").filter("intensity IS NOT NULL")


def openms(spark: SparkSession, path: str) -> DataFrame:
    """featureXML: positions by dimension (0 the time, 1 the m/z)."""
    schema = "_id string, position array<struct<_dim:int,_VALUE:double>>, intensity double, overallquality double, charge int"
    df = spark.read.format("xml").option("rowTag", "feature").schema(schema).load(path)
    place = lambda d: F.filter("position", lambda p: p["_dim"] == d)[0]["_VALUE"]
    return df.select(place(1).alias("mz"), place(0).alias("t"), "charge", "intensity", F.col("overallquality").alias("quality"))


def superhirn(spark: SparkSession, path: str) -> DataFrame:
    """XML with the values in attributes; times in minutes."""
    schema = "coordinate struct<_mz:double,_rt:double,_intensity:double,_charge:int>, scan_range struct<_min:int,_max:int>"
    df = spark.read.format("xml").option("rowTag", "feature").schema(schema).load(path)
    c = lambda n: F.col(f"coordinate._{n}")
    return df.select(c("mz").alias("mz"), (c("rt") * 60).alias("t"), c("charge").alias("charge"), c("intensity").alias("intensity"), F.col("scan_range._min").alias("first_scan"), F.col("scan_range._max").alias("last_scan"))


def decon2ls(spark: SparkSession, path: str, scans: DataFrame, ppm: float = 10.0, gap: int = 1, least: int = 3) -> DataFrame:
    """Isotope patterns by scan, chained over cycles: same charge, m/z within ppm, at most ``gap`` cycles missing.

    scans: (scan_num, cycle, t). A chain of at least ``least`` scans is a feature; its intensity is the
    trapezoid area over time.
    """
    from ..operators.cluster import islands

    points = _csv(spark, path, ",").select(F.col("scan_num").cast("long").alias("scan_num"), _number("mz").alias("mz"), F.col("charge").cast("int").alias("charge"), _number("abundance").alias("abundance"))
    # Steps of log m/z are relative steps: islands of ln(m/z) are chains within ppm.
    placed = islands(points.withColumn("ln_mz", F.log("mz")), ["charge"], "ln_mz", ppm / 1e6).join(scans.select("scan_num", "cycle", "t"), "scan_num")
    w = Window.partitionBy("charge", "island").orderBy("cycle", "scan_num")
    apart = F.col("cycle") - F.lag("cycle").over(w) > gap + 1
    chained = placed.withColumn("chain", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w))
    inside = Window.partitionBy("charge", "island", "chain").orderBy("cycle", "scan_num")
    area = (F.col("t") - F.lag("t").over(inside)) * (F.col("abundance") + F.lag("abundance").over(inside)) / 2
    return (
        chained.withColumn("area", area)
        .groupBy("charge", "island", "chain")
        .agg(F.max_by("mz", "abundance").alias("mz"), F.max_by("t", "abundance").alias("t"), F.sum("area").alias("intensity"), F.count("*").alias("n_scans"))
        .filter(F.col("n_scans") >= least)
        .select("mz", "t", "charge", "intensity", "n_scans")
    )


def msinspect(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, '#' lines before the header."""
    df = _csv(spark, path, "\t", comment="#")
    return df.select(
        _number("mz").alias("mz"), _number("time").alias("t"), F.col("charge").cast("int").alias("charge"), _number("totalIntensity").alias("intensity"),
        F.col("scan").cast("long").alias("scan"), F.col("scanFirst").cast("long").alias("first_scan"), F.col("scanLast").cast("long").alias("last_scan"),
    )


def mfpaq(spark: SparkSession, path: str, map_number: int) -> DataFrame:
    """Tab-separated: the charge ('2+'), then six columns for each map (score, m/z, area, first, last and apex time)."""
    df = spark.read.option("header", False).option("sep", "\t").csv(path)
    at = 1 + 6 * (map_number - 1)
    c = lambda i: F.col(f"_c{at + i}")
    rows = df.filter(F.col("_c0").rlike(r"^\d+\+$") & c(0).isNotNull())
    return rows.select(
        c(1).cast("double").alias("mz"), (c(5).cast("double") * 60).alias("t"), F.regexp_extract("_c0", r"\d+", 0).cast("int").alias("charge"), c(2).cast("double").alias("intensity"),
        c(0).cast("double").alias("score"), (c(3).cast("double") * 60).alias("first_t"), (c(4).cast("double") * 60).alias("last_t"),
    )


#: Format name -> reader(spark, path, ...).
READERS: dict[str, Callable[..., DataFrame]] = {
    "maxquant": maxquant,
    "progenesis": progenesis,
    "openms": openms,
    "superhirn": superhirn,
    "decon2ls": decon2ls,
    "msinspect": msinspect,
    "mfpaq": mfpaq,
}


def read_map(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown map format {kind}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)


SCANS = "initial_id int, cycle int, time double, ms_level int, tic double, base_peak_moz double, base_peak_intensity double, precursor_moz double, precursor_charge int"


def scans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCANS).option("header", True).option("sep", "\t").csv(path)


def scan_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Scans of each level."""
    return df.groupBy(*keys).agg(F.count_if(F.col("ms_level") == 1).alias("ms1_count"), F.count_if(F.col("ms_level") == 2).alias("ms2_count"))
