"""Sources and sinks: archive catalogues, attribute tables, delimited and vocabulary files, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, size, mod_time) of the files below ``root``; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"))


def delimited(spark: SparkSession, path: str, separator: str = ",", comment: str = "#") -> DataFrame:
    """(line, items): trimmed items of each line of a rule file, lines numbered from 1 in their file. Comments and blank lines are taken away; a line that
    ends in a backslash goes on in the next and counts as one with the number of its last, also where the file ends. Files are read in the parts that Spark
    splits them into: lines are numbered in each part, behind those of the parts before."""
    text = F.rtrim(F.regexp_replace(F.regexp_replace("value", r"\r\z", ""), f"{comment}.*$", ""))
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), text.alias("text"))
    t = read.withColumn("_ends", (~F.endswith("text", F.lit("\\"))).cast("long"))
    # a row a part, so a few: numbers in place of paths; lines, and lines that end something, of the parts before
    order, before = Window.orderBy("_path", "_at"), Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy("_path", "_at").agg(F.count("*").alias("n"), F.sum("_ends").alias("ends"))
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_before") for c in ("n", "ends")]
    parts = parts.select("_path", "_at", F.row_number().over(order).alias("_part"), F.dense_rank().over(Window.orderBy("_path")).alias("_file"), *sums)
    own = Window.partitionBy("_part").orderBy("_id")
    group = F.col("_ends_before") + F.sum("_ends").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_ends")
    t = t.join(F.broadcast(parts), ["_path", "_at"]).drop("_path", "_at")
    t = t.select("_file", group.alias("_group"), F.struct((F.col("_n_before") + F.row_number().over(own)).alias("line"), "text").alias("x"))
    t = t.groupBy("_file", "_group").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    t = t.select(F.element_at("xs", -1)["line"].alias("line"), F.array_join(F.transform("xs", lambda x: F.regexp_replace(x["text"], r"\\$", "")), "").alias("text"))
    return t.where(F.trim("text") != "").select("line", F.transform(F.split("text", separator), lambda x: F.trim(x)).alias("items"))


def attributes(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """(id, att, value): string columns as long attribute rows."""
    return df.unpivot([id], columns, "att", "value")


def standard_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, canonical_units, amip, grib) of the entries of a standard-name table in XML."""
    return spark.read.format("xml").option("rowTag", "entry").load(path).select(F.col("_id").alias("id"), *[c for c in ("canonical_units", "amip", "grib")])


def resolved_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, id, canonical_units) of the standard names of a table in XML and of their aliases: an alias has the id and the units of the entry it
    stands for; of a chain of aliases each link is followed once, and one whose entry is not there has null units."""
    entries = spark.read.format("xml").option("rowTag", "entry").schema("_id string, canonical_units string").load(path)
    aliases = spark.read.format("xml").option("rowTag", "alias").schema("_id string, entry_id string").load(path).where("_id is not null")
    own = entries.where("_id is not null").select(F.col("_id").alias("name"), F.col("_id").alias("id"), "canonical_units")
    step = aliases.select(F.col("_id").alias("link"), F.col("entry_id").alias("further"))
    near = aliases.join(step, aliases["entry_id"] == step["link"], "left").select(F.col("_id").alias("name"), F.coalesce("further", "entry_id").alias("id"))
    return own.unionByName(near.join(own.select("id", "canonical_units"), "id", "left"))


def append_results(results: DataFrame, path: str, by: list[str]) -> None:
    """Add record results to the table under ``path``, partitioned by ``by``."""
    results.write.mode("append").partitionBy(*by).parquet(path)
