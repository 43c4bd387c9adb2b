"""Files as a source: metadata listing, name rules, kinds of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of images, folders and bundles that are passed over.
IMAGE_SUFFIXES = ("jpg", "jpeg", "jpe", "heic", "heif", "hif", "png", "webp")
SYSTEM_FOLDERS = ("@eaDir", "$RECYCLE.BIN", "System Volume Information", "node_modules")
BUNDLES = (".photoslibrary", ".app", ".aplibrary", ".lrdata")
# Kinds of sources by what their path holds, in this order; the rest is a computer.
SOURCE_KINDS = (("dropbox", "dropbox"), ("icloud", "icloud"), ("mobile documents", "icloud"), ("googledrive", "google_disk"), ("google drive", "google_disk"), ("/my drive", "google_disk"), ("/min disk", "google_disk"))


def is_image(path: Column) -> Column:
    """By suffix, letters in either case."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)


def passed_over(rel_path: Column) -> Column:
    """S3: some folder on the way is hidden, of a system, or a bundle."""
    folders = F.slice(F.split(rel_path, "/"), 1, F.greatest(F.size(F.split(rel_path, "/")) - 1, F.lit(0)))
    bad = lambda f: f.startswith(".") | f.isin(*SYSTEM_FOLDERS) | F.lower(f).rlike("(" + "|".join(b.replace(".", r"\.") for b in BUNDLES) + ")$")
    return F.exists(folders, bad)


def placeholder_target(name: Column) -> Column:
    """The real name of a .name.icloud stub, else null."""
    target = F.regexp_extract(name, r"^\.(.+)\.icloud$", 1)
    return F.when(target != "", target)


def source_kind(path: Column) -> Column:
    """S6"""
    low, out = F.replace(F.lower(path), F.lit("\\"), F.lit("/")), F.lit("pc")
    for part, kind in reversed(SOURCE_KINDS):
        out = F.when(low.contains(part), kind).otherwise(out)
    return out


def full_path(root: Column, rel_path: Column) -> Column:
    """S5"""
    return F.concat_ws("/", F.rtrim(root, F.lit("/")), rel_path)


def scanned(listing: DataFrame, root: str) -> DataFrame:
    """rel_path, size, modified and status from path, length and modificationTime of a listing."""
    rel = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(root.rstrip("/")) + 2, 1 << 20)
    rows = listing.select(rel.alias("rel_path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified"))
    name = F.element_at(F.split("rel_path", "/"), -1)
    target = placeholder_target(name)
    rows = rows.withColumn("_t", target).filter(~passed_over(F.col("rel_path")))
    folder = F.regexp_extract("rel_path", r"^(.*/)?[^/]*$", 1)
    rows = rows.withColumn("rel_path", F.when(F.col("_t").isNotNull(), F.concat(folder, F.col("_t"))).otherwise(F.col("rel_path")))
    rows = rows.filter(is_image(F.col("rel_path")))
    return rows.select("rel_path", F.when(F.col("_t").isNotNull(), 0).otherwise(F.col("size")).cast("long").alias("size"), "modified", F.when(F.col("_t").isNotNull(), "cloud_only").otherwise("local").alias("status"))


def cloud_stubs(spark: SparkSession, root: str) -> DataFrame:
    """Path, length and modificationTime of the .name.icloud stubs below a folder. Spark's readers pass over names that start with a
    dot, so these are asked of the file system, level by level, and only the stubs come to the driver."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    system, found, level = top.getFileSystem(spark._jsc.hadoopConfiguration()), [], root.rstrip("/")
    while True:
        for s in system.globStatus(hadoop.Path(f"{level}/.*.icloud")) or []:
            if s.isFile():
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        level += "/*"
        if not len(system.globStatus(hadoop.Path(level)) or []):
            break
    rows = spark.createDataFrame(found, "path string, length long, ms long")
    return rows.select("path", "length", F.timestamp_millis("ms").alias("modificationTime"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder and stubs of files in a cloud, metadata only: the content column is never read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    return scanned(listing.unionByName(cloud_stubs(spark, root)), root)


def covered_suggestions(candidates: DataFrame) -> DataFrame:
    """Candidates less those that lie below or above one named earlier. candidates: ordinal and path."""
    a = candidates.select("ordinal", "path")
    # Each path meets its own ancestors, which are as many as its folders.
    parts = F.split(F.col("path"), "/")
    up = a.select(F.col("ordinal").alias("o1"), F.col("path").alias("p1"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path"))
    met = up.join(a, "path").filter("o1 <> ordinal")
    late = met.select(F.when(F.col("o1") > F.col("ordinal"), F.col("p1")).otherwise(F.col("path")).alias("path"))
    return candidates.join(late.distinct(), "path", "left_anti")
