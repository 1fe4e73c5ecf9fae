"""File trees: children, depths, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.sources.shared import stored

STORED_FROM = 8
COUNTED_FROM = 64


def children(files: DataFrame) -> DataFrame:
    """(parent_file_no, children in order)."""
    return files.filter("parent_file_no > 0").groupBy("object_no", "parent_file_no").agg(F.sort_array(F.collect_list("file_no")).alias("children"))


def roots(files: DataFrame) -> DataFrame:
    return files.filter("parent_file_no = 0").select("object_no", "file_no")


def depths(files: DataFrame) -> DataFrame:
    """(object_no, file_no, depth) level by level, breadth first; ends when a level is empty. Deep levels are stored, so that plans stay short."""
    out = level = files.filter("parent_file_no = 0").select("object_no", "file_no", F.lit(0).alias("depth"))
    edges = files.filter("parent_file_no > 0").select("object_no", "file_no", "parent_file_no")
    depth = 0
    while True:
        depth += 1
        up = level.select("object_no", F.col("file_no").alias("parent_file_no"))
        level = edges.join(up, ["object_no", "parent_file_no"]).select("object_no", "file_no", F.lit(depth).alias("depth"))
        if depth >= STORED_FROM:
            level = stored(level)
        if level.isEmpty():
            return out
        if depth == COUNTED_FROM:
            n = files.count()
        if depth >= COUNTED_FROM and depth >= n:
            raise InvalidInput("a file is below itself")
        out = out.unionByName(level)
        if depth % COUNTED_FROM == 0:
            out = stored(out)


def hardlinks(entries: DataFrame) -> DataFrame:
    """link_to: the first entry of the same (dev, inode) where there are several; entries must be numbered."""
    firsts = entries.filter("nlink > 1").groupBy("dev", "inode").agg(F.min("file_no").alias("first_no"))
    return entries.join(firsts, ["dev", "inode"], "left").withColumn("link_to", F.when((F.col("first_no") < F.col("file_no")) & (F.col("file_type") != "symlink"), F.col("first_no"))).drop("first_no")


def archive_links(entries: DataFrame) -> DataFrame:
    """link_to of an archive's hard links: an earlier entry of the target's path; ``missing`` where there is none."""
    targets = entries.select("archive", F.col("path").alias("link_target"), F.col("ordinal").alias("target"))
    found = entries.filter("file_type = 'hardlink'").join(targets, ["archive", "link_target"], "left").filter("target is null or target < ordinal")
    return found.groupBy("archive", "ordinal").agg(F.max("target").alias("link_to")).withColumn("missing", F.col("link_to").isNull())
