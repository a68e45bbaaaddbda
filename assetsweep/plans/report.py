"""Reports: display names, bounded listings, JSON report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetsweep.operators.ranking import ranked
from assetsweep.operators.skew import join_members_to_groups
from assetsweep.session import materialize


def base_name(path) -> F.Column:
    """Last path component, ignoring trailing slashes (``a/b/`` -> ``b``)."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(F.regexp_replace(p, "/+$", ""), "([^/]*)$", 1)


def display_name(tag="tag", header_name="header_name", path="path") -> F.Column:
    """Tag, else the header's name, else the file name."""
    return F.coalesce(F.col(tag), F.col(header_name), base_name(path))


def top_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """O3: the first ``n`` rows in ``order`` with their rank and how many were left out.

    The limit is the feature here.  Spark plans it as ``TakeOrderedAndProject``
    (per-partition top-n, then a merge of at most n rows per partition); the rank
    window runs over those n rows only.  ``n_more`` needs the total row count,
    read with one count job.
    """
    total = df.count()
    top = df.orderBy(*order).limit(n)
    return (top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
            .withColumn("n_more", F.lit(max(total - n, 0)).cast("long"))
            .select("rank", *df.columns, "n_more"))


# Members in one row of a report.
MEMBERS_PER_ROW = 10_000


def group_chunks(dups, per_row: int = MEMBERS_PER_ROW) -> DataFrame:
    """The duplicate groups with their members, in rows of at most ``per_row`` members.

    A group of n members gives ceil(n / per_row) rows, numbered from 0 by ``chunk``, members in order of asset_id.  Members are
    numbered by a range sort over all groups, so a group that holds a third of all rows is spread over tasks; only the
    first number of each group is joined back.
    """
    members = ranked(dups.members(), [F.asc("group_id"), F.asc("asset_id")], "_n")
    groups = dups.groups.select("group_id", "n_members", "size_each", "reclaimable", "keeper_id", "hash")
    first = members.groupBy("group_id").agg(F.min("_n").alias("_first"))
    groups = materialize(groups.join(first, "group_id"))
    rows = join_members_to_groups(members.select("group_id", "_n", "asset_id", "path", "store", "is_keeper"), groups, ["group_id"])
    chunk = F.floor((F.col("_n") - F.col("_first")) / per_row).cast("long")
    keys = ["group_id", "n_members", "size_each", "reclaimable", "keeper_id", "hash"]
    member = F.struct("asset_id", "path", "store", "is_keeper")
    return (rows.groupBy(*keys, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(member)).alias("members"))
            .withColumn("n_chunks", F.ceil(F.col("n_members") / per_row)))


def write_json_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON-lines report; null optional fields are omitted by the writer."""
    df.write.mode(mode).json(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """S8 as a column: one JSON object per row, nulls omitted."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
