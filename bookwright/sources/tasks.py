"""Existing task names, from stored response pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwright.functions.text import py_strip
from bookwright.session import materialise

# Entries stay JSON texts, so that one entry of another kind does not spoil its page.
_PAGE = T.StructType(
    [
        T.StructField("data", T.ArrayType(T.StringType())),
        T.StructField("project_gid", T.StringType()),
        T.StructField("offset", T.StringType()),
        T.StructField("next_page", T.StringType()),
    ]
)

COMPLETE = "complete"
MISSING_PAGE = "missing_page"
NO_FIRST_PAGE = "no_first_page"
CYCLE = "cycle"


def task_names(pages: DataFrame) -> DataFrame:
    """``project_gid, name`` for every object entry with a name; names trimmed, duplicates kept."""
    entries = pages.select("project_gid", F.explode("data").alias("entry"))
    objects = entries.filter(F.col("entry").startswith("{"))
    name = py_strip(F.coalesce(F.get_json_object("entry", "$.name"), F.lit("")))
    return objects.select("project_gid", name.alias("name")).filter(F.col("name") != "")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages: ``project_gid``, their ``data``, the ``offset`` they were asked for with, and ``next_page``."""
    return spark.read.schema(_PAGE).json(path)


def chain_pages(pages: DataFrame) -> DataFrame:
    """Each page once, with ``following``, the offset it names for the next one, and ``reached``: whether the chain from the
    first page (no offset) comes to it.

    Of pages with the same project and offset the greatest by content is taken. A chain of n pages takes log2(n) rounds: jumps
    double, and what is reached so far takes them; a round is a join, and its result is written. Empty offsets are none.
    """
    own = F.nullif(F.col("offset"), F.lit(""))
    following = F.nullif(F.get_json_object("next_page", "$.offset"), F.lit(""))
    content = F.struct(F.to_json("data").alias("text"), "data", following.alias("following"))
    once = pages.groupBy("project_gid", F.coalesce(own, F.lit("")).alias("at")).agg(F.max(content).alias("page"))
    once = materialise(once.select("project_gid", "at", "page.data", "page.following"), "pages")
    links = once.select("project_gid", "at", F.col("following").alias("to"))
    there = once.select("project_gid", F.col("at").alias("to"))
    jumps = links.filter(F.col("to").isNotNull()).join(there, ["project_gid", "to"], "left_semi").select("project_gid", "at", "to")
    reached = once.filter(F.col("at") == "").select("project_gid", "at")
    most = once.groupBy("project_gid").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        ahead = reached.join(jumps, ["project_gid", "at"]).select("project_gid", F.col("to").alias("at"))
        reached = materialise(reached.union(ahead).distinct(), "reached")
        further = jumps.select("project_gid", F.col("at").alias("to"), F.col("to").alias("next"))
        jumps = jumps.join(further, ["project_gid", "to"]).select("project_gid", "at", F.col("next").alias("to"))
        jumps = materialise(jumps, "jumps")
        if jumps.isEmpty():
            break
    mark = reached.select("project_gid", "at", F.lit(True).alias("reached"))
    return once.join(mark, ["project_gid", "at"], "left").na.fill(False, ["reached"])


def page_chain_status(chained: DataFrame) -> DataFrame:
    """Per project whether its pages are complete: ``status``, ``pages``, ``reached`` and the ``missing`` offset.

    ``chained`` is ``chain_pages``. A project whose first page is not there has none that is reached; where every page that
    is reached leads to another, they go round.
    """
    there = chained.select("project_gid", F.col("at").alias("following"), F.lit(True).alias("found"))
    linked = chained.join(there, ["project_gid", "following"], "left")
    ends = F.col("reached") & F.col("following").isNull()
    lost = F.col("reached") & F.col("following").isNotNull() & F.col("found").isNull()
    found = linked.groupBy("project_gid").agg(
        F.count("*").alias("pages"),
        F.count_if("reached").alias("reached"),
        F.count_if(ends).alias("ends"),
        F.coalesce(F.max(F.when(lost, F.col("following"))), F.lit("")).alias("missing"),
    )
    status = (
        F.when(F.col("reached") == 0, NO_FIRST_PAGE)
        .when(F.col("missing") != "", MISSING_PAGE)
        .when(F.col("ends") == 0, CYCLE)
        .otherwise(COMPLETE)
    )
    return found.select("project_gid", status.alias("status"), "pages", "reached", "missing")


def read_task_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages stored one per line below ``project_gid=<id>`` folders."""
    return task_names(read_pages(spark, path))
