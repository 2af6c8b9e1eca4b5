"""Links among the members of buckets, and connected components of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookwright.session import materialise

MORE = 4


def _toward_least(links: DataFrame) -> DataFrame:
    """Joins each ``a`` to the least of itself and its neighbours ``b``; all of them get that neighbour."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return links.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """``id, root`` of every id in ``links`` (columns ``a`` and ``b``): root is the least id of its component.

    Each round is two joins over at most as many links as are given; the rounds grow with the logarithm of
    the longest chain. Links to oneself and repeated links count once, null ends not at all.
    """
    ends = links.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    ids = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct()
    now = materialise(ends.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.union(now.select("b", "a"))
        large = _toward_least(both).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _toward_least(large)
        ups = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        now = materialise(ups.filter(F.col("a") != F.col("b")).distinct(), "links")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``roots`` (``id, root``) after more ``links`` (``a, b``), as ``components`` of all links would give them.

    Only the new links are gone through, from root to root; the components so far are renamed by one join.
    """
    ends = [roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left")
    moved = materialise(components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))), "moved")
    renamed = roots.join(moved.select(F.col("id").alias("root"), F.col("root").alias("now")), "root", "left")
    return renamed.select("id", F.coalesce("now", "root").alias("root")).union(moved.join(roots.select("id"), "id", "left_anti").select("id", "root"))


def all_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Every verified link (``a, b``) among the members of buckets (``bucket, id``), and ``id, root`` of the linked ones.

    Each pair that meets is compared once, also inside a class, so that the links can be counted.
    """
    left, right = (members.select("bucket", F.col("id").alias(c)) for c in "ab")
    pairs = materialise(left.join(right, "bucket").filter(F.col("a") < F.col("b")).select("a", "b").distinct(), "pairs")
    links = materialise(verify(pairs).select("a", "b"), "links")
    return links, materialise(components(links), "roots")


#: Members of this side of a bucket meet all others, those of another side only the members of other sides.
BOTH = 2


def _of_several_classes(members: DataFrame) -> DataFrame:
    """The members of buckets (``bucket, root, side``) that hold more than one class, on more than one side."""
    ends = members.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("side").alias("first"), F.max("side").alias("last")
    )
    several = ends.filter((F.col("low") < F.col("high")) & ((F.col("first") < F.col("last")) | (F.col("last") == BOTH)))
    return materialise(members.join(several.select("bucket"), "bucket", "left_semi"), "members")


def linked_classes(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    least: tuple[int, int] = (0, 1),
    refile: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verified links (``a, b``) among the members of buckets (``bucket, id, size``), and ``id, root`` of the linked ones.

    ``verify`` keeps the true ones of candidate pairs (``a, b``); pairs whose sizes have a lower ratio than ``least``
    can't be true and aren't made.

    Members that meet many others, such as the source of many copies, lead their buckets. At first each member
    is compared with the greatest of its leads, which links most of a group at one comparison per member. Then a
    bucket's lead is compared with all members of other classes; then, where members of several classes are
    left, the next ``MORE`` of them, and so on with ever more, until a bucket's members are of one class or all
    compared. So no link between classes is lost, and the rounds grow with the logarithm of what is left.

    ``refile`` gives the members (``id``) left after the first comparison other buckets, ``bucket, id, side``, in which all
    true pairs among them meet, and fewer others do.
    """
    links = members.sparkSession.createDataFrame([], members.select(F.col("id").alias("a"), F.col("id").alias("b")).schema)
    crowds = members.groupBy("bucket").agg(F.count("*").alias("n"))
    met_by = members.join(crowds, "bucket").groupBy("id").agg(F.sum("n").alias("meets"))
    ranked = members.join(met_by, "id").select("bucket", "id", "size", "meets", F.col("id").alias("root"), F.lit(BOTH).alias("side"))
    now, roots, leads, greatest = materialise(ranked, "members"), None, 1, True
    while True:
        # Tasks hand on only the first members of each bucket that they hold.
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("meets"), "id"))
        first = now.withColumn("place", place).filter(F.col("place") <= leads)
        first = first.select("bucket", *(F.col(c).alias(f"lead_{c}") for c in ("id", "root", "size", "meets", "side")))
        first = materialise(first, "leads")
        sizes = F.least("size", "lead_size") * least[1] >= F.greatest("size", "lead_size") * least[0]
        sides = (F.col("side") != F.col("lead_side")) | (F.col("side") == BOTH)
        met = now.join(first, "bucket").filter((F.col("id") != F.col("lead_id")) & (F.col("root") != F.col("lead_root")) & sizes & sides)
        if greatest:
            met = met.groupBy("id").agg(F.max_by("lead_id", F.struct("lead_meets", "lead_id")).alias("lead_id"))
        pairs = met.select(F.least("id", "lead_id").alias("a"), F.greatest("id", "lead_id").alias("b")).distinct()
        found = materialise(verify(pairs).select("a", "b"), "links")
        if roots is None or not found.isEmpty():
            links = links.union(found)
            roots = materialise(components(found) if roots is None else merged(roots, found), "roots")
        rest = now.drop("root") if greatest else now.drop("root").join(first.select("bucket", F.col("lead_id").alias("id")), ["bucket", "id"], "left_anti")
        rest = rest.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        rest = materialise(rest.select(*ranked.columns), "rest")
        now = _of_several_classes(rest)
        if greatest and refile is not None and not now.isEmpty():
            own = now.select(*(c for c in ranked.columns if c not in ("bucket", "side"))).distinct()
            anew = refile(own.select("id")).join(own, "id").select(*ranked.columns)
            now = _of_several_classes(materialise(anew, "refiled"))
        if now.isEmpty():
            return links.distinct(), roots
        leads, greatest = leads if greatest else leads * MORE, False
