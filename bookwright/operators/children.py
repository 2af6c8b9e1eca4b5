"""Control children with computed dates, and the due date of a parent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwright import schema as S
from bookwright.functions.dates import iso_text, subtract_weekdays


@dataclass(frozen=True)
class ControlRule:
    """A control child and how far its date lies from the earliest source date."""

    name: str
    days_after: int = 0
    weekdays_before: int = 0
    sets_parent_due: bool = False

    def due(self, earliest: Column) -> Column:
        shifted = subtract_weekdays(earliest, self.weekdays_before)
        return F.date_add(shifted, self.days_after) if self.days_after else shifted


# The control children of the batch rules, in order.
DEFAULT_RULES = (
    ControlRule("chase creative", weekdays_before=4, sets_parent_due=True),
    ControlRule("Check live status", days_after=2),
)


def earliest_due(children: DataFrame) -> DataFrame:
    """Earliest valid date per parent; parents without one give no row."""
    found = children.groupBy(*S.PARENT_KEY).agg(F.min("due").alias("earliest"))
    return found.filter(F.col("earliest").isNotNull())


def control_children(
    earliest: DataFrame, rules: Sequence[ControlRule] = DEFAULT_RULES, order_type: str | None = None
) -> DataFrame:
    """One child per parent and rule.

    The rules are literals of the plan, so they need no join. ``order_type`` is the type of the
    reports' row order, so that the rows line up with the source children.
    """
    date = F.col("earliest")
    entries = [
        F.struct(F.lit(i).alias("section"), F.lit(rule.name).alias("subtask_name"), rule.due(date).alias("due"))
        for i, rule in enumerate(rules, start=1)
    ]
    rows = earliest.select(*S.PARENT_KEY, "earliest", F.inline(F.array(*entries)))
    no_row = F.lit(None).cast(order_type or "bigint")
    return rows.select(
        *S.PARENT_KEY,
        F.lit("").alias("our_ref"),
        "subtask_name",
        iso_text(date).alias("start_date_raw"),
        "due",
        F.lit(S.KIND_CONTROL).alias("subtask_kind"),
        F.struct(F.col("section"), no_row.alias("row_ord")).alias("child_ord"),
    )


def all_children(source: DataFrame, control: DataFrame) -> DataFrame:
    return source.unionByName(control)


def children_with_controls(source: DataFrame, rules: Sequence[ControlRule] = DEFAULT_RULES) -> DataFrame:
    """Source children and the control children derived from them."""
    order_type = source.schema["child_ord"].dataType["row_ord"].dataType.simpleString()
    return all_children(source, control_children(earliest_due(source), rules, order_type))


def in_child_order(children: DataFrame) -> DataFrame:
    """Parents in report order, their source rows in file order, then the control rows.

    The sort spreads by all its columns, so a parent with very many children is cut too.
    """
    return children.orderBy(*S.PARENT_KEY, "child_ord")


def due_from_earliest(earliest: Column, rules: Sequence[ControlRule] = DEFAULT_RULES) -> Column:
    """Due date of a parent as text: that of the rule which sets it, else the earliest date."""
    leading = next((rule for rule in rules if rule.sets_parent_due), None)
    return iso_text(earliest if leading is None else leading.due(earliest))


def parent_due(parents: DataFrame, earliest: DataFrame, rules: Sequence[ControlRule] = DEFAULT_RULES) -> DataFrame:
    """``parent_due_on`` of every parent; ``""`` where no child has a date."""
    joined = parents.select(*S.PARENT_KEY).join(earliest, list(S.PARENT_KEY), "left")
    return joined.select(*S.PARENT_KEY, due_from_earliest(F.col("earliest"), rules).alias("parent_due_on"))
