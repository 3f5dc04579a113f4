"""How filters interact: what each removes, step by step, in every order that they can be applied in.

A row's failures are a mask of bits, so all orders follow from counts of rows by mask. Everything is DataFrame work.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACES = r"[\x20\x09-\x0D]+"
#: The filters by letter; the place of a letter is the number of its bit in a mask.
LETTERS = "ABCDE"
COPY = LETTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bits(*failures: Column) -> Column:
    mask = F.lit(0)
    for i, failed in enumerate(failures):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    return mask


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, which look at one text only."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return _bits(
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 2 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    )


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters that they fail, and how many of them are good and toxic.

    Texts are compared by their SHA-256 and leave the scan as such. Rows are counted by text, id and part before they are
    dealt out, so that copies and repeated rows are one row each; the first id of a text is found by a minimum and joined.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("body"), text_mask(text).alias("mask"))
    rows = rows.groupBy("body", "id", "part", "mask").agg(F.count("*").alias("n"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    spread = F.when(F.col("id").isNull(), F.hash("body")).otherwise(0)  # rows without an id meet no label and need no common task
    marked = rows.withColumn("spread", spread).join(said.withColumn("spread", F.lit(0)), ["id", "spread"], "left").fillna(False, ["good", "toxic"])
    own = F.struct(F.col("id").isNull().alias("unknown"), "id", "n")
    cells = marked.groupBy("body", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(own).alias("own"))
    cells = written(cells, "cells")
    least = cells.groupBy("body").agg(F.min(F.struct("own.unknown", "own.id")).alias("least"))
    first = F.when(F.col("least.unknown"), F.col("n")).when(F.col("own.id") == F.col("least.id"), F.col("own.n")).otherwise(0)
    both = cells.join(least, "body").select(
        "part", "good", "toxic", F.inline(F.array(F.struct("mask", first.alias("n")), F.struct((F.col("mask") + (1 << COPY)).alias("mask"), (F.col("n") - first).alias("n"))))
    )
    return both.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def orders(letters: str = LETTERS) -> Column:
    """The order array: all orders of the filters, each with the bits in its order. One literal, sent with the plan."""
    bit = {x: F.lit(1 << i) for i, x in enumerate(letters)}
    return F.array(*(F.struct(F.lit("".join(o)).alias("name"), F.array(*(bit[x] for x in o)).alias("bits")) for o in permutations(letters)))


def _folded(cell: Column, all_orders: Column) -> Column:
    """The cell's counts after each step of each order, one after the other."""
    shape = "array<struct<bit:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"

    def step(state: Column, bit: Column) -> Column:
        fails = cell["mask"].bitwiseAND(bit) != 0
        weight = lambda test, of="n": F.when(test, cell[of]).otherwise(F.lit(0).cast("bigint"))
        alive = state["alive"]
        counts = F.struct(
            bit.alias("bit"),
            weight(alive & ~fails).alias("kept"),
            weight(alive & fails).alias("removed"),
            weight(~alive & fails).alias("redundant"),
            weight(cell["mask"] == bit).alias("unique_fails"),
            weight(alive & fails, "good").alias("good_lost"),
            weight(alive & fails, "toxic").alias("toxic_lost"),
        )
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    start = F.struct(F.lit(True).alias("alive"), F.array().cast(shape).alias("steps"))
    return F.flatten(F.transform(all_orders, lambda o: F.aggregate(o["bits"], start, step, lambda s: s["steps"])))


def order_audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order and step, from counts of rows by mask (as ``mask_cells`` gives them).

    A part has at most 2^filters cells, so its list is bounded. The lists' elements are added place by place.
    """
    all_orders = orders(letters)
    lists = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).withColumn("orders", all_orders)
    add = lambda a, b: F.struct(b["bit"].alias("bit"), *((a[c] + b[c]).alias(c) for c in COUNTS))
    nothing = F.struct(F.lit(0).alias("bit"), *(F.lit(0).cast("bigint").alias(c) for c in COUNTS))
    zeros = F.transform(F.flatten(F.transform("orders", lambda o: o["bits"])), lambda _: nothing)
    total = F.aggregate("cells", zeros, lambda acc, cell: F.zip_with(acc, _folded(cell, F.col("orders")), add))

    def of_filter(steps: Column) -> Column:
        removed = lambda bit: F.aggregate(F.filter(steps, lambda s: s["bit"] == bit), F.lit(0).cast("bigint"), lambda acc, s: acc + s["removed"])
        return F.transform(F.array(*(F.lit(1 << i) for i in range(len(letters)))), removed)

    both = F.transform(F.array(total), lambda steps: F.struct(steps.alias("steps"), of_filter(steps).alias("by_filter")))  # the lambda's name binds the total: it is worked out once
    rows = lists.select("part", "orders", F.inline(both)).select("part", "orders", "by_filter", F.posexplode("steps").alias("at", "s"))
    name = F.get("orders", F.floor(F.col("at") / len(letters)).cast("int"))["name"]
    place = F.log2(F.col("s.bit").cast("double")).cast("int")
    return rows.select("part", name.alias("filter_order"), (F.col("at") % len(letters) + 1).cast("int").alias("step"), *(F.col(f"s.{c}").alias(c) for c in COUNTS), F.get("by_filter", place).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, six counts, shapley) of the five filters on whole texts, zeros included.

    A null text is empty and a null part is the empty string. Rows are counted one by one, repeated ones too: E fails a
    row if a row with a smaller id has its text, so rows that share the smallest id all pass; a row without an id comes
    after all ids and is no smaller than another without one. A document is good or toxic if any row of ``labels`` of its id
    says so; labels of null ids are of no document. An empty table gives no rows; other columns do not matter.
    """
    return order_audit(mask_cells(docs, labels, id_col, text_col, part_col))
