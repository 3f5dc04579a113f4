"""Mixing sources to target weights by capped water-filling.

Each source asks for a share of the mix by its weight; a target stops at ``max_epochs`` times the
source's size and what it cannot take is shared among the others by weight until none is above. A
source's documents are taken whole as often as the target holds the source; the rest of the target
goes to a seeded order of its documents (md5 of seed and id): whole documents in that order, and the
leading words of the one where the target is reached.

The order's cut is found digit by digit on sums by hash prefix, so no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, written

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MIX_SHARE = 1.5
MAX_EPOCHS = 2.0
#: Lengths of the prefixes of a document's place in the order at which the cut is settled: of the md5 of its id first, and
#: where many documents share that (they share the id or have none), of the hash of its text and of the row's number that follow.
PREFIXES, MORE_PREFIXES = (2, 4, 6), tuple(range(32, 65, 4))
#: Documents at the cut of a source that are ordered one by one without settling it further; the order is the same either way.
EDGE_ROWS = 20_000
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds weight by the rank of ``source`` (code points, null last), without sorting all in one task."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = written(sources.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = {r["_part"]: r["n"] for r in per.collect()}  # one number for each partition
    starts, total = [], 0
    for part in sorted(before):
        starts += [F.lit(part), F.lit(total)]
        total += before[part]
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    if starts:
        rank = rank + F.create_map(*starts)[F.col("_part")]
    names = F.array(*(F.lit(float(w)) for w in weights))
    return dealt.withColumn("weight", F.get(names, (rank % len(weights)).cast("int"))).drop("_part")


def water_fill(sources: DataFrame, mix_share: float = MIX_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds target to (source, source_size, weight): a few numbers reach the driver in each round."""
    cap = F.col("source_size") * F.lit(max_epochs)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.lit(level) * F.col("weight") >= cap
        row = sources.agg(F.sum(F.when(~full, F.col("weight"))).alias("w"), F.sum(F.when(full, cap)).alias("full")).first()
        if not row["w"]:
            level = float("inf") if row["full"] else level
            break
        new = (mix_share * total - (row["full"] or 0.0)) / row["w"]
        if new <= level:
            break
        level = new
    if level == float("inf"):
        return sources.withColumn("target", cap)
    return sources.withColumn("target", F.when(F.lit(level) * F.col("weight") >= cap, cap).otherwise(F.lit(level) * F.col("weight")))


def _prefix_cut(docs: DataFrame, cuts: DataFrame, prefixes: tuple[int, ...]) -> DataFrame:
    """Moves cut (a prefix of the order) and left of each source on: documents below the prefix are taken, of those at it ``left`` words."""
    names = cuts.columns
    for digits in prefixes:
        cuts = written(cuts, "cuts")
        inside = docs.join(cuts.select("skey", "cut"), "skey").where((F.col("cut") == "") | F.col("order").startswith(F.col("cut")))
        sums = inside.groupBy("skey", F.substring("order", 1, digits).alias("prefix")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("skey").orderBy("prefix")
        run = sums.withColumn("_to", F.sum("words").over(w)).withColumn("_from", F.col("_to") - F.col("words"))
        found = run.join(cuts.select("skey", "left"), "skey").where((F.col("_from") <= F.col("left")) & (F.col("left") < F.col("_to"))).select("skey", "prefix", "_from")
        cuts = cuts.join(written(found, "found"), "skey", "left").withColumn("left", F.col("left") - F.coalesce("_from", F.lit(0)))
        # Without a prefix where the sum passes, all documents are taken: the cut lies behind the last.
        cuts = cuts.withColumn("cut", F.coalesce("prefix", F.lit("g"))).select(*names)
    return written(cuts, "cuts")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, mix_share: float = MIX_SHARE, max_epochs: float = MAX_EPOCHS, size: Callable[[Column], Column] = word_count, seed: int = SEED, keep: str | None = None) -> DataFrame:
    """(id_col, size, source, source_size, target, taken[, keep]) for each row of ``df``.

    A null text has size 0, a null source is a source of its own and ranks last, a source of size 0
    has target 0. Rows that share source and hash of the id are taken in the order of their texts' hashes; equal rows and null
    ids count each, and of equal rows as many are taken as the cut leaves room for, whichever. Whole texts count, however long. Other columns of ``df``
    do not matter; an id column that is called like one of the result's gets an underscore before its name. An empty
    table gives an empty result.
    """
    more = [F.col(keep).alias("_keep")] if keep else []
    docs = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_text"), *more)
    order = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")), F.lower(F.lpad(F.hex("_text"), 16, "0")))
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    number = F.lower(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))  # tells equal rows apart; fixed once the table is written
    docs = written(docs.withColumn("skey", skey).withColumn("order", F.concat(order, number)), "sizes")
    sources = written(docs.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), "sources")
    sources = water_fill(written(ranked_weights(sources, weights), "weights"), mix_share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", whole).select("skey", "source_size", "target", "whole", F.bround(F.col("target") - F.col("whole") * F.col("source_size"), 0).cast("bigint").alias("left"))
    digits = PREFIXES[-1]
    cuts = _prefix_cut(docs, written(sources.withColumn("cut", F.lit("")), "targets"), PREFIXES)
    joined = docs.join(cuts, "skey")
    # Only the documents at the cut are ordered one by one: usually one in 16 to the power of 6 of a source.
    crowd = joined.where(F.substring("order", 1, digits) == F.col("cut")).groupBy("skey").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if crowd > EDGE_ROWS:
        digits = MORE_PREFIXES[-1]
        joined = docs.join(_prefix_cut(docs, cuts, MORE_PREFIXES), "skey")
    prefix = F.substring("order", 1, digits)
    edge = written(joined.where(prefix == F.col("cut")), "edge")
    to = F.sum("size").over(Window.partitionBy("skey").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - (to - F.col("size")))))
    rest = joined.where(prefix != F.col("cut")).withColumn("part", F.when(prefix < F.col("cut"), F.col("size")).otherwise(0))
    both = rest.unionByName(edge)
    names = ["size", "source", "source_size", "target", "taken"]
    taken = (F.col("whole") * F.col("size") + F.col("part")).cast("bigint").alias("taken")
    return both.select(F.col("_id").alias(free_name(names, id_col)), "size", "source", "source_size", "target", taken, *([F.col("_keep").alias(free_name([*names, id_col], keep))] if keep else []))


def _by_rank(rows: DataFrame, group: tuple[str, ...], ways: str) -> DataFrame:
    """Turns ``ways``, an array of (taken, n) that a group's rows share, into one number: the first n rows are taken so, and so on.

    Rows are numbered inside the partitions of a written table and go on from the partitions before, so a
    large group is in no single task.
    """
    place, row, before = (free_name(rows.columns, c) for c in ("_place", "_row", "_before"))
    rows = written(rows.withColumns({place: F.spark_partition_id(), row: F.monotonically_increasing_id()}), "equal")
    per = rows.groupBy(*group, place).agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(*(F.col(c).alias(f"{before}{i}") for i, c in enumerate((*group, place))), earlier.alias(before))
    met = [F.col(c).eqNullSafe(F.col(f"{before}{i}")) for i, c in enumerate((*group, place))]
    rank = F.col(before) + F.row_number().over(Window.partitionBy(*group, place).orderBy(row))
    ranked = rows.join(offsets, met).withColumn(row, rank)
    upto = F.transform(F.sequence(F.lit(1), F.size(ways)), lambda i: F.struct(F.aggregate(F.slice(ways, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, w: a + w["n"]).alias("to"), F.get(ways, i - 1)["taken"].alias("taken")))
    taken = F.get(F.filter(upto, lambda u: F.col(row) <= u["to"]), F.lit(0))["taken"]
    return ranked.withColumn(ways, taken).select(*(c for c in rows.columns if c not in (place, row)))


def sampled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: rows of ``df`` as often as they are taken whole, and the leading words of a document taken in part.

    Rows are told apart by id, source and text: rows may share an id or have none, and of rows that share all three as
    many are taken as often as ``mix`` says. Rows without words are in no mix. A document taken in part keeps its white
    space. Otherwise as ``mix``; columns of ``df`` may have any names.
    """
    columns = df.columns
    key, source, body, size, n, part = (free_name(columns, c) for c in ("_key", "_source", "_body", "_size", "_taken", "_part"))
    hashed = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("body"))
    taken = mix(hashed, "id", "text", "source", keep="body", **how)
    each = taken.groupBy("id", "source", "body", "size", "taken").agg(F.count("*").alias("n"))  # equal rows are taken in three ways at most: fully, in part, not at the cut
    each = each.groupBy("id", "source", "body", "size").agg(F.sort_array(F.collect_list(F.struct("taken", "n")), asc=False).alias("each")).where("each[0].taken > 0")
    each = written(each.select(F.col("id").alias(key), F.col("source").alias(source), F.col("body").alias(body), F.col("size").alias(size), F.col("each").alias(n)), "taken")
    keyed = df.withColumn(body, F.xxhash64(text_col))

    def joined(own: DataFrame) -> DataFrame:
        met = keyed.join(own, keyed[id_col].eqNullSafe(own[key]) & keyed[source_col].eqNullSafe(own[source]) & (keyed[body] == own[body]))
        return met.select(*(keyed[c] for c in columns), own[key], own[source], own[body], own[size], own[n])

    alike = F.size(n) == 1
    split = each.where(~alike)  # equal rows of which some are taken oftener: those at a source's limit, one set for each source
    out = joined(each.where(alike).hint("merge")).withColumn(n, F.col(n)[0]["taken"])  # as a broadcast would shuffle no texts in a small table only
    if not split.isEmpty():
        out = out.unionByName(_by_rank(joined(split), (key, source, body), n))
    joined = out.where(F.col(n) > 0)
    whole, rest = (F.col(n) / F.col(size)).cast("int"), (F.col(n) % F.col(size)).cast("int")
    parts = F.concat(F.array_repeat(F.col(size).cast("int"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = joined.withColumn(part, F.explode(parts))
    pieces = F.split(text_col, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # words, each with the white space before it
    cut = F.when(F.col(part) == F.col(size), F.col(text_col)).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col(part)), ""))
    return rows.withColumn(text_col, cut).select(*columns)
