"""Mixing sources to target weights: pivotal dependent rounding (DataFrame functions only).

Every document of a source is wanted ``target / source size`` times. The integral part of that number is taken as it is;
the fractional parts are rounded by the pivotal method: two units meet, mass moves from one to the other at random
until one of them is integral, the other carries the residual on. Units of similar size meet, from the
largest down, so that the taken words stay near the target and the last draw is over a small document. The meetings form a reduction tree: units are dealt to blocks of about BLOCK, a block
settles all its units but one, and the residual units are dealt to blocks again, until one unit per source is left, which
is settled by one draw. A source with a third of all rows is only more blocks.

All draws are hashes of the units themselves, so a rerun, or a retried task, settles them alike.

Results in special cases: a document without words (null, empty) has size 0 and takes 0 words; a null source comes last;
rows with equal (doc_id, source, size) are one unit with a number of copies that is dealt evenly over the rows; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small, stored, uniform, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 64
SEED = 7
#: Sources that one task puts in order.
SOURCES_A_TASK = 50_000


def targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row per source.

    ``share`` of all words is dealt by weight; no source gets more than ``most`` times its size, the excess goes to the
    others by weight. That ends at ``min(cap, level * weight)`` with one common level, found by sums over the
    sources in the order of cap / weight.
    """
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    placed = _in_order(stored(per_source, "sources"), [F.col("source").asc_nulls_last()], ["source_size"])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = (placed.drop("before_source_size", "all_source_size").withColumn("weight", w)
         .withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight")))
    s = _in_order(stored(s, "caps"), ["ratio", "place"], ["source_size", "cap", "weight"], "rank")
    rest = F.least(F.col("all_source_size") * share, F.col("all_cap")) - F.col("before_cap")
    s = s.withColumn("level", rest / (F.col("all_weight") - F.col("before_weight")))
    # the first source in this order that the level does not fill sets the level of all
    first = s.where(F.col("ratio") >= F.col("level")).agg(F.min(F.struct("ratio", "place", "level"))["level"].alias("level"))
    return s.withColumn("common", first.scalar()).select(
        "source", "source_size", F.when(F.col("common").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("common") * F.col("weight"))).alias("target"))


def _in_order(table: DataFrame, order: list, sums: list[str], place: str = "place") -> DataFrame:
    """A stored table with each row's place (from 1), and per column c of ``sums`` before_c (of the rows before it) and all_c.

    Rows are cut into ranges of about SOURCES_A_TASK in ``order`` (which makes it total), so that no task holds all of them; what lies before
    a range is added from the sums of the ranges, one row each.
    """
    ranges = max(1, math.ceil(table.count() / SOURCES_A_TASK))
    ranged = stored(table.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in sums])
    held = totals.agg(F.collect_list(F.struct("part", "n", *sums)).alias("held")).scalar()
    in_range = Window.partitionBy("part").orderBy(*order)
    before = in_range.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("held", held)

    def added(c: str, rows: Column) -> Column:
        return F.aggregate(F.transform(rows, lambda x: x[c]), F.lit(0.0), lambda a, x: a + x)
    earlier = F.filter("held", lambda x: x["part"] < F.col("part"))
    new = {place: F.row_number().over(in_range) + added("n", earlier).cast("long")}
    for c in sums:
        new[f"before_{c}"] = F.coalesce(F.sum(F.col(c).cast("double")).over(before), F.lit(0.0)) + added(c, earlier)
        new[f"all_{c}"] = added(c, F.col("held"))
    return out.withColumns(new).drop("part", "held")


def _settle(unit_array: Column) -> Column:
    """The pivotal method along an array of units (p, size, key ...): struct(settled: [(key, up)], left: unit)."""
    start = F.struct(F.element_at(unit_array, 1).alias("left"),
                     F.array().cast("array<struct<key:bigint,up:int>>").alias("settled"))

    def meet(a: Column, b: Column) -> Column:
        x = a["left"]
        mass = x["p"] + b["p"]
        u = uniform(F.lit(SEED), x["key"], b["key"])
        low = mass < 1
        # below one, all mass goes to one of the two; from one on, one of the two is filled up
        b_leaves = F.when(low, u * mass < x["p"]).otherwise(u * (F.lit(2.0) - mass) >= F.lit(1.0) - x["p"])
        left = F.when(low, mass).otherwise(mass - 1)
        goes = F.when(low == b_leaves, b["key"]).otherwise(x["key"])
        stays = F.when(low == b_leaves, F.struct(left.alias("p"), x["size"].alias("size"), x["key"].alias("key"))).otherwise(
            F.struct(left.alias("p"), b["size"].alias("size"), b["key"].alias("key")))
        done = F.struct(goes.alias("key"), F.when(low, F.lit(0)).otherwise(F.lit(1)).alias("up"))
        return F.struct(stays.alias("left"), F.concat(a["settled"], F.array(done)).alias("settled"))

    return F.aggregate(F.slice(unit_array, 2, F.greatest(F.size(unit_array) - 1, F.lit(0))), start, meet)


def _blocks(frame: DataFrame, counts: DataFrame, level: int, keys: list[str]) -> DataFrame:
    """``frame`` with the number of its block: about BLOCK units of equal ``keys`` each."""
    many = F.ceil(F.col("n_units") / F.lit(BLOCK)).cast("long")
    return (frame.join(small(counts), keys).withColumn("block", F.pmod(F.xxhash64(F.lit(level), F.col("key")), many)).drop("n_units"))


def round_fractions(units: DataFrame) -> DataFrame:
    """units (src, key, p in (0, 1), size) -> (src, key, up 0/1) by a tree of blocks.

    The first level meets within bands of size, the next ones within the source.
    """
    settled, level = [], 0
    band = F.floor(F.log2(F.col("size").cast("double") + 1) * 4).cast("int")
    left = units.withColumn("band", band)
    while True:
        keys = ["src", "band"]
        counts = stored(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units")), f"counts{level}")
        most = counts.agg(F.max("n_units")).first()[0]
        if most is None or (level and most == 1):
            break
        dealt = _blocks(left, counts, level, keys)
        done = stored(dealt.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("size", "key", "p")), asc=False).alias("all"))
                      .select("src", _settle(F.transform("all", lambda x: F.struct(
                          x["p"].alias("p"), x["size"].alias("size"), x["key"].alias("key")))).alias("s")), f"level{level}")
        settled.append(done.select("src", F.explode("s.settled").alias("d")).select("src", "d.key", "d.up"))
        left = done.select("src", "s.left.key", "s.left.p", "s.left.size").withColumn("band", F.lit(0))
        level += 1
    out = left.select("src", "key", (uniform(F.lit(SEED), F.col("src"), F.col("key")) < F.col("p")).cast("int").alias("up"))
    for d in settled:
        out = out.unionByName(d)
    return out


def _units(docs: DataFrame, text: str) -> DataFrame:
    return (docs.select("doc_id", "source", F.size(words(F.col(text))).cast("long").alias("size"))
            .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))


def copies(docs: DataFrame, text: str = "text", **shares) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, copies): a row for each unit; ``copies`` for all its rows."""
    units = stored(_units(docs, text), "units")
    per_source = stored(targets(units, **shares), "targets").withColumnRenamed("source", "s_source")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("rows")
    key = F.xxhash64("doc_id", "source", "size")
    joined = units.join(small(per_source), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source").withColumns(
        {"wanted": wanted, "key": key, "src": F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))})
    joined = stored(joined.withColumns({"whole": F.floor("wanted"), "p": F.col("wanted") - F.floor("wanted")}), "wanted")
    fractions = joined.where((F.col("p") > 0) & (F.col("size") > 0)).select("src", "key", "p", "size")
    # two units with one key would be told apart by nothing: they are settled as often as they occur
    ups = round_fractions(fractions).groupBy("src", "key").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("of"))
    up = F.when(F.col("of") == 1, F.col("up")).otherwise(F.floor(F.col("up") / F.col("of")))
    return joined.join(ups, ["src", "key"], "left").select(
        "doc_id", "source", "size", "rows", "source_size", "target",
        (F.col("whole") + F.coalesce(up, F.lit(0))).cast("long").alias("copies"))


def _row_copies(place: Column, all_copies: Column, rows: Column) -> Column:
    """Copies of the row at ``place`` (from 0) of a unit: its copies dealt evenly over its rows."""
    each = F.floor(all_copies / rows)
    return (each + (place < all_copies - each * rows).cast("long")).cast("long")


def mix(docs: DataFrame, text: str = "text", **shares) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words), copies."""
    one = copies(docs, text, **shares).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    return one.withColumn("copies", _row_copies(F.col("place"), F.col("copies"), F.col("rows"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, text: str = "text", **shares) -> DataFrame:
    """The documents of the mix, each row as often as it is taken; columns as given."""
    p = fresh(docs, "m_")
    taken = copies(docs, text, **shares).where("copies > 0").select(
        F.col("doc_id").alias(f"{p}id"), F.col("source").alias(f"{p}source"), F.col("size").alias(f"{p}size"),
        F.col("rows").alias(f"{p}rows"), F.col("copies").alias(f"{p}copies"))
    sized = docs.withColumn(f"{p}words", F.size(words(F.col(text))).cast("long"))
    both = sized.join(taken, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & F.col("source").eqNullSafe(F.col(f"{p}source"))
                      & (F.col(f"{p}words") == F.col(f"{p}size")))
    # rows of one unit go by their text, then by their other columns, so that spare copies fall to the same rows in every run
    others = F.xxhash64(*[f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)])
    place = F.row_number().over(Window.partitionBy(f"{p}id", f"{p}source", f"{p}size").orderBy(text, others)) - 1
    times = _row_copies(F.col(f"{p}place"), F.col(f"{p}copies"), F.col(f"{p}rows"))
    return (both.withColumn(f"{p}place", place).withColumn(f"{p}times", times).where(f"{p}times > 0")
            .withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}times")))).select(*docs.columns))
