"""Mix sources to target weights by entropy balancing.

Among all rates w per document that give every source its target of words and stay at or below
``most`` copies, entropy balancing takes those nearest to one: they minimise
sum(w log w - w + 1) subject to sum(w * size) = target. The dual is convex with one multiplier
per source, and its solution is an exponential tilt, w = min(most, exp(lambda * size / mean)).
A safeguarded Newton iteration solves it for all sources at once. Its gradient and curvature are
sums over documents, so they are taken as grouped sums over the (source, size) counts: a source
with a third of all rows is collapsed before anything is shuffled. State is one row per source.

Rates become copies by systematic rounding along the sizes inside bounded buckets: neighbours are of
nearly equal size, so a bucket's words are off by one document at most. One closing document per source,
the one with most room, is then taken in part so that the source meets its target.

Defined results. NULL text has size 0 and is taken as often as its rate says, which costs no words. A NULL source is
a source of its own and the last. Rows repeating id, source and text share their copies. Repeated ids with other
text are documents of their own. An empty table gives an empty result. Other columns are carried, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import repacked, row_key, table, word_count, written

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET_ROWS = 10_000
STEPS = 60
CLOSE = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """One row per distinct document with its words and how many rows repeat it."""
    return (
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _rid().alias("rid"))
        .groupBy("doc_id", "source", "size", "rid").agg(F.count("*").alias("rows"))
    )


def _rid() -> Column:
    return row_key(F.col("doc_id"), F.col("source"), F.col("text"))


def targets(histogram: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Words each source should give: shares by weight, filled up to ``most`` times its words.

    Sorted by capacity per weight, a source is full if its capacity is within its share of what
    the fuller ones before it leave; that is where resharing the excess ends. One row per source.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    full_first = Window.orderBy(F.col("capacity") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("words").over(everything)
    room = total - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    claims = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    spare = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    left = total - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(everything), F.lit(0))
    return (
        histogram.groupBy("source").agg(
            F.sum(F.col("size") * F.col("docs")).alias("words"), F.sum("docs").alias("docs"),
            F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
        .withColumn("capacity", F.lit(most) * F.col("words")).withColumn("weight", weight)
        .withColumn("full", F.col("capacity") * claims <= F.col("weight") * room)
        .withColumn("target", F.when(F.col("full"), F.col("capacity").cast("double"))
                    .otherwise(F.col("weight") * (left / spare)))
        .select("source", "words", "docs", "least", "full", "target",
                F.greatest(F.col("words") / F.col("docs"), F.lit(1.0)).alias("mean"))
    )


def _evaluated(histogram: DataFrame, state: DataFrame, tries: list[Column], most: int) -> DataFrame:
    """Words and their slope for every tried multiplier: (at, words, slope) triples in ``seen``."""
    rows = histogram.join(
        state.select(F.col("source").alias("of"), "mean", F.array(*tries).alias("tries")),
        F.col("source").eqNullSafe(F.col("of")))
    length, mass = F.col("size") / F.col("mean"), F.col("size") * F.col("docs")
    exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")  # the same in any order
    sums = []
    for i in range(len(tries)):
        at = F.col("tries")[i]
        capped = at * length >= F.log(F.lit(float(most)))
        rate = F.when(capped, F.lit(float(most))).otherwise(F.exp(at * length))
        sums += [exact(mass * rate).alias(f"f{i}"),
                 exact(F.when(capped, 0.0).otherwise(mass * length * rate)).alias(f"d{i}"),
                 F.first(at).alias(f"x{i}")]
    seen = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"f{i}").alias("f"), F.col(f"d{i}").alias("d"))
                     for i in range(len(tries))])
    return rows.groupBy("of").agg(*sums).select("of", seen.alias("seen"))


def multipliers(histogram: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """The dual's solution per source, NULL where a source is wholly taken or has no words.

    Each step tries the Newton points from both ends of the bracket, their secant, and two inner
    points; the bracket closes at least by half, so the bound on steps is never what stops it.
    """
    state = written(
        goal.withColumn("rise", F.col("target") > F.col("words")).select(
            "*",
            F.struct(F.when(F.col("rise"), 0.0).otherwise(
                F.log(F.col("target") / F.col("words")) * F.col("mean") / F.col("least")).alias("x"),
                F.lit(None).cast("double").alias("f"), F.lit(None).cast("double").alias("d")).alias("lo"),
            F.struct(F.when(F.col("rise"), F.log(F.lit(float(most))) * F.col("mean") / F.col("least"))
                     .otherwise(0.0).alias("x"),
                     F.lit(None).cast("double").alias("f"), F.lit(None).cast("double").alias("d")).alias("hi"),
            (F.col("full") | (F.col("words") == 0)).alias("done")), "mix-state")
    lo, hi, aim = F.col("lo"), F.col("hi"), F.col("target")
    inside = lambda x: F.least(F.greatest(F.coalesce(x, lo["x"]), lo["x"]), hi["x"])
    width = hi["x"] - lo["x"]
    safe = lambda a, b: F.when(b != 0, a / b)
    newton = [inside(lo["x"] + safe(aim - lo["f"], lo["d"])), inside(hi["x"] + safe(aim - hi["f"], hi["d"])),
              inside(lo["x"] + safe((aim - lo["f"]) * width, hi["f"] - lo["f"])),
              lo["x"] + width / 2, lo["x"] + width / 16]
    for step in range(STEPS):
        tries = [lo["x"], hi["x"]] if step == 0 else newton
        points = _evaluated(histogram, state.where("not done"), tries, most)
        seen = F.concat(F.coalesce("seen", F.array().cast("array<struct<x:double,f:double,d:double>>")),
                        F.array(lo, hi))
        valid = lambda p: p["f"].isNotNull()
        below = F.array_max(F.filter(seen, lambda p: valid(p) & (p["f"] < F.col("target"))))
        above = F.array_min(F.filter(seen, lambda p: valid(p) & (p["f"] >= F.col("target"))))
        near = lambda end: F.coalesce(F.abs(end["f"] - aim) <= F.greatest(aim * CLOSE, F.lit(1e-3)), F.lit(False))
        state = written(
            state.join(points, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
            .withColumn("below", F.coalesce(below, lo)).withColumn("above", F.coalesce(above, hi))
            .drop("lo", "hi", "seen").withColumnRenamed("below", "lo").withColumnRenamed("above", "hi")
            .withColumn("done", F.col("done") | near(F.col("lo")) | near(F.col("hi"))
                        | (F.col("hi.x") - F.col("lo.x") <= 1e-14 * F.abs(F.col("hi.x")))), "mix-state")
        if state.where("not done").isEmpty():
            break
    miss = lambda end: F.coalesce(F.abs(end["f"] - aim), F.lit(float("inf")))
    best = F.when(miss(lo) <= miss(hi), lo["x"]).otherwise(hi["x"])
    return state.select("source", "words", "target", "mean",
                        F.when(~F.col("full") & (F.col("words") > 0), best).alias("multiplier"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
         bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per distinct document: its rate, whole copies, and the words taken of it."""
    items = written(sizes(docs), "mix-sizes")
    histogram = written(
        items.groupBy("source", "size").agg(F.sum("rows").alias("docs")), "mix-histogram")
    goal = written(targets(histogram, weights, most), "mix-targets")
    tilt = multipliers(histogram, goal, most)
    buckets = max(1, -(-items.count() // bucket_rows))
    rate = F.when(F.col("multiplier").isNull(), float(most)).otherwise(
        F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("size") / F.col("mean"))))
    along = Window.partitionBy("source", "bucket").orderBy("size", "shuffled", "doc_id", "rid")
    started = F.pmod(F.xxhash64(F.lit("start"), "source", "bucket"), F.lit(1 << 20)) / float(1 << 20)
    rounded = written(
        items.withColumn("shuffled", F.xxhash64(F.lit("order"), "doc_id", "rid"))
        .withColumn("bucket", F.pmod("shuffled", F.lit(buckets)))
        .join(tilt.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("rate", rate)
        .withColumn("reached", F.floor(F.sum(F.col("rate") - F.floor("rate")).over(
            along.rowsBetween(Window.unboundedPreceding, 0)) + started))
        .withColumn("copies", (F.floor("rate") + F.col("reached")
                               - F.lag("reached", 1, 0).over(along)).cast("long"))
        .select("doc_id", "source", "rid", "rows", "size", "words", "target", "rate", "copies"), "mix-copies")
    single = F.when(F.col("rows") == 1, F.lit(True))
    taken = F.col("copies") * F.col("size")
    room = F.lit(most) * F.col("size") - taken
    pick = lambda by: F.max(F.when(single, F.struct(by.alias("by"), (-F.col("doc_id")).alias("order"),
                                                    F.col("rid").alias("rid"), F.col("doc_id").alias("id"))))
    closing = (
        rounded.groupBy("source").agg(
            (F.round(F.first("target")) - F.sum(taken * F.col("rows"))).cast("long").alias("missing"),
            pick(room).alias("more"), pick(taken).alias("less"))
        .withColumn("closer", F.when(F.col("missing") > 0, F.col("more")).otherwise(F.col("less")))
        .select(F.col("source").alias("of"), "closer.id", F.col("closer.rid").alias("closing_rid"),
                F.when(F.col("missing") > 0, F.least("missing", "closer.by"))
                .otherwise(F.greatest("missing", -F.col("closer.by"))).alias("part"))
    )
    closes = (F.col("rid") == F.col("closing_rid")) & F.col("doc_id").eqNullSafe(F.col("id"))
    return (
        rounded.join(closing, F.col("source").eqNullSafe(F.col("of")), "left")
        .withColumn("part", F.when(closes, F.col("part")).otherwise(F.lit(0)))
        .select("doc_id", "source", "rid", "rows", "size", "words", "target", "rate", "copies",
                (taken + F.coalesce("part", F.lit(0))).alias("taken"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed documents: every row once per whole copy, and the closing part as a row of its own.

    A part holds the words taken, joined by one space. Only closing documents have one.
    """
    chosen = plan(docs, weights, most).select(
        F.col("doc_id").alias("of"), F.col("rid").alias("of_rid"), "size", "copies", "taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", _rid().alias("rid"))
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.col("copies"))
    over = F.col("taken") - whole * F.col("size")
    joined = rows.join(chosen, (F.col("rid") == F.col("of_rid")) & F.col("doc_id").eqNullSafe(F.col("of"))).select(
        "row", F.explode(F.concat(
            F.array_repeat(F.lit(0).cast("long"), whole.cast("int")),
            F.when(over > 0, F.array(over)).otherwise(F.array().cast("array<bigint>")))).alias("cut"))
    words = F.filter(F.split("row.text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), " ")
    return repacked(joined, "row", text=F.when(F.col("cut") > 0, part).otherwise(F.col("row.text")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return (
        chosen.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
        .select("doc_id", "size", F.col("words").alias("source_size"), "target", "taken", "copies")
    )
