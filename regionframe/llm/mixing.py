"""Mixing sources to target weights: subset-sum budget fitting over a histogram of exact lengths.

Targets: every source has a share of the whole by its weight, never above three times its size; what is cut off is
shared again by weight. Each source takes whole epochs, then fits the rest of its budget: documents are counted by exact
length, a bounded knapsack over those counts says how many of each length to take, and a seeded hash says which. A budget
is dealt in proportion first; the knapsack then adds and takes back documents, within sums RESERVE from the dealt one.
Where that leaves the total further from the budget than it has to be, sums twice as far are let in, and so on up to a
distance that follows from the longest document alone, whatever the budget (see fit()).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionframe.llm.shared import Stages, table

WEIGHTS, MOST = (5, 2, 1), 3
RESERVE = 1 << 16  # how far from the dealt sum, in common divisors of the lengths, the dynamic program looks at first
FURTHEST = 1 << 24  # and at last: its table has two cells of five bytes for each


def size_of(text: Column) -> Column:
    """Words: runs of anything but the six ASCII white-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with target and weight added. One row a source: the windows run over sources, not documents.

    In order of size a weight, a source is capped where even its share of what the capped ones before it leave, among
    itself and those after it, is above MOST times its size.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(place) - 1) % len(WEIGHTS) + 1))
    s = s.withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("used", F.coalesce(F.sum("cap").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(before.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.col("used")) / F.col("left"))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())  # it falls after the first source not capped
    return s.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (ascending, distinct, positive) to take so that their total is as close to the
    budget as any choice.

    All in units of the lengths' common divisor, L the longest length. Dealt in proportion and filled up, the sum is less
    than L below the budget, so the best total is 0 to 2 L above it. Order what has to be added and taken back so that the
    running change stays within 0 and 2 L: where it comes to the same value twice, what lies between changes nothing and can
    be left out. So a best choice needs at most 2 L documents moved, of which the added ones or those taken back are at most
    L, and no sum further than L * L + 2 L from the dealt one. A total next to the budget ends the search before. Lengths
    whose L * L + 2 L is above FURTHEST (documents of more than 4,000 divisors) can miss the closest total, if no sum
    within FURTHEST is next to the budget; then it is the closest within, less than L away.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    unit = int(np.gcd.reduce(lengths))
    cells = lengths // unit
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    left = budget - int((take * lengths).sum())
    for i in range(len(lengths) - 1, -1, -1):
        n = min(int(counts[i] - take[i]), left // int(lengths[i]))
        take[i] += n
        left -= n * int(lengths[i])
    longest = int(cells[-1])
    nearest, last, far = min(left % unit, -left % unit), min(longest * longest + 2 * longest, FURTHEST), RESERVE
    while True:
        far = min(far, last)
        moved = moves(cells, counts - take, take, left / unit, far)
        if far == last or abs(int((moved * lengths).sum()) - left) == nearest:
            return take + moved
        far *= 2


def moves(lengths: np.ndarray, more: np.ndarray, less: np.ndarray, goal: float, far: int) -> np.ndarray:
    """The bounded knapsack: how many of each length to add (at most `more`) or take back (at most `less`) so that the sum
    changes by what is closest to `goal` (0 or more), over changes of at most `far`. first[s] is the step that made change s
    first; the change that it was made from was there before that step, so one number a change leads all the way back. A
    count is dealt in powers of two, so that few steps make all its sums."""
    low = min(far, int((less * lengths).sum()))
    first = np.full(low + min(far, int((more * lengths).sum())) + 1, -1, np.int32)
    first[low] = 0
    best, steps = low + math.ceil(goal - 0.5), [(0, 0)]
    for i in range(len(lengths) - 1, -1, -1):
        for sign, most in ((1, int(more[i])), (-1, int(less[i]))):
            n, part = min(most, (len(first) - 1) // int(lengths[i])), 1
            while n > 0 and not (best < len(first) and first[best] >= 0):
                part = min(part, n)
                by = part * int(lengths[i])
                was, now = (first[:-by], first[by:]) if sign > 0 else (first[by:], first[:-by])
                new = (was >= 0) & (now < 0)
                now[new] = len(steps)
                steps.append((i, sign * part))
                n, part = n - part, part * 2
    made, at = first >= 0, min(low + math.floor(goal), len(first) - 1)
    over = at + 1 + (int(np.argmax(made[at + 1 :])) if at + 1 < len(made) else 0)
    at -= int(np.argmax(made[at::-1]))  # change 0 is made, and not above the goal
    if over < len(made) and made[over] and over - low - goal < goal - (at - low):
        at = over
    out = np.zeros(len(lengths), np.int64)
    while step := int(first[at]):
        i, n = steps[step]
        out[i] += n
        at -= n * int(lengths[i])
    return out


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    epochs = min(MOST, int(target // size)) if size else 0
    some = pdf["size"].to_numpy() > 0
    more = np.zeros(len(pdf), np.int64)
    more[some] = fit(pdf["size"].to_numpy(np.int64)[some], pdf["docs"].to_numpy(np.int64)[some], math.floor(target) - epochs * size) if epochs < MOST else 0
    return pdf.assign(epochs=epochs, more=more)[["source", "size", "source_size", "target", "epochs", "more"]]


def lots(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, version, source, size, source_size, target, rows, epochs, more): for each different document of the table, which
    `rows` of it hold, that each row is taken `epochs` times and `more` of its rows once again. version tells apart rows of one
    doc_id that differ in any column."""
    stage = Stages(docs.sparkSession, "mixing")
    d = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _version(docs))
    d = stage(d.groupBy("doc_id", "version", "source", "size").agg(F.count("*").alias("rows")).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "version")), "documents")
    lengths = stage(d.groupBy("source", "size").agg(F.sum("rows").alias("docs"), F.count("*").alias("different")), "lengths")
    per_source = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).cast("long").alias("source_size")))
    plan = (
        lengths.alias("l").join(per_source.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")))
        .select("l.source", "size", "docs", "source_size", "target", F.col("l.source").isNull().alias("none"))
        .groupBy("source", "none").applyInPandas(_plan, "source string, size long, source_size long, target double, epochs int, more long")
    )
    # Which ones: the `more` rows of the smallest draws of each (source, length). A length that very many documents share is
    # ranked in slices, ranges of the draw: whole slices by their counts, and within a slice its own documents only. The
    # order is the draw's, however many slices there are.
    most = lengths.agg(F.max("different")).first()[0] or 0
    bits = max(6, (math.isqrt(most) // 2).bit_length())
    d = d.withColumn("slice", F.shiftright("draw", 64 - bits))
    keys = ["source", "size"]
    counted = d.groupBy(*keys, "slice").agg(F.sum("rows").alias("n"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = lambda a, b, *on: [F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")), *[F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in on]]
    due = counted.alias("c").join(plan.alias("p"), same("c", "p", "size")).select("c.source", "c.size", "slice", "before", "source_size", "target", "epochs", F.col("more").alias("in_length"))
    own = Window.partitionBy(*keys, "slice").orderBy("draw", "doc_id", "version").rowsBetween(Window.unboundedPreceding, -1)
    ranked = d.withColumn("rank", F.coalesce(F.sum("rows").over(own), F.lit(0)))
    left = F.col("in_length") - F.col("before") - F.col("rank")
    joined = ranked.alias("d").join(due.alias("u"), same("d", "u", "size", "slice"))
    return joined.select("d.doc_id", "d.version", "d.source", "d.size", "source_size", "target", "rows", "epochs", F.least("rows", F.greatest(left, F.lit(0))).cast("long").alias("more"))


def _version(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns]).alias("version")


def repeated(df: DataFrame, times: Column, number: str, at_once: int = 10_000) -> DataFrame:
    """Each row `times` times, with its number from 0 on; a row that comes very often is dealt out to many tasks."""
    d = df.withColumn("times", times)
    few = d.where(F.col("times").between(1, at_once)).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    parts = d.where(F.col("times") > at_once).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / at_once))))
    parts = parts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last = F.least((F.col("part") + 1) * at_once, F.col("times")) - 1
    many = parts.withColumn(number, F.explode(F.sequence(F.col("part") * at_once, last))).drop("part")
    return few.unionByName(many).drop("times")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs): each document's words and how often the mix takes it (0 to 3).

    Needs doc_id, text and source. A null text has size 0, a null source is a source of its own and comes last. Documents
    without words are taken in their source's whole epochs only. Repeated rows are documents each, and which of them are
    taken does not matter; a text of any length is one document. An empty table gives no row. The result depends on the rows
    and the seed alone.
    """
    each = repeated(lots(docs, seed), F.col("rows"), "nth")
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") + (F.col("nth") < F.col("more")).cast("int")).alias("epochs"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Each document's size, its source's size and target, and the words of it that the mix takes; see mix()."""
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix, with their columns; one taken several times is there so often. Cases as in mix()."""
    chosen = lots(docs, seed).select(F.col("doc_id").alias("taken_id"), F.col("version").alias("taken_version"), (F.col("rows") * F.col("epochs") + F.col("more")).alias("copies"))
    # a document's rows are alike: one of them stands for all
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(row.alias("row"), F.col("doc_id").alias("own_id"), _version(docs).alias("own_version"))
    if d.groupBy("own_id", "own_version").agg(F.count("*").alias("n")).where("n > 1").head(1):
        d = d.groupBy("own_id", "own_version").agg(F.first("row").alias("row"))
    d = d.join(chosen.where("copies > 0"), F.col("own_id").eqNullSafe(F.col("taken_id")) & (F.col("own_version") == F.col("taken_version"))).select("row", "copies")
    return repeated(d, F.col("copies"), "nth").select("row.*")
