"""Window-shaped operators: sessions, caps, quotas, picks."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.stored import checkpoints


def gap_sessions(df: DataFrame, by: list[str], at: str, gap_minutes: float, *ties: str) -> DataFrame:
    """session: a new one where more than the gap lies since the row before (a gap of just that joins)."""
    w = Window.partitionBy(*by).orderBy(at, *ties)
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.when(seconds - F.lag(seconds).over(w) <= int(gap_minutes * 60_000_000), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def turns(df: DataFrame, chat: str, sender: str, at: str, text: str, gap_minutes: int = 10, most_chars: int = 1500, seq: str = "seq") -> DataFrame:
    """chat, run, batch, sender, started_at, messages, text: one sender's messages, cut at a gap since the last message, and where the text would outgrow the cap.

    Runs of one sender without a gap come from a window; only the cap depends on what was kept so far, and is folded within a run."""
    w = Window.partitionBy(chat).orderBy(at, seq)
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.when((F.lag(sender).over(w) == F.col(sender)) & (seconds - F.lag(seconds).over(w) <= gap_minutes * 60_000_000), 0).otherwise(1)
    runs = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    runs = runs.select(chat, "run", sender, at, seq, F.coalesce(text, F.lit("")).alias("text")).withColumn("size", F.length("text") + 1)
    cut = greedy_batches(runs, [chat, "run"], [at, seq], "size", most_chars + 1)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, seq, "text"))), lambda m: m["text"]), "\n")
    return cut.groupBy(chat, "run", "batch").agg(F.min(sender).alias(sender), F.min(at).alias("started_at"), F.count("*").alias("messages"), body.alias("text"))


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Intervals that overlap or lie within the gap as one; overlap counts once."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("__new", F.when(F.col(start) <= reached + gap, 0).otherwise(1)).withColumn("merged", F.sum("__new").over(w))
    return flagged.groupBy(*by, "merged").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("parts"))


def best_per(df: DataFrame, by: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of every group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def capped_selection(df: DataFrame, group: str, preferred: Column, order: list[Column], target: int, share: float = 0.08, floor: int = 3) -> DataFrame:
    """target rows: the best row of each preferred group, then by merit under a cap per group, then by merit alone."""
    cap = max(floor, int(target * share))
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(w)).withColumn("__pass", F.when(preferred & (F.col("__r") == 1), 0).when(F.col("__r") <= cap, 1).otherwise(2))
    return ranked.orderBy("__pass", *order).limit(target).drop("__r").withColumnRenamed("__pass", "pass")


def numbered(df: DataFrame, *order: Column, name: str = "row") -> DataFrame:
    """df with the place of each row in one order over all, from 0.

    The sorted rows are checkpointed; a row's place is its place in its partition and the sizes of those before, one number
    a partition."""
    checkpoints(df.sparkSession)
    at = F.col("__at")
    rows = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    sizes = rows.groupBy(F.shiftright(at, 33).cast("int").alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = dict(zip([r["part"] for r in sizes], accumulate([0] + [r["n"] for r in sizes])))
    if not starts:
        return rows.withColumn(name, at).drop("__at")
    before = df.sparkSession.createDataFrame(list(starts.items()), "__part int, __before long")
    placed = rows.withColumn("__part", F.shiftright(at, 33).cast("int")).join(F.broadcast(before), "__part")
    return placed.withColumn(name, F.col("__before") + at.bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def even_batches(df: DataFrame, order: list[Column], total: int, size: int = 400) -> DataFrame:
    """ceil(total / size) batches of even size (the first get one more), in order."""
    batches = max(1, -(-total // size))
    base, more = divmod(total, batches)
    row, large = F.col("__row"), more * (base + 1)
    batch = F.when(row < large, F.floor(row / (base + 1))).otherwise(more + F.floor((row - large) / max(base, 1)))
    return numbered(df, *order, name="__row").withColumn("batch", (batch + 1).cast("int")).drop("__row")


def batch_winners(batched: DataFrame, merit: list[Column], n: int = 1) -> DataFrame:
    """The first n of each batch: what goes to the next round of a tournament."""
    return best_per(batched, ["batch"], *merit, n=n)


def greedy_batches(df: DataFrame, by: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """batch: a new one where the sum would pass the budget. Depends on what was kept, so a group's costs are folded in order.

    The fold keeps where batches start; rows are then cut there, so that a group takes time in proportion to its rows."""
    row = F.struct(*order, F.col(cost).cast("double").alias("__cost"), F.struct(*[c for c in df.columns if c not in by]).alias("__row"))
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("__all"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.array(F.lit(1)).alias("starts"))

    def step(a: Column, x: Column) -> Column:
        full = (a["sum"] > 0) & (a["sum"] + x["__cost"] > budget)
        starts = F.when(full, F.concat(a["starts"], F.array(a["at"] + 1))).otherwise(a["starts"])
        return F.struct(F.when(full, x["__cost"]).otherwise(a["sum"] + x["__cost"]).alias("sum"), (a["at"] + 1).alias("at"), starts.alias("starts"))

    cuts = rows.withColumn("__starts", F.aggregate("__all", start, step)["starts"])

    def piece(s: Column, i: Column) -> Column:
        end = F.coalesce(F.get("__starts", i + 1), F.size("__all") + 1)
        return F.transform(F.slice("__all", s, end - s), lambda x: F.struct(x["__row"].alias("row"), i.alias("batch")))

    return cuts.select(*by, F.explode(F.flatten(F.transform("__starts", piece))).alias("x")).select(*by, "x.row.*", "x.batch")


def quota_admission(df: DataFrame, by: list[str], held: Column, order: list[Column], room: int) -> DataFrame:
    """admitted: held rows always, new ones while room remains."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(held, 0).otherwise(1)
    return df.withColumn("admitted", held | (F.sum(new).over(w) <= room))


def even_picks(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows evenly spaced by rank: round(i * (n - 1) / (k - 1)), halves to even."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / float(max(k - 1, 1)), 0).cast("int"))
    return ranked.filter((F.col("__n") <= k) | F.array_contains(picks, F.col("__i"))).drop("__i", "__n")


def recent_one_per_source(df: DataFrame, by: list[str], source: str, order: list[Column], cap: int = 5) -> DataFrame:
    """The newest of every source before anyone's second."""
    nth = F.row_number().over(Window.partitionBy(*by, source).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__nth", *order))
    return df.withColumn("__nth", nth).withColumn("place", place).filter(F.col("place") <= cap).drop("__nth")


def switch_points(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the last known one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    last = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", last).filter(F.col(value).isNotNull() & F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def round_robin(items: DataFrame, group: str, category: str, cost: str, budget: float, order: str) -> DataFrame:
    """Under a group's budget, one item of each category in turn; a category closes at its first misfit."""
    kinds = dict(items.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = {c: list(p.sort_values(order).itertuples(index=False)) for c, p in pdf.groupby(category, sort=True)}
        spent, out = 0.0, []
        while queues:
            for c in list(queues):
                row = queues[c].pop(0)
                if spent + getattr(row, cost) > budget:
                    del queues[c]
                    continue
                spent += getattr(row, cost)
                out.append((getattr(row, group), c, getattr(row, order), len(out)))
                if not queues[c]:
                    del queues[c]
        return pd.DataFrame(out, columns=[group, category, order, "place"])

    return items.select(group, category, order, F.col(cost).cast("double").alias(cost)).groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, {category} {kinds[category]}, {order} {kinds[order]}, place long")


def min_gap(df: DataFrame, by: list[str], at: str, gap: float, most: int, end: float | None = None) -> DataFrame:
    """Times in order, those closer than the gap to the last KEPT one left out, then the first few."""
    times = df if end is None else df.filter(F.col(at) <= end)
    lists = times.groupBy(*by).agg(F.array_sort(F.collect_list(F.col(at).cast("double"))).alias("t"))
    next_one = lambda a, x: (F.size(a) == 0) | (F.size(a) < most) & (x - F.try_element_at(a, F.lit(-1)) >= gap)
    kept = F.aggregate("t", F.array().cast("array<double>"), lambda a, x: F.when(next_one(a, x), F.concat(a, F.array(x))).otherwise(a))
    return lists.select(*by, F.posexplode(F.slice(kept, 1, most)).alias("place", at))


def even_split(sizes: DataFrame, by: list[str], kind: str, size: str, total: int) -> DataFrame:
    """by, kind, share: even shares of a total over a group's few types, the remainder to the earlier; what a type can't take
    goes, one at a time and in turn, to those with room.

    Whole turns are counted by bisection over a group's list of sizes; the rest of a turn goes to the first with room."""
    w = Window.partitionBy(*by)
    i = F.row_number().over(w.orderBy(kind)) - 1
    rows = sizes.select(*by, kind, F.greatest(F.col(size).cast("long"), F.lit(0).cast("long")).alias("n"), i.alias("i")).withColumn("types", F.count("*").over(w))
    share = F.floor(F.lit(total) / F.col("types")) + (F.col("i") < total % F.col("types")).cast("long")
    rows = rows.withColumn("first", F.least("n", share)).withColumn("every", F.collect_list(F.struct("n", "first")).over(w))
    rows = rows.withColumn("spend", F.least(F.lit(total).cast("long"), F.sum("n").over(w)))
    taken = lambda turns: F.aggregate("every", F.lit(0).cast("long"), lambda a, x: a + F.least(x["n"], x["first"] + turns))
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(total.bit_length(), -1, -1)])
    turns = F.aggregate(bits, F.lit(0).cast("long"), lambda a, bit: F.when(taken(a + bit) <= F.col("spend"), a + bit).otherwise(a))
    rows = rows.withColumn("taken", F.least("n", F.col("first") + turns))
    rows = rows.withColumn("left", F.col("spend") - F.sum("taken").over(w)).withColumn("room", (F.col("n") > F.col("taken")).cast("int"))
    nth = F.sum("room").over(w.orderBy(kind).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("share", F.col("taken") + F.when((F.col("room") == 1) & (nth <= F.col("left")), 1).otherwise(0)).select(*by, kind, "share")
