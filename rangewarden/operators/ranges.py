"""MRG and RNG: merging ranges, and taking whitelists out of them.

Prefixes nest or are disjoint, so containment is an equi-join on a length and a prefix: each prefix is
looked up once for each shorter length there is. Nothing compares all ranges with all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangewarden.functions.ipcalc import cidr_bounds, cidr_text, prefix_of, size_of
from rangewarden.shipping import ship

#: The length of the prefixes by which ranges are dealt.
BLOCK = 8
#: No length: a range that can't be joined.
BAR = 99


def parsed(df: DataFrame, column: str = "cidr") -> DataFrame:
    """df with start, end and len of its prefixes; nulls where the text isn't one."""
    start, end, length = cidr_bounds(F.col(column))
    return df.withColumns({"start": start, "end": end, "len": length})


def _ends(df: DataFrame) -> DataFrame:
    return df if "end" in df.columns else df.withColumn("end", F.col("start") + size_of(F.col("len")) - 1)


def remove_contained(ranges: DataFrame, *by: str) -> DataFrame:
    """MRG-2: ranges (start, len) that no other one contains; of equal ones one stays.

    Ranges of a /8 are one partition of the window. Shorter prefixes, 255 at most in a group, are compared among
    themselves, and what lies in a /8 that one of them holds goes.
    """
    df = ranges.select(*by, "start", "len").distinct()
    short = _outermost(df.where(F.col("len") < BLOCK), *by)
    blocks = short.select(*by, F.explode(F.sequence(_block("start"), _block(F.col("start") + size_of(F.col("len")) - 1))).alias("block")).distinct()
    long = df.where(F.col("len") >= BLOCK).withColumn("block", _block("start")).join(blocks, [*by, "block"], "left_anti")
    return short.union(_outermost(long, *by, "block").select(*by, "start", "len"))


def _block(address: Column | str) -> Column:
    """The /8 of an address."""
    return prefix_of(F.col(address) if isinstance(address, str) else address, BLOCK)


def _outermost(df: DataFrame, *by: str) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    return _ends(df).withColumn("reach", F.max("end").over(before)).where("reach IS NULL OR reach < end").select(*by, "start", "len")


def merge_siblings(ranges: list[tuple[int, int]], passes: int = 2) -> list[tuple[int, int]]:
    """MRG-3, 4: left-to-right passes that join two halves of a prefix. Two passes, and not until nothing changes: that is the rule."""
    now = sorted(ranges)
    for _ in range(passes):
        now = _pass(now)
    return now


def _pass(items: list[tuple[int, int]], arrives: list[bool] | None = None) -> list[tuple[int, int]]:
    """A pass over items in order; one that doesn't arrive, but was made in its place, isn't joined with the one before it."""
    out: list[tuple[int, int]] = []
    for i, (start, length) in enumerate(items):
        size = 1 << (32 - length) if length <= 32 else 0
        if size and out and (arrives is None or arrives[i]) and out[-1] == (start - size, length) and (start - size) % (2 * size) == 0:
            out[-1] = (start - size, length - 1)
        else:
            out.append((start, length))
    return out


def _merged_block(items: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Both passes within a /8, as (kind, start, len): kind tells when all of the /8 was one range, if it was: at first (0), after a pass (1, 2), or never (the rows, and a bar)."""
    items = sorted(items)
    for kind in "012":
        if len(items) == 1 and items[0][1] == BLOCK:
            return [(kind, *items[0])]
        if kind != "2":
            items = _pass(items)
    return [("bar", items[0][0], BAR), *(("done", *x) for x in items)]


def _stitched(rows: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Both passes over the /8s of _merged_block() and shorter ranges (kind 0): a bar stands for what can't be joined."""
    rows = sorted(rows, key=lambda x: x[1])
    first = _pass([(s, BAR if k == "2" else n) for k, s, n in rows], [k == "0" for k, _, _ in rows])
    late = {s for k, s, _ in rows if k == "2"}
    second = [(s, BLOCK if s in late and n == BAR else n) for s, n in first]
    return [x for x in _pass(second, [s not in late or n != BAR for s, n in first]) if x[1] != BAR]


def merge_ranges(ranges: DataFrame, *by: str) -> DataFrame:
    """MRG-1: what contains no other, with neighbouring halves joined by two passes.

    Each /8 is merged by itself. What is then one /8 as a whole, and shorter prefixes, 511 at most in a group, are merged
    in the same two passes, as if all had been one list.
    """
    ship(ranges.sparkSession)
    plain = remove_contained(ranges, *by)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name in by]

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_merged_block(list(zip(pdf["start"].tolist(), pdf["len"].tolist(), strict=True))), columns=["kind", "start", "len"])
        return out.assign(**{k: pdf[k].iloc[0] for k in by})[[*by, "kind", "start", "len"]]

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_stitched(list(zip(pdf["kind"].tolist(), pdf["start"].tolist(), pdf["len"].tolist(), strict=True))), columns=["start", "len"])
        return out.assign(**{k: pdf[k].iloc[0] for k in by})[[*by, "start", "len"]]

    blocks = plain.where(F.col("len") >= BLOCK).withColumn("block", _block("start")).groupBy(*by, "block").applyInPandas(of_block, ", ".join([*fields, "kind string", "start long", "len int"]))
    rest = blocks.where("kind <> 'done'").union(plain.where(F.col("len") < BLOCK).select(*by, F.lit("0").alias("kind"), "start", "len"))
    stitched = rest.groupBy(*by).applyInPandas(of_group, ", ".join([*fields, "start long", "len int"]))
    return blocks.where("kind = 'done'").select(*by, "start", "len").union(stitched)


def interval_union(ranges: DataFrame, *by: str) -> DataFrame:
    """RNG-1: intervals (start, end) joined where they overlap or touch.

    Intervals are cut at the borders of the /8s, whose parts are joined by themselves; of the results only those
    at a border, two at most in each /8, meet once more.
    """
    df = _ends(ranges).select(*by, "start", "end")
    parts = df.withColumn("block", F.explode(F.sequence(_block("start"), _block("end")))).withColumns({"lo": F.col("block") * size_of(BLOCK), "hi": (F.col("block") + 1) * size_of(BLOCK) - 1})
    parts = parts.select(*by, "block", F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"))
    joined = _islands(parts, *by, "block")
    border = (F.col("start") % size_of(BLOCK) == 0) | (F.col("end") % size_of(BLOCK) == size_of(BLOCK) - 1)
    return joined.where(~border).select(*by, "start", "end").union(_islands(joined.where(border), *by))


def _islands(df: DataFrame, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0)
    marked = df.select(*by, "start", "end").withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def cover(intervals: DataFrame) -> DataFrame:
    """RNG-3: the fewest prefixes (start, len) that make up each interval (start, end); other columns stay.

    At each depth they are the aligned blocks inside the interval whose parent isn't inside: two at most.
    """
    rest = [c for c in intervals.columns if c not in ("start", "end")]
    each = intervals.where("start <= end").withColumn("len", F.explode(F.sequence(F.lit(0), F.lit(32))))
    each = each.withColumn("z", size_of(F.col("len"))).selectExpr("*", "(start + z - 1) div z AS first", "(end + 1) div z - 1 AS last", "(start + 2 * z - 1) div (2 * z) AS above_first", "(end + 1) div (2 * z) - 1 AS above_last")
    blocks = each.where("first <= last").withColumn("b", F.explode(F.array_distinct(F.array("first", "last"))))
    outside = F.expr("len = 0 OR b div 2 < above_first OR b div 2 > above_last")
    return blocks.where(outside).select(*rest, (F.col("b") * F.col("z")).alias("start"), "len")


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner's rows (key, start, len) joined with the outer prefixes (wstart, wlen) that contain them."""
    lengths = outer.agg(F.collect_set("wlen")).scalar()  # 33 at most
    looked = inner.withColumn("wlen", F.explode(lengths)).where("wlen <= len").withColumn("wprefix", prefix_of(F.col("start"), F.col("wlen")))
    return looked.join(outer.withColumn("wprefix", prefix_of(F.col("wstart"), F.col("wlen"))), ["wlen", "wprefix"])


def _white(white: DataFrame) -> DataFrame:
    df = white if "start" in white.columns else parsed(white)
    return df.where("start IS NOT NULL").select(F.col("start").alias("wstart"), F.col("len").alias("wlen")).distinct()


def drop_fully_whitelisted(black: DataFrame, white: DataFrame) -> DataFrame:
    """RNG-5, JOIN-2: ranges (cidr) that no single entry of the whitelist contains; texts that aren't prefixes stay."""
    df = black.select(F.monotonically_increasing_id().alias("ord"), "cidr") if "ord" not in black.columns else black.select("ord", "cidr")
    inside = _within(parsed(df).where("start IS NOT NULL"), _white(white)).select("cidr").distinct()
    return df.join(inside, "cidr", "left_anti").select("ord", "cidr")


def _cut(intervals: DataFrame, *keep: str) -> DataFrame:
    """Intervals (start, end) cut at the borders of the /8s, with their block."""
    parts = intervals.withColumn("block", F.explode(F.sequence(_block("start"), _block("end"))))
    return parts.select(*keep, "block", F.greatest("start", F.col("block") * size_of(BLOCK)).alias("start"), F.least("end", (F.col("block") + 1) * size_of(BLOCK) - 1).alias("end"))


def _left(black: pd.DataFrame, white: pd.DataFrame) -> pd.DataFrame:
    """Of a /8: what disjoint white intervals leave of each black one (ord, start, end); a touched one that nothing is left of has nulls."""
    white = white.sort_values("start")
    ws, we = white["start"].to_numpy(), white["end"].to_numpy()
    start, end = black["start"].to_numpy(), black["end"].to_numpy()
    first, last = np.searchsorted(we, start), np.searchsorted(ws, end, side="right")
    n = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(black)), n + 1)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    at = first[row] + k
    # The k-th gap lies between the k-th white interval that touches and the one before it.
    lo = np.where(k == 0, start[row], we[np.minimum(at - 1, len(we) - 1)] + 1) if len(we) else start[row]
    hi = np.where(k == n[row], end[row], ws[np.minimum(at, len(ws) - 1)] - 1) if len(ws) else end[row]
    out = pd.DataFrame({"ord": black["ord"].to_numpy()[row], "start": lo, "end": hi, "touched": n[row] > 0})
    gaps = out[out["start"] <= out["end"]]
    gone = out[out["touched"]].drop_duplicates("ord").assign(start=None, end=None)
    return pd.concat([gaps.astype({"start": object, "end": object}), gone])


def _gaps(whole: DataFrame, white: DataFrame) -> DataFrame:
    """What the union of the whitelist leaves of each range (ord, start, end), in parts by /8, and whether it touches the range (touched)."""
    ship(whole.sparkSession)
    holes = _cut(interval_union(_white(white).select(F.col("wstart").alias("start"), F.col("wlen").alias("len"))))
    parts = _cut(whole.select("ord", "start", "end"), "ord")
    return parts.groupBy("block").cogroup(holes.groupBy("block")).applyInPandas(_left, "ord long, start long, end long, touched boolean")


def remove_whitelisted(black: DataFrame, white: DataFrame) -> DataFrame:
    """RNG-2, 4: ranges (ord, cidr) less the whitelist, as texts in (ord, cidr); ord tells the ranges apart.

    What isn't a prefix, and what no entry overlaps, stays as it is written; what the union of the
    entries covers goes; of the rest the gaps come back as prefixes. Both sides meet by /8, and the gaps of a range are joined again.
    """
    return left_over(black, white).select("ord", "cidr")


def left_over(black: DataFrame, white: DataFrame) -> DataFrame:
    """remove_whitelisted() as (ord, start, cidr): start orders the prefixes of a range, and is no address where the range stays as it is written.

    The whitelist may be a table (cidr) or (start, len); texts that are made just to be parsed again cost most of the time.
    """
    rows = parsed(black.select("ord", "cidr"))
    own = Window.partitionBy("ord")
    gaps = _gaps(rows.where("start IS NOT NULL"), white).withColumn("touched", F.max("touched").over(own)).where("start IS NOT NULL")
    # Gaps that the border of a /8 cut are joined again.
    order = own.orderBy("start")
    new = F.when(F.lag("end").over(order) + 1 == F.col("start"), 0).otherwise(1)
    gaps = gaps.withColumn("new", new).withColumn("gap", F.sum("new").over(order)).groupBy("ord", "gap").agg(F.min("start").alias("from"), F.max("end").alias("to"), F.first("touched").alias("touched"))
    known = rows.select("ord", "cidr", F.col("start").alias("whole")).join(gaps, "ord", "left").where("whole IS NULL OR from IS NOT NULL")
    # What stays as it is written stands for one address here, and its text comes back after cover().
    as_is = ~F.coalesce("touched", F.lit(False))
    none = F.lit(0).cast("long")
    each = known.select("ord", F.when(as_is, F.col("cidr")).alias("cidr"), F.when(as_is, none).otherwise(F.col("from")).alias("start"), F.when(as_is, none).otherwise(F.col("to")).alias("end"))
    return cover(each).select("ord", "start", F.coalesce("cidr", cidr_text(F.col("start"), F.col("len"))).alias("cidr"))


def compose_ban_lists(bans: DataFrame, blacklist: DataFrame, white: DataFrame) -> DataFrame:
    """RNG-6, SET-6: both lists less the whitelist, with their section; neither takes anything from the other."""
    return remove_whitelisted(bans, white).withColumn("section", F.lit("bans")).union(remove_whitelisted(blacklist, white).withColumn("section", F.lit("blacklist")))


def covered_by_union(black: DataFrame, white: DataFrame) -> DataFrame:
    """JOIN-3: ranges (ord, cidr) that the whitelist's entries together cover."""
    whole = parsed(black.select("ord", "cidr")).where("start IS NOT NULL")
    left = _gaps(whole, white).where("start IS NOT NULL").select("ord").distinct()
    return whole.select("ord", "cidr").join(left, "ord", "left_anti")


def overlapping(black: DataFrame, white: DataFrame) -> DataFrame:
    """JOIN-4: ranges (ord, cidr) that share an address with the whitelist."""
    whole = parsed(black.select("ord", "cidr")).where("start IS NOT NULL")
    return whole.select("ord", "cidr").join(_gaps(whole, white).where("touched").select("ord").distinct(), "ord", "left_semi")
