"""Operators on closed integer intervals: columns ``lo`` and ``hi``.

Overlap joins meet in bins of as many sizes as there are lengths, so they are equi-joins with a check, not nested loops; a pair is
reported by the first bin that both have. Set operations are sweeps: running sums over endpoints, taken over ranges of them, so that a
hot group is many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.scans import scanned
from cladeframe.plans.session import checkpointed

#: Queries and stored intervals of a group that :func:`closest` compares in pairs, at most.
SMALL_GROUP = 128


def intersects(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return (a_lo <= b_hi) & (b_lo <= a_hi)


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """As :func:`intersects`, but touching doesn't count."""
    return (a_lo < b_hi) & (b_lo < a_hi)


def jaccard(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Length in common by length of the union; 0 if the union has none, or they are apart."""
    common = F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))
    union = (a_hi - a_lo) + (b_hi - b_lo) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def gap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Distance between two intervals; 0 if they intersect."""
    return F.greatest(F.lit(0), a_lo - b_hi, b_lo - a_hi)


def centre(lo: Column, hi: Column) -> Column:
    return F.floor((lo + hi) / 2)


def overlap_join(a: DataFrame, b: DataFrame, bin_width: int, lo: str = "lo", hi: str = "hi", b_lo: str = "lo", b_hi: str = "hi", on: list[str] | None = None) -> DataFrame:
    """All pairs of rows whose intervals intersect (and agree in the columns ``on``): ``a``'s columns, then ``b``'s others with the
    prefix ``b_``. Intervals whose ends are null or the wrong way round are in no pair.

    An interval's own level is the least l with bins of ``bin_width`` * 4^l at least as long as it, of which it touches two at most. The longer of a pair
    is listed at its own level and the shorter at every level from its own up to the highest that occurs, so an interval has at most two
    rows a level, however long it is. Choose ``bin_width`` near the usual length.
    """
    on = on or []
    left, right = a.withColumns({"__lo": F.col(lo), "__hi": F.col(hi)}), b.select(*on, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in on)).withColumns({"__blo": F.col(f"b_{b_lo}"), "__bhi": F.col(f"b_{b_hi}")})
    left, right = left.where("__lo <= __hi"), right.where("__blo <= __bhi")
    length = lambda d, x, y: d.agg(F.max(F.col(y) - F.col(x))).first()[0]
    longest = max(length(left, "__lo", "__hi") or 0, length(right, "__blo", "__bhi") or 0)
    widths = [bin_width]
    while widths[-1] < longest:
        widths.append(widths[-1] * 4)
    own = lambda x, y: F.size(F.filter(F.array(*map(F.lit, widths)), lambda w: w < F.col(y) - F.col(x)))
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("__level") + 1)
    bins = lambda d, x, y: d.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width))))
    left, right = left.withColumn("__own", own("__lo", "__hi")), right.withColumn("__bown", own("__blo", "__bhi"))
    top = F.lit(len(widths) - 1)
    at_own = lambda d, c, x, y: bins(d.withColumn("__level", F.col(c)), x, y)
    at_all = lambda d, c, x, y, first: bins(d.withColumn("__level", F.explode(F.when(F.col(c) + first <= top, F.sequence(F.col(c) + first, top)))), x, y)
    first = F.floor(F.greatest("__lo", "__blo") / width)
    out = None
    for p, q in ((at_own(left, "__own", "__lo", "__hi"), at_all(right, "__bown", "__blo", "__bhi", 0)), (at_all(left, "__own", "__lo", "__hi", 1), at_own(right, "__bown", "__blo", "__bhi"))):
        pairs = p.join(q, [*on, "__level", "__bin"]).where(intersects(F.col("__lo"), F.col("__hi"), F.col("__blo"), F.col("__bhi")) & (F.col("__bin") == first))
        pairs = pairs.select(*a.columns, *(c for c in right.columns if c.startswith("b_")))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def nearest_before(queries: DataFrame, points: DataFrame, at: str, value: str, on: list[str]) -> DataFrame:
    """For each query row the value of the last point at or before it, within the groups ``on``: one union and one sweep over ranges,
    no join of ranges. Points of one place: the greatest value. Null values are no points."""
    q = queries.withColumn("__q", F.lit(1)).withColumn("__v", F.lit(None).cast(dict(points.dtypes)[value]))
    p = points.groupBy(*on, at).agg(F.max(value).alias("__v")).withColumn("__q", F.lit(0))
    x = scanned(q.unionByName(p, allowMissingColumns=True), on, [at, "__q"], **{f"last_{value}": ("last", "__v", True)})
    return x.where("__q = 1").drop("__q", "__v")


def closest(queries: DataFrame, stored: DataFrame, on: list[str], query_id: str, bin_width: int = 16) -> DataFrame:
    """For each query interval the best stored one of its group: the largest Jaccard index if any intersects, else the smallest gap;
    ties to the lower, then shorter interval. Queries whose group has none are left out.

    Groups of up to SMALL_GROUP rows meet as they are, so a query costs that many pairs at most. In larger ones those that intersect come from :func:`overlap_join`, so the work
    is that of all overlaps, which may be many more than the intervals; of the others only the nearest ends on either side can be closest, which one sweep finds.
    """
    s = stored.select(*on, F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi")).where("s_lo <= s_hi")
    q = queries.select(F.col(query_id).alias("__qid"), *on, "lo", "hi")
    out = lambda m: m.groupBy("__qid").agg(F.min("m").alias("m")).select(F.col("__qid").alias(query_id), "m.s_lo", "m.s_hi", F.col("m.gap").alias("gap"), (-F.col("m.less")).alias("jaccard"))
    if not on:
        return out(_touching_or_next(q, s, on, bin_width))
    # Groups that are large, null or asked for by ends that are null or the wrong way round.
    plain = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on), F.coalesce(F.col("lo") <= F.col("hi"), F.lit(False)))
    rows = q.select(*on, (~plain).alias("__odd")).unionByName(s.select(*on, F.lit(False).alias("__odd")))
    special = checkpointed(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), F.bool_or("__odd").alias("__odd")).where((F.col("__n") > SMALL_GROUP) | F.col("__odd")).select(*on))
    if special.isEmpty():
        return out(_pairs(q, s, on))
    met = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on))
    named = special.select(*(F.col(c).alias(f"__on_{c}") for c in on))
    few, rest = (lambda d: d.join(named, met, "left_anti")), (lambda d: d.join(named, met, "left_semi"))
    return out(_pairs(few(q), few(s), on).unionByName(_touching_or_next(rest(q), rest(s), on, bin_width)))


def _nearness(lo: Column, hi: Column, s_lo: Column, s_hi: Column) -> Column:
    return F.struct(gap(lo, hi, s_lo, s_hi).cast("long").alias("gap"), (-jaccard(lo, hi, s_lo, s_hi)).alias("less"), s_lo.cast("long").alias("s_lo"), s_hi.cast("long").alias("s_hi")).alias("m")


def _pairs(q: DataFrame, s: DataFrame, on: list[str]) -> DataFrame:
    """Every pair of small groups."""
    return q.join(s, on).select("__qid", _nearness(*(F.col(c) for c in ("lo", "hi", "s_lo", "s_hi"))))


def _touching_or_next(q: DataFrame, s: DataFrame, on: list[str], bin_width: int) -> DataFrame:
    met = overlap_join(q, s, bin_width, b_lo="s_lo", b_hi="s_hi", on=on)
    touching = met.select("__qid", F.struct(F.lit(0).cast("long").alias("gap"), (-jaccard(F.col("lo"), F.col("hi"), F.col("b_s_lo"), F.col("b_s_hi"))).alias("less"), F.col("b_s_lo").alias("s_lo"), F.col("b_s_hi").alias("s_hi")).alias("m"))
    # Stored intervals stand at their ends: those below are met by the last upper end (and there the lowest start), those above by the next lower end.
    pair = lambda lo, hi: F.struct(F.col(lo).alias("s_lo"), F.col(hi).alias("s_hi"))
    none = F.lit(None).cast("struct<s_lo:long,s_hi:long>")
    s = s.withColumns({"s_lo": F.col("s_lo").cast("long"), "s_hi": F.col("s_hi").cast("long")})
    below = s.groupBy(*on, F.col("s_hi").alias("__at")).agg(F.min("s_lo").alias("s_lo")).select(*on, "__at", F.lit(1).alias("__k"), F.lit(None).alias("__id"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), pair("s_lo", "__at").alias("below"), none.alias("above"))
    above = s.groupBy(*on, F.col("s_lo").alias("__at")).agg(F.min("s_hi").alias("s_hi")).select(*on, "__at", F.lit(1).alias("__k"), F.lit(None).alias("__id"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), none.alias("below"), pair("__at", "s_hi").alias("above"))
    ask = lambda end, k: q.select(*on, F.col(end).cast("long").alias("__at"), F.lit(k).alias("__k"), F.col("__qid").alias("__id"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), none.alias("below"), none.alias("above"))
    rows = below.unionByName(above).unionByName(ask("lo", 0)).unionByName(ask("hi", 2))
    swept = scanned(rows, on, ["__at", "__k"], before=("last", "below", False), after=("next", "above", False)).where("__k <> 1")
    near = swept.withColumn("s", F.explode(F.array_compact(F.array(F.when(F.col("__k") == 0, F.col("before")), F.when(F.col("__k") == 2, F.col("after"))))))
    apart = near.select(F.col("__id").alias("__qid"), F.struct(gap(F.col("lo"), F.col("hi"), F.col("s.s_lo"), F.col("s.s_hi")).cast("long").alias("gap"), (-jaccard(F.col("lo"), F.col("hi"), F.col("s.s_lo"), F.col("s.s_hi"))).alias("less"), F.col("s.s_lo").alias("s_lo"), F.col("s.s_hi").alias("s_hi")).alias("m"))
    return touching.unionByName(apart)


def merged(df: DataFrame, on: list[str], touching: bool = True) -> DataFrame:
    """Union of the intervals of each group: maximal runs that overlap (or touch), with how many went in. Rows with null ends are left out."""
    x = scanned(df.where("lo IS NOT NULL AND hi IS NOT NULL").select(*on, "lo", "hi"), on, ["lo", "hi"], before=("max", "hi", False))
    new = F.col("before").isNull() | ((F.col("lo") > F.col("before")) if touching else (F.col("lo") >= F.col("before")))
    runs = scanned(x.withColumn("__new", new.cast("int")), on, ["lo", "hi", "before"], __run=("sum", "__new", True))
    return runs.groupBy(*on, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n")).drop("__run")


def _events(df: DataFrame, on: list[str], **weights: int) -> DataFrame:
    """Starts (+) and places after ends (-), each with the weights."""
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))
    return df.where("lo IS NOT NULL AND hi IS NOT NULL").select(*on, F.explode(ends).alias("e")).select(*on, F.col("e.at").alias("at"), *((F.col("e.d") * w).alias(n) for n, w in weights.items()))


def _regions(edges: DataFrame, on: list[str]) -> DataFrame:
    """Where ``in`` begins to hold and ceases to: edges alternate, so a region is two edges in a row."""
    x = scanned(edges.select(*on, "at"), on, ["at"], k=("sum", F.lit(1), False)).withColumn("k", F.floor(F.col("k") / 2))
    return x.groupBy(*on, "k").agg(F.min("at").alias("lo"), (F.max("at") - 1).alias("hi")).drop("k")


def clipped(df: DataFrame, on: list[str], depth: int) -> DataFrame:
    """Regions that at least ``depth`` (1 or more) intervals of a group cover: +1 at each start, -1 after each end, a running sum."""
    events = _events(df, on, d=1).groupBy(*on, "at").agg(F.sum("d").alias("d"))
    x = scanned(events, on, ["at"], cover=("sum", "d", True))
    return _regions(x.where((F.col("cover") >= depth) != (F.col("cover") - F.col("d") >= depth)), on)


def difference(df: DataFrame, minus: DataFrame, on: list[str]) -> DataFrame:
    """The parts of each group's intervals that none of ``minus`` covers: where cover by the first is positive and by the second 0."""
    both = _events(df, on, p=1, m=0).unionByName(_events(minus, on, p=0, m=1)).groupBy(*on, "at").agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
    x = scanned(both, on, ["at"], a=("sum", "p", True), b=("sum", "m", True))
    inside = lambda a, b: (a > 0) & (b == 0)
    return _regions(x.where(inside(F.col("a"), F.col("b")) != inside(F.col("a") - F.col("p"), F.col("b") - F.col("m"))), on)
