"""Mining of spaced patterns of three events from an encoder's sparse code (seq, position, fil, mag, tie)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..tables import written

KEY = ("f1", "f2", "f3", "d12", "d13", "len")


def top_q(code: DataFrame, q: int = DEFAULT.sparsity) -> DataFrame:
    """Events whose magnitude is at least the q-th largest of their sequence; ties stay."""
    return code.withColumn("_r", F.rank().over(Window.partitionBy("seq").orderBy(F.desc("mag")))).filter(F.col("_r") <= q).drop("_r")


def quantiles(code: DataFrame, ps: list[float], most: int = 10_000) -> list[float]:
    """Exact quantiles of magnitudes, with linear interpolation: values of their ranks, found by distributed selection.

    Where there are few different magnitudes they are counted at once.  Otherwise a histogram of ``most`` equal parts of the range says in which parts
    the wanted ranks lie; only these parts, by their own extremes, are divided again, until each holds few enough values.  No aggregate has more
    than ``most`` groups an interval, and there is an interval for each rank at most.  Null magnitudes don't count; without any, quantiles are infinite;
    NaN and infinite ones are an error.
    """
    x = code.select(F.col("mag").cast("double").alias("x")).filter("x IS NOT NULL")
    n, lo, hi, kinds = x.agg(F.count("*"), F.min("x"), F.max("x"), F.approx_count_distinct("x")).first()
    if not n:
        return [float("inf")] * len(ps)
    if not (math.isfinite(lo) and math.isfinite(hi)):
        raise ValueError("magnitudes must be finite")
    places = [p * (n - 1) for p in ps]
    found = _at_ranks(x, sorted({r for v in places for r in (math.floor(v), math.ceil(v))}), (0, n, lo, hi), kinds, most)
    # the same formula, and so the same last bit, as Spark's percentile
    return [found[math.floor(v)] if v == math.floor(v) else (math.ceil(v) - v) * found[math.floor(v)] + (v - math.floor(v)) * found[math.ceil(v)] for v in places]


def _at_ranks(x: DataFrame, ranks: list[int], whole: tuple[int, int, float, float], kinds: int, most: int) -> dict[int, float]:
    """Values at ranks (from 0).  An interval is (values before it, values in it, least, greatest)."""
    found: dict[int, float] = {}
    open_: list[tuple[int, int, float, float]] = [whole]
    small = kinds <= most // 2
    while open_:
        for before, n, lo, hi in open_:
            if lo == hi:
                found |= {r: lo for r in ranks if before <= r < before + n}
        open_ = [v for v in open_ if v[2] < v[3]]
        if not open_:
            break
        inside = F.coalesce(*[F.when(F.col("x").between(lo, hi), F.lit(i)) for i, (_, _, lo, hi) in enumerate(open_)])
        rows = x.withColumn("i", inside).filter("i IS NOT NULL")
        if small or all(n <= most for _, n, _, _ in open_):
            counted: dict[int, list] = {}
            for r in rows.groupBy("i", "x").count().collect():
                counted.setdefault(r.i, []).append((r.x, r["count"]))
            for i, values in counted.items():
                at = open_[i][0]
                for value, n in sorted(values):
                    found |= {r: value for r in ranks if at <= r < at + n}
                    at += n
            break
        lows, steps = (F.array(*[F.lit(v) for v in each]) for each in ([v[2] for v in open_], [(v[3] / most - v[2] / most) for v in open_]))
        part = F.least(F.lit(most - 1), F.floor((F.col("x") - lows[F.col("i")]) / F.greatest(steps[F.col("i")], F.lit(5e-324))))
        parts = rows.groupBy("i", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        after = []
        for i, (before, _, _, _) in enumerate(open_):
            at = before
            for r in sorted((r for r in parts if r.i == i), key=lambda r: r.lo):
                if any(at <= k < at + r.n for k in ranks):
                    after.append((at, r.n, r.lo, r.hi))
                at += r.n
        open_ = after
    return found


def above_quantile(code: DataFrame, p: float) -> DataFrame:
    return code.filter(F.col("mag") > quantiles(code, [p])[0])


def above_median(code: DataFrame) -> DataFrame:
    return above_quantile(code, 0.5)


def filtered(code: DataFrame, how: Callable[..., DataFrame] = above_quantile, **options) -> DataFrame:
    """Any function of a code may stand in for the filter."""
    return code.transform(how, **options)


#: Events that a sequence may have for its triples, of which there are then some 22 million.
MOST_EVENTS = 512


def _alike(x: Column, y: Column) -> Column:
    return x["position"].eqNullSafe(y["position"]) & x["fil"].eqNullSafe(y["fil"])


def triplets(code: DataFrame, height: int = DEFAULT.height) -> DataFrame:
    """All ordered triples of each sequence's events: KEY, seq, pos (of the first), ``min_mag``, ``lead`` and ``nulls``.

    Triples of one KEY and place differ only in which of several events of one position and filter they take; ``lead`` holds for the one of the largest ``min_mag``
    among them, so counting these counts places without grouping them.  It says nothing where ``nulls``: the sequence has null magnitudes.

    A sequence's events (a few dozen, by ``top_q``) are gathered once, so there is one shuffle and no join; more than ``MOST_EVENTS`` of
    them are an error, as their triples grow with the third power.  A triple passes a filter on magnitudes if its least magnitude does,
    so one enumeration serves all thresholds.
    """
    # events of one position and filter stand together, the largest first: which of them comes first changes no triple, so what tells them apart isn't carried
    events = code.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("position", "fil", (-F.col("mag")).alias("low"), "mag"))).alias("e"))
    many = F.raise_error(F.format_string(f"%d events of one sequence, more than {MOST_EVENTS}: keep those of top_q", F.size("e")))
    events = events.withColumn("e", F.when(F.size("e") > MOST_EVENTS, many).otherwise(F.col("e")))
    first = events.filter(F.size("e") >= 3).select("seq", "e", F.posexplode("e").alias("i", "a"))
    first = first.withColumns({"lead": (F.col("i") == 0) | ~_alike(F.col("e")[F.greatest(F.lit(0), F.col("i") - 1)], F.col("a")), "nulls": F.exists("e", lambda x: x["mag"].isNull())})
    second = first.filter(F.col("i") < F.size("e") - 2).select("seq", "e", "a", "i", "lead", "nulls", F.posexplode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("j", "b"))
    at = F.col("i") + F.col("j") + 2
    # an event leads if it is the first of its kind, or comes next to the one before it in the triple
    second = second.withColumn("lead", F.col("lead") & ((F.col("j") == 0) | ~_alike(F.col("e")[at - 2], F.col("b"))))
    third = second.filter(at < F.size("e")).select("seq", "a", "b", "lead", "nulls", F.posexplode(F.slice("e", at + 1, F.size("e"))).alias("k", "c"), F.slice("e", at + 1, F.size("e")).alias("rest"))
    third = third.withColumn("lead", F.col("lead") & ((F.col("k") == 0) | ~_alike(F.col("rest")[F.greatest(F.lit(0), F.col("k") - 1)], F.col("c"))))
    d13 = F.col("c.position") - F.col("a.position")
    return third.select(
        F.col("a.fil").alias("f1"), F.col("b.fil").alias("f2"), F.col("c.fil").alias("f3"), (F.col("b.position") - F.col("a.position")).alias("d12"), d13.alias("d13"), (d13 + height).alias("len"),
        "seq", F.col("a.position").alias("pos"), F.least("a.mag", "b.mag", "c.mag").alias("min_mag"), "lead", "nulls",
    )


def supports(triples: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """KEY with ``support``, or with a column for each threshold: how many triples have all magnitudes above it."""
    grouped = triples.groupBy(*KEY)
    if thresholds is None:
        return grouped.agg(F.count("*").alias("support"))
    return grouped.agg(*[F.count_if(F.col("min_mag") > t).alias(f"s{i}") for i, t in enumerate(thresholds)])


def enriched(support: DataFrame, trigger: int = DEFAULT.max_trigger, keep: int = DEFAULT.max_keep, least: int = DEFAULT.support_to) -> DataFrame:
    """The keys that lowering a support mark step by step would stop at: if more than ``trigger`` keys pass the lowest mark, the
    ``keep`` best of them, else all.  Ties at the cut go by the key.  Needs ``trigger >= keep``."""
    if trigger < keep:
        raise ValueError("trigger must not be below keep")
    passing = support.filter(F.col("support") > least)
    if passing.count() > trigger:
        return passing.orderBy(F.desc("support"), *KEY).limit(keep)
    return passing


def top_words(support: DataFrame, k: int) -> DataFrame:
    return support.orderBy(F.desc("support"), *KEY).limit(k)


def base_patterns(triples: DataFrame, threshold: float, least: int = DEFAULT.base_support) -> DataFrame:
    """KEY and support of the patterns of the lowest level."""
    return supports(triples.filter(F.col("min_mag") > threshold)).filter(F.col("support") > least)


def enriched_levels(tall: DataFrame, levels: tuple[float, ...] = DEFAULT.levels, **options) -> DataFrame:
    """KEY, ``level`` (the lowest quantile at which the pattern is enriched) and its ``turn`` (from 0), by the supports s1, s2, ... at ``levels``: a few
    hundred keys a level."""
    won = None
    for i, level in enumerate(levels):
        own = enriched(tall.select(*KEY, F.col(f"s{i + 1}").alias("support")), **options).select(*KEY, F.lit(level).alias("level"), F.lit(i).alias("turn"))
        won = own if won is None else won.unionByName(own)
    return won.groupBy(*KEY).agg(F.min_by("level", "turn").alias("level"), F.min("turn").alias("turn"))


def merged_levels(code: DataFrame, levels: tuple[float, ...] = DEFAULT.levels, base: float = DEFAULT.base_quantile, height: int = DEFAULT.height, **options) -> DataFrame:
    """KEY, ``level`` (the lowest quantile at which the pattern is enriched), ``hits`` there and ``hits_with_base``, the distinct hits
    together with those of the base set.  The triples are enumerated once; enriched keys are a few hundred a level."""
    marks = quantiles(code, [base, *levels])
    triples = triplets(code, height)
    tall = written(supports(triples, marks), "supports")
    first = enriched_levels(tall, levels, **options)
    mark = F.element_at(F.array(*[F.lit(m) for m in marks[1:]]), F.col("turn") + 1)
    hits = triples.join(F.broadcast(first.select(*KEY, "level", mark.alias("mark"))), list(KEY))
    base_keys = tall.filter(F.col("s0") > DEFAULT.base_support).select(*KEY, F.lit(True).alias("in_base"))
    hits = hits.join(F.broadcast(base_keys.join(F.broadcast(first.select(*KEY)), list(KEY), "left_semi")), list(KEY), "left")
    met = F.col("min_mag") > F.col("mark")
    with_base = met | (F.coalesce("in_base", F.lit(False)) & (F.col("min_mag") > marks[0]))
    # a row a pattern in each task; places are only grouped where magnitudes are null
    place = F.when(F.col("nulls"), F.struct("seq", "pos"))
    counted = hits.groupBy(*KEY, "level", place.alias("place")).agg(F.count_if(met).alias("n"), F.count_if(with_base & F.col("lead")).alias("led"), F.max(F.coalesce(with_base, F.lit(False)).cast("long")).alias("b"))
    return counted.groupBy(*KEY, "level").agg(F.sum("n").alias("hits"), F.sum(F.when(F.col("place").isNull(), F.col("led")).otherwise(F.col("b"))).alias("hits_with_base"))
