"""Questions to whole networks of discrete variables: most probable explanations with their assignment, and learning by EM where any variables are unknown.

A network is a table (its variables, lp) for each family: a child with its parents. Everything is products, sums and maxima of :mod:`cladeframe.operators.factors`.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.factors import VALUE, evidence, marginal, product, variables
from cladeframe.plans.session import checkpointed

#: Log values that agree to so many digits are ties.
DIGITS = 9


def explanation(factors: list[DataFrame], nominated: list[str], order: list[str] | None = None, known: dict[str, object] | None = None) -> DataFrame:
    """One row: the most probable values of the ``nominated`` variables given what is ``known``, all others (``order``) summed out, and ``lp``, the log of what that
    assignment and the evidence have together. Ties (to nine digits) to the smaller value of the variable decided last, then of the one before.

    Up: each nominated variable is maximised out, and the best value for every assignment of what its bucket still holds is kept as a table. Down: the
    last one's value is known, and joins with the kept tables, in reverse, read off the others. Without any rows of chance above 0 the result is empty.
    """
    left = [evidence(f, known or {}) for f in factors]
    for v in order or []:
        mine = [f for f in left if v in f.columns]
        if mine:
            joint = reduce(product, mine)
            left = [f for f in left if v not in f.columns] + [marginal(joint, [c for c in variables(joint) if c != v])]
    choices = []
    for v in nominated:
        mine = [f for f in left if v in f.columns]
        if not mine:
            raise ValueError(f"no factor has the variable {v}")
        joint = reduce(product, mine).where(F.col(VALUE) > float("-inf"))
        keep = [c for c in variables(joint) if c != v]
        best = joint.groupBy(*keep).agg(F.min(F.struct((-F.round(VALUE, DIGITS)).alias("less"), F.col(v).alias("value"), F.col(VALUE).alias("lp"))).alias("__best"))
        best = checkpointed(best.where("__best IS NOT NULL").select(*keep, F.col("__best.value").alias(v), F.col("__best.lp").alias(VALUE)))
        choices.append((v, keep, best.drop(VALUE)))
        left = [f for f in left if v not in f.columns] + [best.drop(v)]
    total = reduce(product, left).agg(F.max(VALUE).alias(VALUE)).where(F.col(VALUE).isNotNull())  # one row
    found = total
    for v, keep, best in reversed(choices):
        found = found.join(best, keep) if keep else found.crossJoin(F.broadcast(best))  # one row each
    return found.select(*nominated, VALUE)


def patterns(rows: DataFrame, columns: list[str]) -> list[tuple[list[str], DataFrame]]:
    """The sets of columns that are known together, each with the distinct known values and how many rows have them (``n``)."""
    told = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns))
    counted = checkpointed(rows.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("__n")).withColumn("__told", told))
    kinds = sorted(r[0] for r in counted.select("__told").distinct().collect())  # no more than the columns' subsets that occur
    out = []
    for kind in kinds:
        known = [c for c, x in zip(columns, kind) if x == "1"]
        out.append((known, counted.where(F.col("__told") == kind).select(*known, "__n")))
    return out


def _restricted(table: DataFrame, seen: DataFrame, known: list[str]) -> DataFrame:
    """Of a family's table, what goes with any of the known values."""
    shared = [c for c in variables(table) if c in known]
    return table.join(seen.select(*shared).distinct(), shared, "left_semi") if shared else table


#: If a pattern's unknown variables have together at most so many combinations of values, they are kept with the known ones in one table, of which all families are sums.
JOINT_VALUES = 256


def _expected(tables: dict[str, DataFrame], known: list[str], seen: DataFrame, values: dict[str, int]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Expected counts (n) by family, and the log-likelihood (ll) of the rows of one pattern. ``values``: how many each variable has."""
    narrowed = {v: _restricted(t, seen, known) for v, t in tables.items()}
    base = seen.select(*known, F.lit(0.0).alias(VALUE))
    hidden = sorted({c for t in tables.values() for c in variables(t)} - set(known))

    def joint(keep: list[str]) -> DataFrame:
        """The known values, the hidden variables of ``keep`` and their log chance together, the other hidden ones summed out."""
        left = list(narrowed.values())
        for v in (h for h in hidden if h not in keep):
            mine = [f for f in left if v in f.columns]
            made = reduce(product, sorted(mine, key=lambda f: len(f.columns)))
            left = [f for f in left if v not in f.columns] + [marginal(made, [c for c in variables(made) if c != v])]
        # The known values first, so that no product has combinations that don't occur.
        done = base if known else None
        while left:
            near = next((f for f in left if done is None or set(variables(f)) & set(variables(done))), left[0])
            left = [f for f in left if f is not near]
            done = near if done is None else product(done, near)
        return done

    if hidden and math.prod(values[h] for h in hidden) <= JOINT_VALUES:
        both = joint(hidden)
        total = marginal(both, known).withColumnRenamed(VALUE, "__z")
        met = both.join(total, known).join(seen, known) if known else both.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(seen))  # one row each
        met = checkpointed(met.where(F.col("__z") > float("-inf")))
        share = F.exp(F.col(VALUE) - F.col("__z"))
        ll = met.agg(F.sum(F.col("__n") * share * F.col("__z")).alias("ll"))  # (the shares of a row's completions sum to 1)
        lost = (seen.join(met.select(*known).distinct(), known, "left_anti") if known else seen.limit(0)).agg(F.when(F.count(F.lit(1)) > 0, float("-inf")).alias("none"))
        ll = ll.crossJoin(F.broadcast(lost)).select(F.coalesce("none", "ll").alias("ll"))  # one row each
        return {v: met.groupBy(*variables(t)).agg(F.sum(F.col("__n") * share).alias("__n")) for v, t in tables.items()}, ll
    total = joint([]) if hidden else None
    counts = {}
    for v, t in tables.items():
        family = variables(t)
        own = [c for c in family if c in hidden]
        if not own:
            counts[v] = seen.groupBy(*family).agg(F.sum("__n").alias("__n"))
            continue
        both = joint(own)
        weight = total.select(*known, F.col(VALUE).alias("__z"))
        share = both.join(weight, known) if known else both.crossJoin(F.broadcast(weight))
        share = share.join(seen, known) if known else share.crossJoin(F.broadcast(seen))
        counts[v] = share.where(F.col("__z") > float("-inf")).groupBy(*family).agg(F.sum(F.col("__n") * F.exp(F.col(VALUE) - F.col("__z"))).alias("__n"))
    if total is None:
        total = joint([])
    ll = (total.join(seen, known) if known else total.crossJoin(F.broadcast(seen))).agg(F.sum(F.col("__n") * F.col(VALUE)).alias("ll"))
    return counts, ll


def learn(rows: DataFrame, tables: dict[str, DataFrame], rounds: int, pseudo: float = 0.0) -> tuple[dict[str, DataFrame], list[float]]:
    """The families' tables after ``rounds`` of EM, and the log-likelihood of the rows before each round.

    ``rows``: a column for each variable that is ever known, null where it isn't; variables without a column are never known. ``tables``: by child, its
    family's variables and ``lp``, for every combination of values that may occur (values that a table lacks have chance 0). Rows alike in what is known are
    counted once; each pattern of known variables is eliminated for itself, at once where its unknown ones have few values (JOINT_VALUES), else a family at a
    time, and each family's new table is a checkpoint. Parent
    values that nothing speaks of keep their shares; ``pseudo`` is added to every expected count. Rows without any known value add nothing but their number.
    """
    columns = [c for c in sorted({c for t in tables.values() for c in variables(t)}) if c in rows.columns]
    seen = patterns(rows, columns)
    tables, likelihoods = {v: checkpointed(t) for v, t in tables.items()}, []
    values = {v: t.select(v).distinct().count() for v, t in tables.items()}
    for _ in range(rounds):
        found = [_expected(tables, known, part, values) for known, part in seen]
        likelihoods.append(sum(x for _, ll in found if (x := ll.first()[0]) is not None))
        new = {}
        for v, t in tables.items():
            family, parents = variables(t), [c for c in variables(t) if c != v]
            if not found:
                new[v] = t
                continue
            n = reduce(DataFrame.unionByName, (counts[v] for counts, _ in found)).groupBy(*family).agg(F.sum("__n").alias("__n"))
            x = t.join(n, family, "left").withColumn("__n", F.coalesce("__n", F.lit(0.0)) + pseudo)
            total = x.groupBy(*parents).agg(F.sum("__n").alias("__t"))
            x = x.join(total, parents) if parents else x.crossJoin(F.broadcast(total))  # one row
            new[v] = checkpointed(x.select(*family, F.when(F.col("__t") > 0, F.when(F.col("__n") > 0, F.log(F.col("__n") / F.col("__t"))).otherwise(float("-inf"))).otherwise(F.col(VALUE)).alias(VALUE)))
        tables = new
    return tables, likelihoods


def noisy_or_table(spark, child: str, causes: list[str], leak: float, strengths: list[float]) -> DataFrame:
    """The family of a noisy-or: the child is on unless every cause that is on, and the leak, fail to turn it on. Booleans; 2^(causes + 1) rows."""
    data = []
    for on in itertools.product((False, True), repeat=len(causes)):
        fails = (1 - leak) * math.prod(1 - s for s, x in zip(strengths, on) if x)
        data += [(*on, y, math.log(p) if p > 0 else float("-inf")) for y, p in ((False, fails), (True, 1 - fails))]
    return spark.createDataFrame(data, ", ".join(f"`{c}` boolean" for c in [*causes, child]) + f", {VALUE} double")


def learn_noisy_or(rows: DataFrame, child: str, causes: list[str], rounds: int, leak: float = 0.1, strength: float = 0.5) -> tuple[float, list[float], list[float]]:
    """Leak, strengths of the causes and the log-likelihood before each round, by EM over which of the causes that are on (and the leak) turn the child on.
    Rows with a null are left out. The expected numbers are sums over the rows' patterns, so a round is one small aggregate over counts."""
    on = [F.col(c) for c in causes]
    counts = checkpointed(rows.select(*causes, child).dropna().groupBy(*causes, child).agg(F.count(F.lit(1)).cast("double").alias("__n")))
    strengths, seen = [strength] * len(causes), []
    for _ in range(rounds):
        fails: Column = F.lit(1 - leak)
        for c, s in zip(on, strengths):
            fails = fails * F.when(c, 1 - s).otherwise(1.0)
        chance = F.greatest(1 - fails, F.lit(1e-300))
        # Given that the child is on, a cause did its part with chance s / P(on); given that it's off, with 0.
        did = lambda s: F.when(F.col(child), s / chance).otherwise(0.0)  # noqa: E731, B023
        sums = [F.sum(F.col("__n") * did(leak)), F.sum("__n")]
        for c, s in zip(on, strengths):
            sums += [F.sum(F.when(c, F.col("__n") * did(s))), F.sum(F.when(c, F.col("__n")))]
        sums.append(F.sum(F.col("__n") * F.log(F.greatest(F.when(F.col(child), 1 - fails).otherwise(fails), F.lit(1e-300)))))
        got = counts.agg(*sums).first()
        seen.append(got[-1] or 0.0)
        leak = got[0] / got[1] if got[1] else leak
        strengths = [got[2 + 2 * i] / got[3 + 2 * i] if got[3 + 2 * i] else s for i, s in enumerate(strengths)]
    return leak, strengths, seen
