"""Quality rules with robust multivariate outliers, DataFrame functions alone.

Every document gets a vector of transformed statistics.  For each language and
source the minimum-covariance-determinant location and scatter are found by
concentration: order the group's rows by Mahalanobis distance, keep the nearest
``H_SHARE``, take their mean and covariance, repeat until no group's kept rows
change.  Two deterministic starts (medians with quartile ranges; means with
covariances) are followed, and each group uses the one of smaller determinant.
A row whose squared distance exceeds the chi-square cutoff is rejected.

Every group has an estimate of its own, however small.  A group of n rows is
shrunk towards its language with weight PRIOR_ROWS / (n + PRIOR_ROWS), and a
language likewise towards all rows, in every step: nothing switches at a size.

One concentration step is one aggregate: rows are counted and summed by
(group, distance bin), the bins are added up from the nearest, and the first
bins that reach the share make the new estimate.  Statistics are fixed-point
integers, so sums do not depend on the order of rows and reruns agree.  A hot
group is reduced on the map side to its bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import stored, text_of
from funnelkit.llm.native import SPACES, let, without, word_array

MIN_WORDS = 50
#: fixed-point units in one
UNIT = 1024
#: the statistics and the least standard deviation each is given
FLOOR = {"length": 0.10, "symbols": 0.30, "lines": 0.12, "repeats": 0.12}
#: share of a group's rows that its estimate is made of: at half, up to half
#: of the rows may be outliers
H_SHARE = 0.5
#: rows that a group's parent counts for: four times the number of statistics
PRIOR_ROWS = 4 * len(FLOOR)
TAIL = 1e-5
BINS = 400
#: groups up to which their estimates (20 numbers each) are broadcast
BROADCAST_GROUPS = 100_000
#: groups whose bins (at most BINS each) are added up in one task
TASK_GROUPS = 2_000

_P = len(FLOOR)
STARTS = 2
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def chi2_below(x: float, dof: int) -> float:
    """P(chi-square with an even number of degrees of freedom <= x)."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dof // 2))


def chi2_at(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, dof) < p else (lo, mid)
    return lo


#: makes the covariance of the nearest share consistent at the normal law
CONSISTENCY = H_SHARE / chi2_below(chi2_at(H_SHARE, _P), _P + 2)


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def covered(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return let(marked, lambda s: let(
            F.array_sort(F.transform(
                F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))),
                lambda x: x["p"])),
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                F.lit(0), lambda a, x: a + x)))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return let(words, of)


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every row."""
    text = text_of(docs)
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "")
    stats = F.struct(
        (F.length(without(text, SPACES))).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, "#*$%&|<>"))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
    )
    found = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"),
        docs["source"].cast("string").alias("source"), stats.alias("s"))
    found = found.select("doc_id", "lang", "source", "s.w.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.w.n_repeat_words", "s.n_lines")
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> list[Column]:
    """The transformed statistics in fixed-point units."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(10 * F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
    )
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _key(level: int, *parts: Column) -> Column:
    """A group's name; null is told from every string."""
    named = [F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts]
    return F.concat_ws("\x01", F.lit(str(level)), *named)


def _cholesky(frame: DataFrame) -> DataFrame:
    """Adds the factor l_ij (i >= j) of the covariance c_ij, column by column."""
    for j in range(_P):
        below = []
        for i in range(j, _P):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            below.append(rest)
        root = F.sqrt(below[0])
        frame = frame.withColumns({f"l{j}{j}": root} | {f"l{i}{j}": rest / root for i, rest in zip(range(j + 1, _P), below[1:], strict=True)})
    return frame


def _squared_distance(frame: DataFrame) -> DataFrame:
    """Adds d2, by forward substitution with the factor."""
    for i in range(_P):
        rest = F.col(f"x{i}") / F.lit(UNIT) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        frame = frame.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return frame.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, _P)), F.col("y0") * F.col("y0")))


_MOMENTS = [f"m{i}" for i in range(_P)] + [f"c{i}{j}" for i, j in _PAIRS]


def _family(rows: DataFrame) -> DataFrame:
    """(grp, member, depth) of every group with rows: itself and its parents.
    A name starts with the number of the start that the estimate follows."""
    pairs = rows.select("lang", "source").distinct()
    names = pairs.select(F.explode(F.array(*[F.lit(s) for s in range(STARTS)])).alias("start"), "lang", "source")
    named = lambda *parts: F.concat_ws("\x02", F.col("start").cast("string"), _key(*parts))
    line = [named(0), named(1, F.col("lang")), named(2, F.col("lang"), F.col("source"))]
    rows = F.array(*[F.struct(line[own].alias("grp"), line[d].alias("member"), F.lit(d).alias("depth")) for own in range(3) for d in range(own + 1)])
    return names.select(F.explode(rows).alias("f")).select("f.*").distinct()


def _shrunk(moments: DataFrame, family: DataFrame, groups: int) -> DataFrame:
    """(grp, n, done, means, factor): every group's moments (grp, n, done, m*,
    c*) drawn towards its parent's, all rows first.  A group meets its parents
    in one aggregate, so a step has few joins to plan, compile and broadcast."""
    small = F.broadcast if groups <= BROADCAST_GROUPS else lambda x: x
    each = moments.select(F.col("grp").alias("member"), "n", "done", F.array(*_MOMENTS).alias("v")).join(small(family), "member")
    line = each.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("depth", "n", "done", "v"))).alias("line"))

    def drawn(above: Column, x: Column) -> Column:
        weight = x["n"] / (x["n"] + PRIOR_ROWS)
        return F.when(x["depth"] == 0, x["v"]).otherwise(F.zip_with(x["v"], above, lambda a, b: weight * a + (1 - weight) * b))

    own = F.element_at("line", -1)
    found = line.select("grp", own["n"].alias("n"), own["done"].alias("done"), F.aggregate("line", F.array().cast("array<double>"), drawn).alias("v"))
    found = _cholesky(found.select("grp", "n", "done", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(_MOMENTS)]))
    return found.select("grp", "n", "done", *[f"m{i}" for i in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS])


def _floored(cov: dict[str, Column]) -> dict[str, Column]:
    floors = list(FLOOR.values())
    return {f"c{i}{j}": F.greatest(cov[f"c{i}{j}"], F.lit(0.0)) + floors[i] ** 2 if i == j else cov[f"c{i}{j}"] for i, j in _PAIRS}


def _medians(rows: DataFrame) -> DataFrame:
    """Moments from histograms: medians, and quartile ranges as a diagonal scatter."""
    bin_ = UNIT // 64
    long = rows.select("grp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.floor(F.col(f"x{i}") / bin_).alias("b")) for i in range(_P)])).alias("v")).select("grp", "v.*")
    bars = long.groupBy("grp", "f", "b").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("grp", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("grp", "f")
    ranked = bars.select("grp", "f", "b", F.sum("k").over(upto).alias("upto"), F.sum("k").over(whole).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("b")))
    quarts = ranked.groupBy("grp", "f").agg(F.max("n").alias("n"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    of = lambda i, c: F.max(F.when(F.col("f") == i, c))
    wide = quarts.groupBy("grp").agg(
        F.max("n").alias("n"),
        *[of(i, (F.col("q2") + 0.5) / 64).alias(f"m{i}") for i in range(_P)],
        *[of(i, (F.col("q3") - F.col("q1")) / 64 / 1.349).alias(f"s{i}") for i in range(_P)])
    cov = {f"c{i}{j}": F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0) for i, j in _PAIRS}
    return wide.select("grp", "n", F.lit(0.0).alias("k"), F.lit(0).cast("long").alias("mark"), *[f"m{i}" for i in range(_P)], *[c.alias(k) for k, c in _floored(cov).items()])


_SUMS = [f"s{i}" for i in range(_P)] + [f"p{i}{j}" for i, j in _PAIRS]


def _summed() -> list[Column]:
    return [F.sum(f"x{i}").alias(f"s{i}") for i in range(_P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]


def _moments(kept: DataFrame, factor: float) -> DataFrame:
    """Moments from a group's n, k (rows kept) and exact sums; ``mark`` tells
    which rows were kept."""
    d = lambda c: F.col(c).cast("double")
    k = d("k")
    mean = [d(f"s{i}") / k / UNIT for i in range(_P)]
    cov = {f"c{i}{j}": (d(f"p{i}{j}") / k - d(f"s{i}") / k * d(f"s{j}") / k) / UNIT**2 * factor for i, j in _PAIRS}
    return kept.select("grp", "n", k.alias("k"), F.xxhash64("k", *_SUMS).alias("mark"), *[c.alias(f"m{i}") for i, c in enumerate(mean)], *[c.alias(n) for n, c in _floored(cov).items()])


def _joined(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    return rows.join(F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates, "grp")


def _step(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """Moments of every group after one concentration step."""
    near = _squared_distance(_joined(rows, estimates.drop("n", "done"), groups)).withColumn(
        "bin", F.least(F.lit(BINS - 1), F.floor(F.log1p("d2") * 40)).cast("int"))
    bins = near.groupBy("grp", "bin").agg(F.count("*").alias("k"), *_summed())
    before = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    kept = bins.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("n", F.sum("k").over(Window.partitionBy("grp")))
    kept = kept.where(F.col("before") < H_SHARE * F.col("n")).groupBy("grp").agg(F.max("n").alias("n"), F.sum("k").alias("k"), *[F.sum(c).alias(c) for c in _SUMS])
    return _moments(kept, CONSISTENCY)


def robust_estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """(grp, n, means, factor) of every language and source among ``rows``
    (lang, source, x0 ..), grp without its start; and how many groups were fitted."""
    family = stored(_family(rows), "quality-groups")
    groups = family.where(F.col("grp") == F.col("member")).count()
    own = F.array(_key(2, F.col("lang"), F.col("source")), _key(1, F.col("lang")), _key(0))
    started = lambda s: rows.select(F.explode(F.transform(own, lambda g: F.concat_ws("\x02", F.lit(str(s)), g))).alias("grp"), *[f"x{i}" for i in range(_P)])
    means = started(1).groupBy("grp").agg(F.count("*").alias("n"), *_summed()).withColumn("k", F.col("n"))
    few = 1 + groups // TASK_GROUPS  # tables of groups are small, whatever the session's partitions
    moments = stored(_medians(started(0)).unionByName(_moments(means, 1.0)).coalesce(few), "quality-start")
    fit = started(0).unionByName(started(1))
    # until every group keeps rows that it kept in some step before: most come
    # to rest, a few small ones go round between the same sets
    none = F.array().cast("array<long>")
    moments = moments.select("*", none.alias("seen"), F.lit(False).alias("done"))
    while True:
        now = _step(fit, _shrunk(moments, family, groups).where(~F.col("done")), groups)
        new = now.join(moments.select("grp", "seen"), "grp")
        new = new.withColumns({"done": F.array_contains("seen", F.col("mark")), "seen": F.array_append("seen", F.col("mark"))})
        moments = stored(moments.where("done").unionByName(new).coalesce(few), "quality-step")
        if moments.where(~F.col("done")).isEmpty():
            break
    volume = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, _P)), F.log("l00"))
    each = stored(_shrunk(moments, family, groups).coalesce(few), "quality-estimates").where(F.col("grp").substr(3, 1) == "2").select(
        F.col("grp").substr(F.lit(3), F.length("grp")).alias("grp"), F.struct(F.round(volume, 9).alias("volume"), F.col("grp").alias("start"), "n", *[f"m{i}" for i in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS]).alias("e"))
    return each.groupBy("grp").agg(F.min("e").alias("e")).select("grp", "e.*").drop("volume", "start"), groups


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base statistics, ``base_failed``, ``d2`` and ``kept`` for every row.

    Null text: no words, so the base rules reject it.  Null language or source
    are values of their own.  Very long texts are read whole.  Repeated rows
    count as often as they occur; no order is used, so ties cannot matter.  Rows that fail the base rules take
    no part in the estimates.  An empty table gives no rows.
    """
    rows = stored(base_columns(docs).select("*", *_vector()), "quality-stats")
    estimates, groups = robust_estimates(rows.where(~F.col("base_failed")).select("lang", "source", *[f"x{i}" for i in range(_P)]))
    keyed = rows.withColumn("grp", _key(2, F.col("lang"), F.col("source")))
    chosen = F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates
    found = _squared_distance(keyed.join(chosen.withColumnRenamed("n", "group_rows"), "grp", "left"))
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_at(1 - TAIL, _P), F.lit(False)))


def op4(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "group_rows")
