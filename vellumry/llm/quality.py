"""Quality rules: fixed thresholds, and robust multivariate outliers per language and source.

Everything is DataFrame functions.  A document's statistics are transformed to a vector of five
features.  For every (lang, source) the minimum-covariance-determinant estimate is found by
concentration steps from two deterministic starts (the classical estimate and the spatial-sign
covariance): keep the share ALPHA of rows that is nearest by Mahalanobis distance, estimate mean
and covariance from them, repeat.  A step is one aggregation: moments are summed per (group, start,
distance bin), so the nearest rows are whole bins and their moments are sums over a few thousand
rows per group; no row is sorted or collected, and a group with a third of all rows costs no more
than others.  The estimate with the smaller determinant wins, and rows whose squared distance
passes the bound are rejected.

Every group is estimated, however small: its moments are joined by PRIOR rows' worth of the mean
moments of its language, and a language's by as many of all rows.  A group of thousands is left as it
is, one of a few rows is judged much like its language, and there is no switch between.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stash

#: Share of a group that the estimate rests on (the usual choice between 0.5, which bears most
#: outliers, and 1, which wastes no rows), and bins per e-fold of squared distance.
ALPHA = 0.75
BINS = 48
#: Steps go on until no log determinant moves by more than SETTLED, but no longer than MOST_STEPS.
SETTLED, MOST_STEPS = 0.01, 12
#: Rows of the wider group that a group's moments are joined by.
PRIOR = 20
#: Squared distances are compared with this quantile of the chi-squared distribution, times the
#: tolerance for tails that are heavier than normal ones.
QUANTILE = 0.999
TAILS = 8.0

WORD = "[^\\x20\\x09-\\x0D]"
SPACES = " \t\n\x0b\f\r"
FEATURES = ("f1", "f2", "f3", "f4", "f5")
#: Standard deviations below which a feature's spread is not trusted.
FLOORS = (0.10, 0.15, 0.10, 0.05, 0.05)
P = len(FEATURES)


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-squared with k degrees of freedom, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / math.gamma(k / 2 + 1)
    for n in range(1, 2000):
        term *= x / 2 / (k / 2 + n)
        total += term
        if term < 1e-16 * total:
            break
    return min(1.0, total * math.exp(-x / 2) * (x / 2) ** (k / 2))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


#: The covariance of the nearest share understates the spread of normal rows by this factor.
CONSISTENCY = ALPHA / chi2_cdf(chi2_quantile(ALPHA, P), P + 2)
BOUND = chi2_quantile(QUANTILE, P) * TAILS


def _text_of(docs: DataFrame, name: str) -> Column:
    """A column as a string; null where docs has no such column."""
    return (F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")).alias(name)


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, source and the counts of every row of docs; `_row`, the row as it is, if asked for.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as the base rules define them,
    n_lines the lines with a word.  Null texts count as empty; lang and source are null where docs
    has no such columns.  Repeated 5-word windows are found by a hash of each window; only texts
    where a hash repeats sort the windows themselves, so the counts are exact.
    """
    rest = ["_row"] if carry else []
    text = F.coalesce("text", F.lit(""))
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if carry else []
    d = docs.select(F.col("doc_id"), _text_of(docs, "lang"), _text_of(docs, "source"), text.alias("text"), F.btrim(text, F.lit(SPACES)).alias("_body"), *whole)
    d = d.withColumn("_words", F.split("_body", "[ \\t-\\r]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    d = d.select("doc_id", "lang", "source", "_words", *rest,
                 F.when(F.col("_body") == "", 0).otherwise(F.size("_words")).cast("long").alias("n_words"),
                 F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                 F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                 lines.alias("_lines"))
    hashes = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 4), lambda i: F.xxhash64(F.slice("_words", i, 5)))
    d = d.withColumn("_hashes", F.when(F.col("n_words") >= 5, hashes))
    d = d.withColumn("_repeats", F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False)))
    windows = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 4), lambda i: F.struct(F.array_join(F.slice("_words", i, 5), " ").alias("w"), i.alias("i")))
    d = d.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(windows)))
    twice = F.filter(F.transform("_sorted", lambda x, j: F.when(
        (x["w"] == F.get("_sorted", j - 1)["w"]) | (x["w"] == F.get("_sorted", j + 1)["w"]), x["i"])), lambda i: i.isNotNull())
    d = d.withColumn("_starts", F.when(F.col("_repeats"), F.sort_array(twice)))
    covered = F.transform("_starts", lambda s, j: F.when(j == 0, F.lit(5)).otherwise(F.least(F.lit(5), s - F.get("_starts", j - 1))))
    repeat = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
                    (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                    repeat.alias("n_repeat_words"), F.size("_lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size(F.array_distinct("_words")), F.lit(0)).cast("long").alias("n_distinct"), *rest)


def features(stats: DataFrame) -> DataFrame:
    """stats with the transformed vector: size, word length, symbols, repetition and variety."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    vector = (F.log1p("n_words"), F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))) * 2, F.log1p(100 * F.col("n_symbols") / n),
              F.sqrt((F.col("n_repeat_words") + F.col("n_dup_lines")) / (n + F.col("n_lines"))),
              F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / n) + 0.1 * F.log1p("n_words"))
    return stats.select("*", *(x.cast("double").alias(f) for f, x in zip(FEATURES, vector)))


def _moments(prefix: str = "") -> list[Column]:
    """Count, sums and sums of products of the features."""
    x = [F.col(prefix + f) for f in FEATURES]
    out = [F.count("*").alias("n")] + [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)]
    return out + [F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)]


ESTIMATE = [*(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i in range(P) for j in range(i + 1)), "logdet"]
MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i in range(P) for j in range(i + 1))]


def _estimates(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Mean m, inverse Cholesky factor w of the covariance, and its log determinant."""
    cov = {(i, j): (F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")) * scale for i in range(P) for j in range(i + 1)}
    e = sums.select(*keys, *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)),
                    *((c + (FLOORS[i] ** 2 if i == j else 0)).alias(f"c{i}{j}") for (i, j), c in cov.items()))
    return _factored(e, keys)


def _factored(e: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m, w and logdet from the columns m and c (floored, so positive definite)."""
    for j in range(P):
        diagonal = F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        e = e.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(1e-9))))
        e = e.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    for i in range(P):
        e = e.withColumns({f"w{i}{j}": (F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))) / F.col(f"l{i}{i}") for j in range(i + 1)})
    logdet = sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)) * 2
    return e.select(*keys, *(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i in range(P) for j in range(i + 1)), logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance of the features under the joined estimate."""
    z = [sum((F.col(f"w{i}{j}") * (F.col(FEATURES[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((x * x for x in z), F.lit(0.0))


def _nearest(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the nearest bins of each group that together hold the share ALPHA."""
    order = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    below = binned.withColumn("_before", F.sum("n").over(order) - F.col("n")).withColumn("_all", F.sum("n").over(whole))
    return below.where(F.col("_before") < F.ceil(F.col("_all") * ALPHA)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in MOMENTS))


def _shrunk(sums: DataFrame) -> DataFrame:
    """Moments of each (g, lang, start) joined by those of its language and of all rows."""
    def mean_of(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in MOMENTS))

    def joined(near: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
        """near with PRIOR rows' worth of the mean moments of wide, which has the same start."""
        mean = wide.select(*(F.col(k).alias(f"_{k}") for k in keys), *((F.col(c) / F.col("n") * PRIOR).alias(f"_{c}") for c in MOMENTS))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        return near.join(mean, same).select(*(c for c in near.columns if c not in MOMENTS), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in MOMENTS))

    per_lang = mean_of(sums, ["start", "lang"])
    return joined(sums, joined(per_lang, mean_of(per_lang, ["start"]), ["start"]), ["start", "lang"])


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of each group g, lang: m, w and logdet.

    The steps end when all log determinants have settled.  Each start keeps its estimate of least
    determinant, and the start with the smaller one wins (the first of equals).
    """
    keys = ["g", "lang", "start"]
    sums = stash(_shrunk(stash(rows.groupBy("g", "lang").agg(*_moments()).withColumn("start", F.lit(0)), "mcd-moments")), "mcd-sums")
    classical = _estimates(sums, keys, 1.0)
    # spatial signs: directions from the mean after scaling, each of length one
    scales = [(F.col(f"q{i}{i}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) ** 2 + FLOORS[i] ** 2) for i in range(P)]
    centres = sums.select("g", "n", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)), *(F.sqrt(v).alias(f"d{i}") for i, v in enumerate(scales)))
    centred = rows.join(centres, "g")
    z = [(F.col(f) - F.col(f"m{i}")) / F.col(f"d{i}") for i, f in enumerate(FEATURES)]
    norm = F.greatest(sum((x * x for x in z), F.lit(0.0)), F.lit(1e-9))
    # the prior's rows count as having the classical spread
    share = F.count("*") / F.first("n")
    signs = centred.groupBy("g", "lang").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(P)),
                                             *((share * F.avg(z[i] * z[j] / norm * P * F.col(f"d{i}") * F.col(f"d{j}")) + (1 - share) * (F.first(F.col(f"d{i}") ** 2) if i == j else F.lit(0.0))).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)))
    signs = signs.select("g", "lang", F.lit(1).alias("start"), *(f"m{i}" for i in range(P)), *((F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)))
    now = stash(classical.unionByName(_factored(signs, keys)), "mcd")
    best = None
    for _ in range(MOST_STEPS):
        near = rows.join(now.drop("lang"), "g").withColumn("bin", F.floor(F.log(_distance() + 1e-6) * BINS))
        binned = near.groupBy(*keys, "bin").agg(*_moments())
        # stored before they are joined by their sums, as the plan would hold each step several times
        nearest = stash(_nearest(binned, keys), "mcd-nearest")
        new = _estimates(stash(_shrunk(nearest), "mcd-moments"), keys, CONSISTENCY)
        release(nearest)
        if best is None:
            now = best = stash(new, "mcd")
            continue
        before = best.select("g", "start", *(F.col(c).alias(f"_{c}") for c in ESTIMATE))
        now = stash(new.join(before, ["g", "start"]), "mcd")
        moved = now.agg(F.max(F.col("_logdet") - F.col("logdet"))).first()[0]
        better = F.col("logdet") < F.col("_logdet")  # a step over whole bins may also raise it a little
        best = now.select(*keys, *(F.when(better, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ESTIMATE))
        now = now.select(*keys, *ESTIMATE)
        if moved is None or moved < SETTLED:
            break
    first = Window.partitionBy("g").orderBy("logdet", "start")
    return best.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "start", "lang")


def _judged(docs: DataFrame, carry: bool) -> DataFrame:
    """statistics() with base_failed, distance and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    group = F.to_json(F.struct("lang", "source"))
    rows = stash(features(statistics(docs, carry)).withColumn("base_failed", failed).withColumn("g", group), "quality")
    found = stash(estimates(rows.where("not base_failed").select("g", "lang", *FEATURES)), "mcd-best")
    far = rows.join(found, "g", "left").withColumn("distance", _distance())
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= BOUND, F.lit(True)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    distance for every row of docs.

    Null and empty texts have no words and fail the base rules.  Null languages and sources are
    groups of their own, as is all where docs has no such columns.  Only rows that pass the base
    rules enter the estimates; the distance is null in groups without any.  A text of any length is
    counted whole, in the memory of one row.  Rows that repeat stay repeated and rows without a
    doc_id are judged like any other; an empty table gives no rows; further columns are not read.
    """
    return _judged(docs, False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns.

    Each row is judged by itself and carried along with its counts, so repeated ids and rows without
    an id need no matching, and no text is shuffled.
    """
    return _judged(docs, True).where("kept").select("_row.*")
