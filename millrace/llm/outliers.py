"""Quality rules: robust multivariate outliers among text statistics.

Every text gets a few counts; transformed, they make a vector. For each language and source the minimum covariance
determinant estimate is the mean and covariance of the three quarters of the vectors that lie closest together. It is
found by concentration steps from two starts (the middle of each coordinate, and the plain mean): take the closest
share, estimate again, repeat until no determinant moves; of the two the one with the smaller determinant holds. A text whose squared
Mahalanobis distance to its group is above a chi-square quantile is rejected. Texts of a group too small for an estimate
are held against that of their language, and those of a language too small against that of all texts.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small_join, stored, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 20
#: Share of a group that the estimate is made from, the change of a determinant's logarithm that counts as none, and
#: steps after which one that goes round in circles, as bins of distances allow, is left where it is.
SHARE, STILL, STEPS = 0.75, 1e-3, 12
#: Least standard deviation of each coordinate: closer groups, as of copies, don't make rules of their own.
FLOORS = (0.12, 0.04, 0.12, 0.2)
#: A group of fewer texts that pass the base rules has no estimate of its own; the next wider one judges its texts.
MIN_GROUP = 40
#: The name of a key over which a wider group goes.
ANY = "*"
#: A clean text is rejected about this seldom if its vector is normally distributed.
TAIL = 1e-6
DIMS = len(FLOORS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
XS = [f"x{i}" for i in range(DIMS)]
PAIRS = list(combinations_with_replacement(range(DIMS), 2))


def _upper_tail(x: float, dims: int) -> float:
    """P(chi-square with an even number of dims > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))


def chi_square(tail: float, dims: int = DIMS) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _upper_tail(mid, dims) > tail else (low, mid)
    return low


def text_statistics(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) to docs, whose text column goes.

    A null or empty text has 0 of each. Windows are compared by a 64-bit hash of their words within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    others = [c for c in docs.columns if c not in ("text", "words", "grams", *COUNTS)]
    counted = docs.select(
        *others,
        words_of(F.col("text")).alias("words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    starts = F.sequence(F.lit(0), F.size("words") - WINDOW)
    grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]))
    grams = F.when(F.size("words") > WINDOW, grams)
    counted = counted.select(
        *others,
        "n_symbols",
        "n_dup_lines",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        grams.alias("grams"),
    )
    #: The windows in the order of their hashes; those with an equal neighbour are found again; sorted starts then
    #: cover min(8, distance to the next) words each, and the last one 8.
    covered = F.expr(
        f"""aggregate(
          transform(array(array_sort(transform(filter(
            transform(array(sort_array(transform(grams, (g, i) -> struct(g, i)))), r ->
              transform(r, (x, k) -> struct(x.i AS i,
                coalesce(get(r, k - 1).g = x.g, false) OR coalesce(get(r, k + 1).g = x.g, false) AS twice)))[0],
            x -> x.twice), x -> x.i))), a -> a)[0],
          struct(cast(-{WINDOW} AS int) AS last, 0L AS total),
          (s, i) -> struct(i AS last, s.total + least({WINDOW}, i - s.last) AS total),
          s -> s.total)"""
    )
    return counted.select(
        *others,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _vector(df: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    xs = [
        F.log(F.greatest(F.col("word_chars") / words, F.lit(1.0))),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return df.withColumns(dict(zip(XS, xs, strict=True)))


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean m_i and Cholesky factor l_ij of the covariance, with the floors' squares on its diagonal, and its log_det.

    In a wider group they count twice: as the least variance within groups, and as that of the small groups' means.
    """
    wide = F.greatest(*[F.when(F.col(k) == ANY, F.lit(2.0)).otherwise(F.lit(1.0)) for k in keys], F.lit(1.0))
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(XS)]
    sums += [F.avg(F.col(XS[i]) * F.col(XS[j])).alias(f"s{i}{j}") for i, j in PAIRS]
    out = rows.groupBy(*keys).agg(*sums)
    for j in range(DIMS):
        for i in range(j, DIMS):
            cov = F.col(f"s{j}{i}") - F.col(f"m{j}") * F.col(f"m{i}")
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + F.lit(FLOORS[i] ** 2) * wide
            for k in range(j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            cell = F.sqrt(F.greatest(cov, F.lit(1e-9))) if i == j else cov / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", cell)
    log_det = sum((F.log(f"l{i}{i}") for i in range(1, DIMS)), F.log("l00"))
    factor = [f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)]
    return out.select(*keys, *[f"m{i}" for i in range(DIMS)], *factor, log_det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    ys: list[Column] = []
    for i in range(DIMS):
        y = F.col(XS[i]) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * ys[k]
        ys.append(y / F.col(f"l{i}{i}"))
    return sum((y * y for y in ys[1:]), ys[0] * ys[0])


def _bin(x: Column) -> Column:
    return F.floor(F.log1p(x) * 200).cast("int")


def _closest(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The rows within the bin of d2 up to which the share of each group lies; bins are about half a percent wide."""
    binned = rows.withColumn("bin", _bin(F.col("d2")))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    edge = (
        counts.select(*keys, "bin", ((upto >= F.ceil(total * share))).alias("reached"))
        .groupBy(*keys)
        .agg(F.min(F.when(F.col("reached"), F.col("bin"))).alias("edge"))
    )
    return binned.join(edge, keys).filter("bin <= edge").drop("bin", "edge")


def _middles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The median of each coordinate of each group, to a thousandth, from counts of rounded values."""
    long = rows.select(*keys, F.posexplode(F.array(*[F.round(F.col(x) * 1000).cast("int") for x in XS])).alias("i", "v"))
    counts = long.groupBy(*keys, "i", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "i").orderBy("v"))
    total = F.sum("n").over(Window.partitionBy(*keys, "i"))
    return (
        counts.select(*keys, "i", "v", (upto * 2 >= total).alias("past"))
        .filter("past")
        .groupBy(*keys)
        .agg(*[F.min(F.when(F.col("i") == i, F.col("v") / 1000)).alias(f"m{i}") for i in range(DIMS)])
    )


def robust_estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The estimate of each group of rows (keys without nulls, x0..x3)."""
    near = sum((((F.col(x) - F.col(f"m{i}")) / FLOORS[i]) ** 2 for i, x in enumerate(XS)), F.lit(0.0))
    middle = rows.join(_middles(rows, keys), keys).select(*keys, *XS, F.lit("middle").alias("start"), near.alias("d2"))
    mean = rows.join(_estimate(rows, keys), keys).select(*keys, *XS, F.lit("mean").alias("start"), _distance().alias("d2"))
    group = [*keys, "start"]
    started = _closest(middle.unionByName(mean), group, 0.5)
    found = stored(_estimate(started, group))
    both = rows.withColumn("start", F.explode(F.array(F.lit("middle"), F.lit("mean"))))
    for _ in range(STEPS):
        measured = both.join(found, group).select(*group, *XS, _distance().alias("d2"))
        before, found = found, stored(_estimate(_closest(measured, group, SHARE), group))
        moved = found.join(before.select(*group, F.col("log_det").alias("was")), group).filter(F.abs(F.col("log_det") - F.col("was")) > STILL)
        if moved.isEmpty():
            break
    best = Window.partitionBy(*keys).orderBy("log_det", "start")
    return found.withColumn("_best", F.row_number().over(best)).filter("_best = 1").drop("_best", "start")


def _judging(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and _j of each: the group itself if MIN_GROUP of its texts pass, else the least wider one of which so many
    do, with ANY for the last keys; at last that of all texts, of however few."""
    sizes = stats.groupBy(*keys).agg(F.count_if(~F.col("base_failed")).alias("n0"))
    for k in range(1, len(keys)):
        wider = keys[: len(keys) - k]
        sizes = sizes.join(sizes.groupBy(*wider).agg(F.sum("n0").alias(f"n{k}")), wider)
    level = F.lit(len(keys))
    for k in reversed(range(len(keys))):
        level = F.when(F.col(f"n{k}") >= MIN_GROUP, k).otherwise(level)
    return sizes.select(*keys, *[F.when(level < len(keys) - i, F.col(k)).otherwise(F.lit(ANY)).alias(f"_j{k}") for i, k in enumerate(keys)])


def quality_verdicts(docs: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The columns of docs but text, with the five counts, base_failed, distance2 double and kept boolean.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated 8-word windows. The estimates are made
    from the texts that pass. Null languages or sources make groups of their own. Texts that fail have no part in an
    estimate and are not kept; they have a distance if any text passes. In groups of fewer than MIN_GROUP texts that pass,
    the estimate of the language (the keys without the last) holds, and if that has fewer, that of all texts. Equal rows
    get equal verdicts.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    # a null key becomes a value that no other key has; what else a row has stays out of the way of the names used here
    named = [F.coalesce(F.concat(F.lit("="), F.col(g)), F.lit("null")).alias(k) for k, g in zip(keys, groups, strict=True)]
    carried = [c for c in docs.columns if c not in ("text", "base_failed", "distance2", "kept", *COUNTS)]
    stats = text_statistics(docs.select("text", F.struct(*carried).alias("_row"), *named))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stored(_vector(stats.withColumn("base_failed", failed)))
    judging = stored(_judging(stats, keys))
    wider = [F.struct(*[(F.col(k) if i < len(keys) - n else F.lit(ANY)).alias(k) for i, k in enumerate(keys)]) for n in range(len(keys) + 1)]
    rows = stats.filter(~F.col("base_failed")).select(F.explode(F.array(*wider)).alias("g"), *XS).select("g.*", *XS)
    asked = judging.select(*[F.col(f"_j{k}").alias(k) for k in keys]).distinct()
    found = robust_estimates(stored(rows.join(asked, keys, "left_semi")), keys).withColumnsRenamed({k: f"_j{k}" for k in keys})
    #: A share of the closest rows has a smaller spread than the whole; for a normal one by this factor.
    spread = SHARE / (1 - _upper_tail(chi_square(1 - SHARE), DIMS + 2))
    judged = stats.join(judging, keys).join(found, [f"_j{k}" for k in keys], "left").withColumn("distance2", _distance() / spread)
    inlier = F.coalesce(F.col("distance2") <= chi_square(TAIL), F.lit(True))
    return judged.select(*[F.col("_row")[c].alias(c) for c in carried], *COUNTS, "base_failed", "distance2", (~F.col("base_failed") & inlier).alias("kept"))


def quality_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs. Null and empty texts go; equal rows share their verdict."""
    judged = quality_verdicts(docs.select("doc_id", "text", "lang", "source", F.xxhash64("doc_id", "text").alias("_h")))
    rejected = judged.filter(~F.col("kept")).select("_h", "lang", "source").distinct()
    rejected = stored(rejected.select("_h", F.col("lang").alias("_lang"), F.col("source").alias("_source")))
    same = (F.xxhash64("doc_id", "text") == F.col("_h")) & docs.lang.eqNullSafe(rejected._lang) & docs.source.eqNullSafe(rejected._source)
    return small_join(docs, rejected, same, "left_anti").select(*docs.columns)
