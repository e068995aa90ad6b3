"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words. A document of the source should be taken target / source size times; the whole
part is sure and the fraction is a probability. Two documents at a time, words are moved at random from one
probability to the other until one of the two is 0 or 1, so that both expectations and the source's total of
probability times size stay as they were. Chunks of a source are rounded side by side and leave at most one
fractional document each; those are chunked again, level by level, until one is left in each source. So a source
misses its target by less than the size of one document. So that this is a small one, the few documents that are
large for their source come first: each is paired with all the small ones of its source taken as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, small_join, stored

CHUNK = 256
MAX_COPIES = 3
#: A document of more than this part of its source's words is rounded first, against all the small ones as one.
LARGE = 200


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """source, k int, source_size long, n_docs long, target double.

    Sources by code point, null last, take the weights in turn and share all words; no target is above ``max_copies``
    times its source's size, and what is cut off is shared again by weight until none is above. In the order of cap by
    weight the level per weight of those not yet capped rises up to the first source below its cap and then falls, so
    the level that holds is the largest.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights))
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        totals.withColumn("k", rank)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(max_copies))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(all_rows))
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .select("source", "k", "source_size", "n_docs", "target")
    )


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


#: One transfer between the open document c and the next one e, as SQL over the fold's state s (open, done).
#: up is what can go from e to c and down what can go from c to e, both in words.
_TRANSFER = """
aggregate(
  slice(chunk, 2, size(chunk)),
  named_struct('open', chunk[0], 'done', cast(array() as array<{row}>)),
  (s, e) -> transform(array(named_struct(
      'up', least(s.open.size * (1 - s.open.p), e.size * e.p),
      'down', least(s.open.size * s.open.p, e.size * (1 - e.p)),
      'u', pmod(xxhash64({seed}, s.open.h, e.h), {big}) / {big}D)), m ->
    CASE
      WHEN m.u * (m.up + m.down) < m.down OR m.up + m.down = 0 THEN
        CASE WHEN s.open.size * (1 - s.open.p) <= e.size * e.p
          THEN named_struct('open', {e_less}, 'done', array_append(s.done, {c_one}))
          ELSE named_struct('open', {c_more}, 'done', array_append(s.done, {e_zero})) END
      ELSE
        CASE WHEN s.open.size * s.open.p <= e.size * (1 - e.p)
          THEN named_struct('open', {e_more}, 'done', array_append(s.done, {c_zero}))
          ELSE named_struct('open', {c_less}, 'done', array_append(s.done, {e_one})) END
    END)[0])
"""
FIELDS = ["size", "h", "doc_id", "n", "base", "source_size", "target", "p"]
_ROW = "struct<size:bigint,h:bigint,doc_id:bigint,n:int,base:int,source_size:bigint,target:double,p:double>"


def _with_p(row: str, p: str) -> str:
    kept = ", ".join(f"'{c}', {row}.{c}" for c in ("size", "h", "doc_id", "n", "base", "source_size", "target"))
    return f"named_struct({kept}, 'p', cast(least(greatest({p}, 0D), 1D) as double))"


def _fold(seed: int) -> Column:
    c, e = "s.open", "e"
    return F.expr(
        _TRANSFER.format(
            row=_ROW, seed=f"{seed}L", big=1 << 52,
            c_one=_with_p(c, "1D"), c_zero=_with_p(c, "0D"), e_one=_with_p(e, "1D"), e_zero=_with_p(e, "0D"),
            c_more=_with_p(c, "s.open.p + m.up / s.open.size"), c_less=_with_p(c, "s.open.p - m.down / s.open.size"),
            e_more=_with_p(e, "e.p + m.down / e.size"), e_less=_with_p(e, "e.p - m.up / e.size"),
        )
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, copies, taken, h, n.

    ``copies`` is from 0 to 3 and ``taken`` = copies * size. ``h`` is a hash of the row's text and id and ``n`` numbers
    rows that agree in both, so that (h, n) names a row. A null text has size 0; a null source is a source; documents
    without words take 0 words whatever their copies. An empty table gives an empty result. The same rows give the
    same result in any order and on any cluster.
    """
    sized = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", "source").alias("h")
    )
    sized = sized.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("doc_id")))
    sized = stored(sized)
    targets = stored(source_targets(sized, weights))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    rows = (
        sized.join(targets, sized.source.eqNullSafe(targets.source))
        .select("k", "doc_id", "size", "h", "n", "source_size", "target", "n_docs", share.alias("share"))
        .withColumn("base", F.least(F.floor("share"), F.lit(MAX_COPIES)).cast("int"))
        .withColumn("p", F.col("share") - F.col("base"))
    )
    row, tossed = F.struct(*FIELDS), F.when(_uniform(F.lit(seed), "h", "n") < F.col("p"), 1.0).otherwise(0.0)
    empty, large = F.col("size") == 0, F.col("size") * LARGE > F.col("source_size")
    rest = F.col("source_size") - F.sum("size")
    pool = F.struct(
        rest.alias("size"), F.lit(0).cast("long").alias("h"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("n"),
        F.first("base").alias("base"), F.col("source_size"), F.first("target").alias("target"), F.first("p").alias("p"),
    )
    heads = (
        rows.filter(large & ~empty)
        .groupBy("k", "source_size")
        .agg(F.sort_array(F.concat(F.collect_list(row), F.when(rest > 0, F.array(pool)).otherwise(F.array().cast(f"array<{_ROW}>"))), asc=False).alias("chunk"))
        .select("k", _fold(seed).alias("s"))
    )
    heads = stored(heads)
    ends = heads.select("k", F.explode(F.concat("s.done", F.array("s.open"))).alias("e")).select("k", "e.*")
    pools = ends.filter("n = 0").select("k", F.col("p").alias("pool_p"))
    small = rows.filter(~large & ~empty).join(pools, "k", "left").withColumn("p", F.coalesce("pool_p", "p"))
    open_heads = ends.filter("n > 0 AND p > 0 AND p < 1").join(targets.select("k", "n_docs"), "k")
    whole = (F.col("p") <= 0) | (F.col("p") >= 1)
    done = [
        rows.filter(empty).select(*FIELDS[:-1], tossed.alias("p")),
        ends.filter("n > 0").filter(whole).select(*FIELDS),
        small.filter(whole).select(*FIELDS),
    ]
    columns = ["k", "n_docs", *FIELDS]
    left = small.filter(~whole).select(*columns).unionByName(open_heads.select(*columns))
    most, level, counted = targets.agg(F.max("n_docs")).first()[0] or 0, 0, F.col("n_docs")
    while True:
        counted = F.ceil(counted / F.lit(CHUNK))
        chunked = (
            left.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + level), "h", "n"), counted))
            .groupBy("k", "part", "n_docs")
            .agg(F.sort_array(F.collect_list(row), asc=False).alias("chunk"))
            .select("k", "n_docs", _fold(seed + level).alias("s"))
        )
        chunked = stored(chunked)
        done.append(chunked.select(F.inline("s.done")))
        left = chunked.select("k", "n_docs", "s.open.*")
        level += 1
        if (most := -(-most // CHUNK)) <= 1:
            break
    out = left.select(*FIELDS[:-1], tossed.alias("p"))
    for d in done:
        out = out.unionByName(d)
    copies = F.col("base") + F.col("p").cast("int")
    return out.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"), "h", "n",
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, with the columns of ``docs``.

    Nulls, repeated rows and empty tables are as ``mix`` has them. Rows that repeat id, text and source are dealt their
    copies one by one; the others find theirs by a hash, without a shuffle of texts where the mix's rows are few enough.
    """
    chosen = stored(mix(docs, weights, seed).select(F.col("h").alias("__h"), F.col("n").alias("__n"), F.col("copies").alias("__copies")))
    repeated = stored(chosen.filter("__n > 1").select("__h").distinct())
    taken = chosen.filter("__copies > 0")
    keyed = docs.withColumn("__h", F.xxhash64("doc_id", "text", "source"))
    single = small_join(keyed, small_join(taken, repeated, "__h", "left_anti").select("__h", "__copies"), "__h")
    several = small_join(keyed, repeated, "__h", "left_semi")
    several = several.withColumn("__n", F.row_number().over(Window.partitionBy("__h").orderBy("doc_id"))).join(taken, ["__h", "__n"])
    both = single.select(*docs.columns, "__copies").unionByName(several.select(*docs.columns, "__copies"))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
