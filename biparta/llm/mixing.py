"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Targets: the budget (a share of all words) is dealt to sources by weight; a source takes
at most ``max_copies`` times its words, and what it leaves is dealt to the others again.
Inside a source a document expects e = target / words copies (or e in proportion to a
weight column). It gets floor(e) whole copies for certain; for one copy more, with
inclusion probability p = e - floor(e), documents are ranked by the random odds u/(1-u)
over the inclusion odds p/(1-p), and the first ranks are taken up to the fixed size, the
words that the certain copies leave open. The last one is taken if that comes nearer.

No source is ever sorted whole: ranks are binned, bins are summed, and only the bin that
holds the end of the sample is ordered row by row. What is joined to the documents has one
row per source, is written first, and is broadcast only if Spark finds it small.

Defined cases: a null text has no words; a null source is a source, the last one; draws
depend on the id alone, so reruns agree, and repeated rows (equal id and size) are taken or
left together; a source without words has target 0 and keeps no copy; an empty table mixes
to an empty one; new columns start with ``mix_`` and replace columns of such names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biparta.functions.hashing import draw_uniform
from biparta.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_COPIES = 2
SEED = 41
# Documents per bin of ranks, on average.
BIN_ROWS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share_percent: int, max_copies: int) -> DataFrame:
    """One row per source: ``mix_source, mix_source_size, mix_rows, mix_weighted, mix_target``.

    With sources ordered by cap / weight, those at their cap come first, and the level
    (words per unit of weight) of the rest is the largest of the levels found by taking
    away ever more of the first ones. The table has a row per configured source, so one
    task orders it.
    """
    per = sized.groupBy("mix_source").agg(
        F.sum("mix_size").alias("mix_source_size"), F.count(F.lit(1)).alias("mix_rows"), F.sum(F.col("mix_weight") * F.col("mix_size")).alias("mix_weighted")
    )
    place = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.lit(list(weights)), (place % len(weights) + 1).cast("int")).cast("bigint")).withColumn("cap", F.col("mix_source_size") * max_copies)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("mix_source_size").over(everything).cast("double") * share_percent / 100
    left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")) / left)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("w"))
    return per.select("mix_source", "mix_source_size", "mix_rows", "mix_weighted", target.alias("mix_target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies, mix_taken`` (words, repeats counted)."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_") and c not in (id_col, text_col, source_col, weight_col)])
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    small = docs.select(F.col(source_col).alias("mix_source"), F.col(id_col).alias("mix_id"), n_words(F.col(text_col)).alias("mix_size"), weight.alias("mix_weight"))
    sized = materialize(small, "mix-sizes")
    sources = materialize(source_targets(sized, weights, share_percent, max_copies), "mix-sources")

    def ranked(df: DataFrame, table: DataFrame) -> DataFrame:
        """Adds certain copies, rank key and bin to rows with ``mix_source, mix_id, mix_size, mix_weight``."""
        out = df.join(table.withColumnRenamed("mix_source", "mix_s"), F.col("mix_source").eqNullSafe(F.col("mix_s"))).drop("mix_s")
        if weight_col is None:
            expected = F.coalesce(F.try_divide("mix_target", "mix_source_size"), F.lit(0.0))
        else:
            expected = F.least(F.lit(float(max_copies)), F.coalesce(F.try_divide(F.col("mix_target") * F.col("mix_weight"), "mix_weighted"), F.lit(0.0)))
        out = out.withColumn("mix_e", expected).withColumn("mix_certain", F.floor("mix_e"))
        p, u = F.col("mix_e") - F.col("mix_certain"), draw_uniform(seed, F.col("mix_id"))
        rank = F.when(p > 0, u / (1 - u) * ((1 - p) / p))
        out = out.withColumn("mix_rank", rank)
        bins = F.greatest(F.lit(1), F.ceil(F.col("mix_rows") / bin_rows))
        return out.withColumn("mix_bin", F.floor(F.col("mix_rank") / (1 + F.col("mix_rank")) * bins))

    first = ranked(sized, sources)
    open_words = F.col("mix_target") - F.col("mix_fixed")
    fixed = first.groupBy("mix_source").agg(F.sum(F.col("mix_certain") * F.col("mix_size")).cast("double").alias("mix_fixed"))
    bins = first.filter(F.col("mix_rank").isNotNull()).groupBy("mix_source", "mix_bin").agg(F.sum("mix_size").alias("words"))
    upto = Window.partitionBy("mix_source").orderBy("mix_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)).cast("double"))
        .join(fixed.withColumnRenamed("mix_source", "s"), F.col("mix_source").eqNullSafe(F.col("s")))
        .join(sources.select(F.col("mix_source").alias("t"), "mix_target"), F.col("mix_source").eqNullSafe(F.col("t")))
        .filter(F.col("before") <= open_words)
        .groupBy("mix_source")
        .agg(F.max_by(F.struct(F.col("mix_bin").alias("end_bin"), F.col("before").alias("end_before"), open_words.alias("end_open")), "mix_bin").alias("e"))
        .select("mix_source", "e.*")
    )
    bounded = materialize(sources.join(ends.withColumnRenamed("mix_source", "s"), F.col("mix_source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-ends")
    last = ranked(sized, bounded).filter(F.col("mix_bin") == F.col("end_bin"))
    key = F.struct(F.col("mix_rank").alias("a"), F.col("mix_id").alias("b"), F.col("mix_size").alias("c"))
    alike = last.groupBy("mix_source", key.alias("key"), "end_before", "end_open").agg(F.sum("mix_size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("mix_source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    taken = alike.withColumn("at", F.col("end_before") + running - F.col("words") / 2).filter(F.col("at") <= F.col("end_open"))
    cuts = taken.groupBy("mix_source").agg(F.max("key").alias("end_key"))
    final = materialize(bounded.join(cuts.withColumnRenamed("mix_source", "s"), F.col("mix_source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-cuts")

    own = docs.withColumns({"mix_source": F.col(source_col), "mix_id": F.col(id_col), "mix_size": n_words(F.col(text_col)), "mix_weight": weight})
    full = ranked(own, final)
    extra = (F.col("mix_bin") < F.col("end_bin")) | ((F.col("mix_bin") == F.col("end_bin")) & (key <= F.col("end_key")))
    copies = (F.col("mix_certain") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)).cast("bigint")
    return full.withColumn("mix_copies", copies).select(*[docs[c] for c in docs.columns], "mix_size", "mix_source_size", "mix_target", "mix_copies", (F.col("mix_copies") * F.col("mix_size")).alias("mix_taken"))


def repeat_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus itself: every document as often as it is taken."""
    times = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return mixed.filter(F.col("mix_copies") > 0).select(*columns, times.alias("mix_copy")).select(*columns)
