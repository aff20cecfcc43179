"""Mixing sources to target weights by temperature; DataFrame operations only.

The share of each source's tokens is raised to an exponent and normalised. The exponent is bisected: it is the
largest whose weights have at least TARGET_ENTROPY of the greatest entropy, but no source is repeated more than
MAX_REPEATS times for it. The budget is the smallest with which every document is taken once at least
(``budget`` asks for another), so each source has a number of whole passes and a rest. Each pass is a permutation
of its own: documents are ordered by a keyed digest, cut into blocks of about BLOCK_TOKENS tokens by ranges of
that digest, and the last pass takes documents in order as long as they fit the rest. ``place`` is how far into
its source's budget a document begins; sorting by it gives a mixture that keeps the weights at every length.

A source of any size is summed by partial aggregation; running sums go over blocks first and inside one
block after that, so no task holds more than one block of a hot source, or its table of blocks.

Defined results: a null source is a source; rows that share doc_id and source are one document; null, empty and
blank texts have no tokens: a source without tokens has weight 0 and its documents are taken once; ties of the digest go
to the smaller doc_id, null last; an empty table gives no rows; only doc_id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, stash, table

TARGET_ENTROPY = 0.98
MAX_REPEATS = 4
BLOCK_TOKENS = 1 << 20
SEED = "mix"
#: Halvings of the exponent's range.
STEPS = 40


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, once for each document."""
    return docs.select("doc_id", "source", count_words(F.col("text")).alias("n")).groupBy("doc_id", "source").agg(F.sum("n").alias("n_tokens"))


def plan(own: DataFrame, entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """_source, exponent, weight, _tokens, _budget, _whole, _rest, _blocks of each source: one row each."""
    sums = own.groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").alias("t"))
    one = sums.agg(F.sort_array(F.collect_list(F.struct("s", "t"))).alias("_all"))
    live = F.filter("_all", lambda x: x.t > 0)
    total = F.aggregate(live, F.lit(0).cast("long"), lambda a, x: a + x.t)
    one = one.withColumn("_log", F.transform(live, lambda x: F.log(x.t / total)))  # logarithms of shares
    least, most = F.array_min("_log"), F.array_max("_log")

    def weights(alpha: Column) -> Column:
        raised = F.transform("_log", lambda q: F.exp((q - most) * alpha))
        norm = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        return F.transform(raised, lambda x: x / norm)

    def entropy_of(alpha: Column) -> Column:
        return F.aggregate(weights(alpha), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))

    want = F.lit(float(entropy)) * F.log(F.greatest(F.size("_log"), F.lit(1)).cast("double"))

    def fits(alpha: Column) -> Column:
        """Even enough; the entropy falls as the exponent rises."""
        return entropy_of(alpha) >= want

    def lax(alpha: Column) -> Column:
        """A source of the least share is repeated exp((1 - exponent)(most - least)) times."""
        return (1 - alpha) * (most - least) <= F.log(F.lit(float(max_repeats)))

    def bisect(test, upper: bool) -> Column:
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(b: Column, _: Column) -> Column:
            mid = (b.lo + b.hi) / 2
            ok = test(mid)
            return F.when(ok == F.lit(upper), F.struct(mid.alias("lo"), b.hi.alias("hi"))).otherwise(F.struct(b.lo.alias("lo"), mid.alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)

    one = one.where(F.size("_all") > 0)
    even = F.when(fits(F.lit(1.0)), F.lit(1.0)).otherwise(bisect(fits, True)["lo"])
    few = F.when(lax(F.lit(0.0)), F.lit(0.0)).otherwise(bisect(lax, False)["hi"])
    one = one.withColumn("exponent", F.round(F.greatest(even, few), 9))
    one = one.withColumn("_scale", F.lit(float(budget)) if budget is not None else F.aggregate(F.zip_with(live, weights(F.col("exponent")), lambda x, p: x.t / p), F.lit(0.0), lambda a, b: F.greatest(a, b)))
    one = one.withColumn("_w", weights(F.col("exponent")))
    rows = one.select("exponent", "_scale", F.explode(F.concat(F.zip_with(live, "_w", lambda x, p: F.struct(x.s.alias("s"), x.t.alias("t"), p.alias("p"))), F.transform(F.filter("_all", lambda x: x.t <= 0), lambda x: F.struct(x.s.alias("s"), x.t.alias("t"), F.lit(0.0).alias("p"))))).alias("x"))
    rows = rows.select(F.col("x.s").alias("_source"), "exponent", F.col("x.p").alias("weight"), F.col("x.t").alias("_tokens"), F.round(F.col("_scale") * F.col("x.p")).cast("long").alias("_budget"))
    some = F.col("_tokens") > 0
    whole = F.when(some, F.floor(F.expr("_budget div greatest(_tokens, 1)"))).otherwise(1).cast("long")
    return rows.withColumn("_whole", whole).withColumn("_rest", F.when(some, F.col("_budget") - F.col("_whole") * F.col("_tokens")).otherwise(0).cast("long")).withColumn("_blocks", F.ceil(F.greatest("_tokens", F.lit(1)) / F.lit(float(BLOCK_TOKENS))).cast("long"))


def mix(docs: DataFrame, entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, source, epoch, block, n_tokens, place: a row for each time that a document is taken."""
    own = stash(units(docs), "mix-units")
    planned = own.join(plan(own, entropy, max_repeats, budget), F.col("source").eqNullSafe(F.col("_source")))
    passes = planned.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - F.when(F.col("_rest") > 0, 0).otherwise(1))))
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 8)
    passes = passes.withColumn("_h", F.conv(digest, 16, 10).cast("long")).withColumn("block", F.shiftright(F.col("_h") * F.col("_blocks"), 32))
    sums = passes.groupBy(F.col("_source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b")).agg(F.sum("n_tokens").alias("t"))
    before = sums.withColumn("_before", F.sum("t").over(Window.partitionBy("s", "e").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).drop("t")
    placed = passes.join(before, F.col("_source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")))
    order = Window.partitionBy("_source", "epoch", "block").orderBy("_h", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_end", F.col("_before") + F.sum("n_tokens").over(order))
    taken = placed.where((F.col("epoch") < F.col("_whole")) | (F.col("_end") <= F.col("_rest")))
    start = (F.col("epoch") * F.col("_tokens") + F.col("_end") - F.col("n_tokens")).cast("double")
    return taken.select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "block", "n_tokens", F.when(F.col("_budget") > 0, F.round(start / F.col("_budget"), 9)).otherwise(0.0).alias("place"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their times taken: repeats, and passes (epoch, block, place) in order.

    A document's own columns of these names stay; the new ones are then repeats_found and passes_found."""
    taken = mix(docs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_of")).agg(F.count(F.lit(1)).cast("int").alias("repeats"), F.sort_array(F.collect_list(F.struct("epoch", "block", "place"))).alias("passes"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    whole = rows.join(taken, F.col("row.doc_id").eqNullSafe(F.col("_id")) & F.col("row.source").eqNullSafe(F.col("_of")))
    return whole.select("row.*", *(F.col(c).alias(fresh(c, docs.columns)) for c in ("repeats", "passes")))
