"""Mixing sources to target weights: Efraimidis-Spirakis order, cut at a word budget.

Targets fill up like water: every source gets its weight's share, none above `CEILING`
times its own size. A source's budget is met by complete epochs of all its documents and
then by its documents in order of exponential keys -ln(u) / w, where u comes from a hash of
the id and w is the document's quality weight. The cut is found without putting a source
into one task: words are summed per (source, key range), ranges are prefix-summed, and
only the range that holds the cut is ordered row by row. What each document takes then
follows from its own row and one plan row of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import written
from .common import fresh, words

WEIGHTS = (3, 1, 2)           #: of the sources in code-point order, repeating
SHARE = 1.5                   #: of all words
CEILING = 2                   #: times a source's own words
RANGES = 4096                 #: key ranges per source
SYMBOLS = "[#*$%&|<>]"


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose down to 0.5 for one symbol or more per word."""
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS))
    return 1 - F.least(F.lit(1.0), F.coalesce(F.try_divide(symbols.cast("double"), size), F.lit(1.0))) / 2


def exponential_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / w with u in (0, 1) from 48 bits of the id's MD5; equal ids share a key."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")
    return -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 48))) / weight


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows with `_m`: id, source, size, key and key range, the inputs of plan and shares."""
    m = fresh(docs, "m")
    sized = docs.withColumn(m, F.size(words(F.col(text))).cast("long"))
    key = exponential_key(F.col(doc_id), quality_weight(F.col(text), F.col(m)))
    return sized.withColumn(m, F.struct(
        F.col(doc_id).cast("string").alias("id"), F.col(source).cast("string").alias("source"), F.col(m).alias("size"), key.alias("key"))
    ).withColumnRenamed(m, "_m")


def _range(key: Column) -> Column:
    return F.least(F.floor((1 - F.exp(-key)) * RANGES), F.lit(RANGES - 1)).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target) for one row per source: the level at which all budgets fit.

    Sources are few against documents: their table is numbered and summed in one ordered pass.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    by_cap = Window.orderBy(F.try_divide(F.col("source_size").cast("double"), F.col("w")), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (sizes.withColumn("w", weight)
              .withColumn("left", F.lit(share) * F.sum("source_size").over(everything)
                          - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
              .withColumn("open", F.sum("w").over(onward))
              .withColumn("cap", (ceiling * F.col("source_size")).cast("double"))
              # the first source that its share does not overfill sets the level for all after it
              .withColumn("level", F.when(F.col("left") * F.col("w") <= F.col("cap") * F.col("open"), F.struct("left", "open")))
              .withColumn("level", F.first("level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, 0))))
    fits = F.col("level").isNotNull()
    return filled.select("source", "source_size",
                         F.when(fits, F.col("w") * F.col("level.left") / F.col("level.open")).otherwise(F.col("cap")).alias("target"))


def mixing_plan(rows: DataFrame) -> DataFrame:
    """One row per source from rows (id, source, size, key): target, epochs, and where the last epoch is cut."""
    rows = rows.withColumn("range", _range(F.col("key")))
    ranges = written(rows.groupBy("source", "range").agg(F.sum("size").alias("n")), "mix-ranges")
    goal = written(targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")))
                   .withColumn("words", F.floor("target").cast("long"))
                   .withColumn("epochs", F.coalesce(F.try_divide(F.col("words"), F.col("source_size")).cast("long"), F.lit(0)))
                   .withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size")), "mix-goal")
    along = Window.partitionBy("source").orderBy("range")
    edge = (ranges.withColumn("upto", F.sum("n").over(along)).join(_named(goal, "g"), F.col("source").eqNullSafe(F.col("g_source")))
            .where((F.col("upto") > F.col("g_rest")) & (F.col("upto") - F.col("n") <= F.col("g_rest")) & (F.col("n") > 0))
            .groupBy("source").agg(F.min_by(F.struct("range", (F.col("upto") - F.col("n")).alias("before"), F.col("g_rest").alias("rest")), "range").alias("e"))
            .select(F.col("source").alias("e_source"), "e.*"))
    edge = written(edge.withColumnRenamed("range", "e_range"), "mix-edge")
    inside = (rows.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("range") == F.col("e_range")))
              .groupBy("source", "key", "id").agg(F.sum("size").alias("tied"), F.first("before").alias("before"), F.first("rest").alias("rest"))
              .withColumn("upto", F.col("before") + F.sum("tied").over(Window.partitionBy("source").orderBy("key", "id"))))
    cut = (inside.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tied") <= F.col("rest")))
           .groupBy("source").agg(F.min_by(F.struct("key", "id", "tied", (F.col("rest") - F.col("upto") + F.col("tied")).alias("part")),
                                           F.struct("key", "id")).alias("cut"))
           .select(F.col("source").alias("c_source"), "cut"))
    return written(goal.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source", "words", "rest"), "mix-plan")


def _named(df: DataFrame, mark: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{mark}_{c}") for c in df.columns))


def shares(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Add `size`, `source_size`, `target` and `taken` to measured rows; the plan has one row per source.

    The row at the cut takes the words still missing; equal ids at the cut share them.
    """
    m = lambda c: F.col("_m")[c]
    first = ((m("key") < F.col("p_cut.key")) | ((m("key") == F.col("p_cut.key")) & (m("id") < F.col("p_cut.id"))))
    at = (m("key") == F.col("p_cut.key")) & m("id").eqNullSafe(F.col("p_cut.id"))
    extra = (F.when(F.col("p_cut").isNull(), 0).when(at, F.expr("_m.size * p_cut.part div p_cut.tied"))
             .when(first, m("size")).otherwise(0))
    joined = docs.join(_named(plan, "p"), m("source").eqNullSafe(F.col("p_source")))
    values = {"size": m("size"), "source_size": F.col("p_source_size"), "target": F.col("p_target"),
              "taken": (F.col("p_epochs") * m("size") + extra).cast("long")}
    return joined.withColumns(values).drop("_m", *(f"p_{c}" for c in plan.columns))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of `docs` with `size`, `source_size`, `target` and `taken` words, repeats counted.

    NULL and blank texts have size 0 and take nothing; NULL is a source of its own, last in
    order; a NULL id hashes as an empty text. Repeated rows are rows of their own. Columns of
    the four names are replaced. Reruns agree, since keys come from ids alone.
    """
    rows = measured(docs, doc_id, text, source)
    return shares(rows, mixing_plan(written(rows.select("_m.*"), "mix-sizes")))


def whole(mixed: DataFrame) -> DataFrame:
    """`taken` of each row of `mix` as whole copies: the document at the cut counts in full or not, whichever is nearer to the target."""
    copies = F.expr("(2 * taken + size) div (2 * greatest(size, 1))")
    return mixed.withColumn("taken", copies * F.col("size"))


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """Each row of `mix` as often as it is taken; the last copy of a row at the cut keeps the words taken."""
    whole = F.expr("taken div greatest(size, 1)")
    part = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    out = mixed.withColumn("_copy", F.explode(copies))
    cut = F.array_join(F.slice(words(F.col(text)), F.lit(1), F.greatest(F.col("_copy"), F.lit(1)).cast("int")), " ")
    return out.withColumn(text, F.when(F.col("_copy") >= 0, cut).otherwise(F.col(text))).drop("_copy", "size", "source_size", "target", "taken")
