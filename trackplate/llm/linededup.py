"""Line dedup by an exact set-similarity join of line tokens, in DataFrame functions only.

A line's tokens are its distinct lower-cased words. A line is removed if an earlier line
(by document id, then line number) has a Jaccard similarity of JACCARD or more with it;
blank lines stay. Equal sets are one class, placed at its first line. Classes meet on the
rarest tokens of their sets (prefix filter); pairs that fail the length, positional or
parity bound are not formed, the others are verified on the whole sets, whose texts are
read again.

Classes that share two of their rarest tokens are first held against the earliest class of
that pair: a group of near copies goes with a few comparisons per member. What remains is
then compared with every earlier class of its tokens' lists, removed or not, pair by pair.

Rarity comes from word counts of the whole corpus in a table of fixed size, indexed by
hash; any common order keeps the join exact, a better one only makes lists shorter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import written
from .common import SPACES, fresh, with_twin

ABOVE, BELOW = 4, 5           #: JACCARD = 4/5
TABLE_BITS, ROW_BITS = 22, 11  #: of the count table: 4M counters in 2,048 rows
FILTER_BITS = 24              #: of the bitmaps of documents and lines that are compared
ONCE, LONG = 16, 128          #: levels of one occurrence, and of 255: pairs of tokens from there on have several first classes
PIECES = 16                   #: of such a pair's list, each with a first class of its own
LEADING = ((0, 1), (1, 2), (0, 2))  #: pairs of a class's rarest tokens that find it a first class


def plain_lines(text: str) -> Column:
    """The \\n-split lines in lower case, with the blank as their only white space."""
    low = F.lower(F.col(text))
    return F.split(F.when(F.col(text).rlike(r"[\t\x0b\f\r]"), F.translate(low, "\t\x0b\f\r", "    ")).otherwise(low), "\n")


def line_words(t: Column) -> Column:
    return F.array_remove(F.split(t, " "), "")


def word_hashes(t: Column) -> Column:
    return F.array_distinct(F.transform(line_words(t), lambda w: F.xxhash64(w)))


def line_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, line, h): the lines that have a word, numbered from 0, as hashes of their distinct words."""
    return docs.select(F.col(doc_id).alias("doc"), F.posexplode(F.transform(plain_lines(text), word_hashes)).alias("line", "h")).where(F.size("h") > 0)


def rarity_levels(docs: DataFrame, text: str) -> DataFrame:
    """One row, one column: array of rows of counters, 16 * log2(1 + count) of each hash slot's words."""
    slots = (docs.select(F.explode(plain_lines(text)).alias("t")).select(F.explode(line_words(F.col("t"))).alias("w")).select(F.xxhash64("w").alias("h"))
             .select((F.col("h").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")))
    level = F.round(16 * F.log2(1.0 + F.coalesce("n", F.lit(0)))).cast("smallint")
    dense = docs.sparkSession.range(1 << TABLE_BITS).withColumnRenamed("id", "slot").join(slots, "slot", "left")
    rows = (dense.groupBy(F.shiftright("slot", ROW_BITS).alias("row"))
            .agg(F.sort_array(F.collect_list(F.struct("slot", level.alias("v")))).alias("v"))
            .select("row", F.col("v.v").alias("v")))
    return rows.agg(F.sort_array(F.collect_list(F.struct("row", "v")))["v"].alias("levels"))


def token_sets(lines: DataFrame, levels: Column) -> DataFrame:
    """(doc, line, codes): ascending distinct tokens, the rare first; a token is its level and 53 hash bits."""

    def code(h: Column, counters: Column) -> Column:
        slot = h.bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
        level = counters[F.shiftright(slot, ROW_BITS).cast("int")][slot.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("int")]
        return F.shiftleft(level.cast("long"), 53).bitwiseOR(F.shiftrightunsigned(h, 11))

    # The subquery's column is used once, so the optimizer puts it straight into zip_with, which then
    # holds one reference to the table per token and copies nothing.
    return lines.select("doc", "line", "h", levels.alias("_levels")).select("doc", "line", F.sort_array(F.array_distinct(
        F.zip_with("h", F.array_repeat("_levels", F.size("h")), code))).alias("codes"))


def line_classes(sets: DataFrame) -> DataFrame:
    """(doc, line, n, b, c, p): a row per distinct set, at its first line, with its prefix tokens and 128 parity bits."""
    n = F.size("codes")
    prefix = (n - F.ceil(F.lit(ABOVE) * n / F.lit(BELOW)) + 1).cast("int")
    parity = lambda half: F.expr(f"aggregate(codes, 0L, (a, x) -> if((x & 64) = {half}, a ^ shiftleft(1L, cast(x & 63 as int)), a))")
    return (sets.select("doc", "line", n.alias("n"), F.xxhash64("codes").alias("s"), F.hash("codes").alias("s2"),
                        parity(0).alias("b"), parity(64).alias("c"), F.slice("codes", F.lit(1), prefix).alias("p"))
            .groupBy("s", "s2", "n", "b", "c").agg(F.min(F.struct("doc", "line")).alias("at"), F.first("p").alias("p"))
            .select("at.doc", "at.line", "n", "b", "c", "p"))


def _may_match(x: str, y: str, positional: bool = False) -> str:
    """Parity, length and positional bounds on the overlap of two sets that share a token; positional where it is at k, with all parities."""
    n = lambda k: f"({k}_line_n & 4294967295)"
    both = f"({n(x)} + {n(y)})"
    odd = f"bit_count({x}_b ^ {y}_b)" + (f" - bit_count({x}_c ^ {y}_c)" if positional else "")
    return (f"{ABOVE + BELOW} * ({both} - {odd}) >= {2 * ABOVE} * {both}"
            f" and {BELOW} * least({n(x)}, {n(y)}) >= {ABOVE} * greatest({n(x)}, {n(y)})"
            + (f" and {ABOVE + BELOW} * least({x}_left, abs({y}_left)) >= {ABOVE} * {both}" if positional else ""))


def _earlier(y: str, x: str) -> str:
    return f"({y}_doc < {x}_doc or {y}_doc <=> {x}_doc and shiftright({y}_line_n, 32) < shiftright({x}_line_n, 32))"


def _level(token: str) -> Column:
    return F.shiftright(token, 53)


def _sided(lists: DataFrame, k: str) -> DataFrame:
    return lists.select("token", *(F.col(c).alias(f"{k}_{c}") for c in lists.columns[1:]))


def _pairs(found: DataFrame) -> DataFrame:
    """(y_doc, y_line, doc, line) of pairs of an earlier class y and a later one x, each once."""
    line = lambda k: F.shiftright(F.col(f"{k}_line_n"), 32).cast("int")
    return found.select("y_doc", line("y").alias("y_line"), F.col("x_doc").alias("doc"), line("x").alias("line")).distinct()


def _marked(keys: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for every hash in keys (at) and few others: a bitmap, 64 bits a word."""
    slot = lambda at: F.pmod(at, F.lit(1 << FILTER_BITS))
    bits = (keys.select(slot(F.col("at")).alias("slot")).groupBy(F.shiftright("slot", 6).alias("row"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("v")))
    dense = keys.sparkSession.range(1 << FILTER_BITS - 6).withColumnRenamed("id", "row").join(bits, "row", "left")
    table = written(dense.agg(F.sort_array(F.collect_list(F.struct("row", F.coalesce("v", F.lit(0)).alias("v"))))["v"].alias("bits")), "line-filter")

    def test(at: Column) -> Column:
        word = table.scalar()[F.shiftright(slot(at), 6).cast("int")]
        return F.call_function("shiftrightunsigned", word, slot(at).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def _verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, line) of the later lines of `pairs` (y_doc, y_line, doc, line) that reach the similarity; their texts are read again."""
    wanted = written(pairs.select("doc", "line").union(pairs.select("y_doc", "y_line")).distinct(), "line-wanted")
    has_doc, has_line = _marked(wanted.select(F.xxhash64("doc").alias("at"))), _marked(wanted.select(F.xxhash64("doc", "line").alias("at")))
    some = (docs.where(has_doc(F.xxhash64(doc_id))).select(F.col(doc_id).alias("doc"), F.posexplode(plain_lines(text)).alias("line", "t"))
            .where(has_line(F.xxhash64("doc", "line"))).select("doc", "line", word_hashes(F.col("t")).alias("h")))
    sets = written(some.alias("l").join(wanted.alias("w"), F.expr("l.doc <=> w.doc and l.line = w.line"), "left_semi"), "line-sets")
    x, y = sets.select(F.col("doc").alias("xd"), F.col("line").alias("xl"), F.col("h").alias("hx")), sets.select(
        F.col("doc").alias("yd"), F.col("line").alias("yl"), F.col("h").alias("hy"))
    near = F.expr(f"{ABOVE + BELOW} * size(array_intersect(hx, hy)) >= {ABOVE} * (size(hx) + size(hy))")
    return (pairs.join(x, F.expr("doc <=> xd and line = xl")).join(y, F.expr("y_doc <=> yd and y_line = yl")).where(near)
            .select("doc", "line").distinct())


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line) of every line with a word that stays; doc is the id."""
    named, doc = _named(docs, doc_id, text)
    return _kept_lines(named, doc, text).select(F.col("doc.id").alias("doc"), "line")


def _named(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """`docs` with a column that names its texts: the id, and a hash of the text where rows share an id."""
    doc, twin = fresh(docs, "doc"), fresh(docs, "named")
    return with_twin(docs, doc_id, text, twin).withColumn(doc, F.struct(F.col(doc_id).alias("id"), F.col(twin).alias("twin"))).drop(twin), doc


def _kept_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, line) of the lines that stay; `doc_id` names one text."""
    levels = written(rarity_levels(docs, text), "line-levels")
    classes = written(line_classes(token_sets(line_rows(docs, doc_id, text), levels.scalar())), "line-classes")
    # tokens whose slot has one occurrence have no partner
    line_n = F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(F.col("n")).alias("line_n")
    rare = F.slice(F.filter("p", lambda t: _level(t) > ONCE), 1, 1 + max(j for _, j in LEADING))
    piece = F.pmod(F.xxhash64("doc", "line"), F.lit(PIECES))

    def keys(r: Column) -> Column:
        many = lambda *at: F.when(F.greatest(F.lit(0), *(_level(r[k]) for k in at)) >= LONG, piece).otherwise(F.lit(0))
        return F.array_compact(F.array(F.when(F.size(r) == 1, F.xxhash64(r[0], many(0))),
                                       *(F.when(F.size(r) > j, F.xxhash64(r[i], r[j], many(i, j))) for i, j in LEADING)))

    # an array of one, so that the tokens are picked once
    led = (classes.select(F.explode(F.transform(F.array(rare), keys)[0]).alias("key"), F.col("doc").alias("x_doc"), line_n.alias("x_line_n"), F.col("b").alias("x_b"))
           .withColumn("y", F.first(F.struct("x_doc", "x_line_n", "x_b")).over(Window.partitionBy("key").orderBy("x_doc", "x_line_n")))
           .select("x_doc", "x_line_n", "x_b", *(F.col(f"y.x_{c}").alias(f"y_{c}") for c in ("doc", "line_n", "b"))))
    lead = written(_pairs(led.where(_may_match("x", "y") + " and " + _earlier("y", "x"))), "line-led")
    gone = written(_verified(lead, docs, doc_id, text), "line-gone")
    # `left` counts a class's tokens from k on; a class that is gone still stands for later ones, and has a negative
    # `left`, as a filter on it would go below the exchange and part the two sides' common one
    marked = classes.join(gone.select(F.col("doc").alias("g_doc"), F.col("line").alias("g_line")), F.expr("doc <=> g_doc and line = g_line"), "left")
    lists = (marked.select(F.posexplode("p").alias("k", "token"), "doc", line_n, "b", "c", F.when(F.col("g_line").isNull(), F.col("n") - F.col("k")).otherwise(F.col("k") - F.col("n")).alias("left"))
             .drop("k").where(_level("token") > ONCE))
    found = _sided(lists, "y").join(_sided(lists, "x"), "token").where(_may_match("x", "y", positional=True) + " and " + _earlier("y", "x"))
    gone = gone.union(_verified(written(_pairs(found), "line-pairs"), docs, doc_id, text))
    return classes.select("doc", "line").alias("c").join(gone.alias("g"), F.expr("c.doc <=> g.doc and c.line = g.line"), "left_anti")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` with `n_lines` (with a word), `n_removed` and its text without the removed lines.

    NULL stays NULL with 0 lines. Rows of one id (NULL is one) with different texts are documents of
    their own, in the order of a hash of the text; equal rows are one document and judged alike. An empty
    table gives no rows; all columns are kept, the two new names replaced.
    """
    kept = fresh(docs, "kept")
    docs, doc = _named(docs, doc_id, text)
    key = f"{doc}_key"
    stay = written(_kept_lines(docs, doc, text).groupBy(F.col("doc").alias(key)).agg(F.collect_set("line").alias(kept)), "line-kept")
    lines = F.split(F.col(text), "\n")
    blank = lambda x: F.btrim(x, F.lit(SPACES)) == ""
    has = F.coalesce(F.col(kept), F.array().cast("array<int>"))
    out = (docs.join(stay, F.col(doc) == F.col(key), "left")
           .withColumn("n_lines", F.coalesce(F.size(F.filter(lines, lambda x: ~blank(x))), F.lit(0)))
           .withColumn(text, F.array_join(F.filter(lines, lambda x, i: blank(x) | F.array_contains(has, i)), "\n")))
    left = F.coalesce(F.size(F.filter(F.split(F.col(text), "\n"), lambda x: ~blank(x))), F.lit(0))
    return out.withColumn("n_removed", F.col("n_lines") - left).drop(doc, key, kept)
