"""Quality rules with host verdicts: document counts, failures by host, shrunk rates.

A document's counts come from its own row with array functions. Failures of each rule, the
base rules among them, are summed by host; a beta prior fitted to the hosts' rates shrinks each
host's rate. A rule binds the documents of a host whose shrunk rate is above one half or lies
far above the prior.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import written
from .common import SPACES, words

HOST_LIMIT = 0.5              #: a rule binds where the shrunk rate is above this ...
HOST_SPREADS = 2.0            #: ... or this many of the prior's standard deviations above its mean
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0      #: of the prior, in documents

#: Soft rules, as SQL over the counts of a document.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "repeats": "100 * n_repeat_words > 30 * n_words",
}
#: Failed base rules; where they bind, the host is bad as a whole and all soft rules bind.
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
RATED = RULES | {"base": BASE}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeat_words(df: DataFrame, arr: str, out: str) -> DataFrame:
    """Words inside three-word windows that occur at least twice in the array `arr`.

    One sort of (64-bit hash, position) brings equal windows together; repeated positions,
    sorted, then cover their words.
    """
    window = F.expr(f"transform(sequence(0, size({arr}) - 3), i -> struct(xxhash64({arr}[i], {arr}[i + 1], {arr}[i + 2]) as h, i as at))")
    df = df.withColumn("_win", F.when(F.size(arr) >= 3, F.sort_array(window)).otherwise(F.expr("cast(array() as array<struct<h: bigint, at: int>>)")))
    df = df.withColumn("_at", F.expr(
        "sort_array(transform(filter(_win, (x, i) -> coalesce(x.h = get(_win, i - 1).h, false) or coalesce(x.h = get(_win, i + 1).h, false)), x -> x.at))"))
    return df.withColumn(out, F.expr(
        "aggregate(transform(_at, (p, i) -> cast(least(3, p - coalesce(get(_at, i - 1), -3)) as bigint)), 0L, (s, x) -> s + x)")
    ).drop("_win", "_at")


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the COUNTS (long) and `base_failed`; NULL counts as an empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", words(F.col(text)))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = repeat_words(df, "_words", "n_repeat_words")
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    return df.withColumn("base_failed", F.expr(BASE)).drop("_words", "_lines")


def host_verdicts(counted: DataFrame, host: str = "host") -> DataFrame:
    """One row per host: documents, and per rated rule failures, shrunk rate and whether it binds.

    The prior's mean and strength come from the mean and variance of the hosts' own rates; hosts
    without spread get the strongest prior. The limit is its mean and HOST_SPREADS of its standard
    deviations, HOST_LIMIT at most. Only one row of moments leaves the hosts' table.
    """
    hosts = written(counted.groupBy(host).agg(F.count(F.lit(1)).alias("docs"), *(
        F.sum(F.expr(rule).cast("long")).alias(f"failed_{name}") for name, rule in RATED.items())), "hosts")
    rate = lambda name: F.col(f"failed_{name}") / F.col("docs")
    moments = hosts.agg(*(f(rate(n)).alias(f"{k}_{n}") for n in RATED for k, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    out = hosts
    for name in RATED:
        mean, var = moments[f"mean_{name}"] or 0.0, moments[f"var_{name}"] or 0.0
        strength = min(MOST_STRENGTH, max(LEAST_STRENGTH, mean * (1 - mean) / var - 1)) if var > 0 else MOST_STRENGTH
        limit = min(HOST_LIMIT, mean + HOST_SPREADS * math.sqrt(mean * (1 - mean) / (strength + 1)))
        shrunk = (F.col(f"failed_{name}") + mean * strength) / (F.col("docs") + strength)
        out = out.withColumns({f"rate_{name}": shrunk, f"binds_{name}": shrunk > limit})
    return out


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(id, counts, base_failed, host, kept) for every row; a NULL host is a host of its own.

    A document is kept if it passes the base rules and every soft rule that binds its host; on a
    host that the base rules bind, all soft rules do. Repeated rows are judged alike; an empty
    table gives no rows.
    """
    counted = written(document_counts(docs.select(F.col(doc_id), F.col(host).alias("host"), F.col(text).alias("_text")), "_text")
                      .drop("_text"), "counts")
    verdict = written(host_verdicts(counted).select(F.col("host").alias("_host"), *(f"binds_{n}" for n in RATED)), "verdicts")
    joined = counted.join(verdict, F.col("host").eqNullSafe(F.col("_host")))
    hit: Column = F.lit(False)
    for name, rule in RULES.items():
        hit = hit | ((F.col(f"binds_{name}") | F.col("binds_base")) & F.expr(rule))
    return joined.withColumn("kept", ~F.col("base_failed") & ~hit).drop("_host", *(f"binds_{n}" for n in RATED))
