"""Rule-based quality with host-level verdicts, in DataFrame functions only.

Every document is measured against rules on its words, lines and symbols. Failures are summed by host
(a third of all rows may share one: the sums are partial before the shuffle), the failure rates are
shrunk towards an empirical beta prior fitted to all hosts, and the hosts' verdicts are joined back.

Defined cases: a null or empty text has no words and fails the base rule; a null host is a host of its
own; repeated rows are measured and counted one by one; an empty table gives an empty result; further
columns are ignored, whatever their names; texts of any length are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_SHARE = 0.3
WORD_LENGTHS = (2.0, 16.0)
WINDOW = 5
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight in documents, for hosts that differ hardly or wildly.
PRIOR_WEIGHT = (2.0, 10_000.0)


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the measures of each whole text.

    A window is known by a 64-bit hash of its words' 64-bit hashes. Only texts that have some window
    twice sort their windows; the rest stop at the count of distinct ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.col(host).alias("host"), text.alias("t"), F.array_remove(F.split(text, SPACES), "").alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = base.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
    )
    at = lambda i, k: F.get("hashed", i + k)
    windows = F.when(
        F.col("n_words") > WINDOW,
        F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))),
    )
    hashed = counted.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    ranked = hashed.withColumn(
        "ranked",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ),
    )
    same = lambda e, i: e["h"].eqNullSafe(F.get("ranked", i)["h"])
    places = F.array_sort(F.filter(F.transform("ranked", lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["p"])), lambda p: p.isNotNull()))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return ranked.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    """The rules by name, each true where a measured document fails it."""
    words, chars = F.col("n_words"), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "fail_words": words < MIN_WORDS,
        "fail_repeat": F.col("n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT,
        "fail_symbols": F.col("n_symbols") > words * MAX_SYMBOLS_PER_WORD,
        "fail_lines": F.col("n_dup_lines") > F.col("n_lines") * MAX_DUP_LINE_SHARE,
        "fail_length": (words > 0) & ~chars.between(*WORD_LENGTHS),
    }


def host_verdicts(judged: DataFrame) -> DataFrame:
    """host, n_docs, failures by rule, rate, shrunk_rate, host_ok: one row for each host.

    The prior is a beta whose mean and variance are those of the hosts' rates (moments, two numbers
    that come to the driver); its weight is held within PRIOR_WEIGHT."""
    rules = list(failures())
    hosts = (
        judged.groupBy("host")
        .agg(F.count("*").alias("n_docs"), *(F.sum(F.col(r).cast("long")).alias(f"n_{r}") for r in rules), F.sum(F.col("failed").cast("long")).alias("n_failed"))
        .withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    )
    mean, var = hosts.agg(F.avg("rate"), F.var_pop("rate")).first()
    mean, var = mean or 0.0, var or 0.0
    spread = mean * (1 - mean)
    weight = min(max(spread / var - 1 if var > 0 else PRIOR_WEIGHT[1], PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_ok", shrunk <= MAX_HOST_RATE)


def host_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The measures and rule failures of each document, its host's shrunk rate, and ``kept``.

    A document is kept if it fails no rule and its host is not rejected."""
    judged = measure(docs, host).withColumns(failures())
    judged = written(judged.withColumn("failed", F.expr(" or ".join(failures()))), "rules")
    hosts = host_verdicts(judged).select(F.col("host").alias("__host"), "shrunk_rate", "host_ok")
    return (
        judged.join(hosts, F.col("host").eqNullSafe(F.col("__host")))
        .drop("__host")
        .withColumn("base_failed", F.col("fail_words") | F.col("fail_repeat"))
        .withColumn("kept", ~F.col("failed") & F.col("host_ok"))
    )
