"""Quality rules with risk-controlled cutoffs, in DataFrame expressions only.

A rule rejects a document when a measure (an integer) is above a cutoff. Cutoffs are not set by hand: a labelled holdout
of good documents says how many of them a cutoff would reject, and an exact binomial test says whether the true share
is proven to be at most ``risk``. Per stratum and rule the strictest proven cutoff is used; where none is proven, the
rule rejects nothing there. The tests of all strata, rules and cutoffs share ``doubt`` by Bonferroni's correction, so
with probability ``1 - doubt`` no rule rejects more than ``risk`` of the good documents of any stratum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.llm.tables import text_of, word_list, written

#: Measures that rules cut, as integers so that every engine rounds alike.
MEASURES: dict[str, str] = {
    "symbols": "n_symbols * 1000 div greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "word_size": "word_chars * 10 div greatest(n_words, 1)",
}
#: Candidate cutoffs, from strict to loose. A rule rejects what is above.
CUTOFFS: dict[str, Sequence[int]] = {
    "symbols": (1, 2, 5, 10, 20, 50, 100, 200, 400),
    "dup_lines": (1, 20, 50, 100, 200, 300, 500),
    "repeats": (1, 20, 50, 100, 200, 300),
    "word_size": (60, 70, 80, 100, 120, 150, 200),
}
LISTED = 1 << 16  # strata whose cutoffs are broadcast at most
WINDOW = 8
MIN_WORDS = 20


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The id, the columns ``keep`` and the counts of each text; one row per input row.

    A null text is empty: all counts are 0. Windows are compared by 64-bit hashes of their words within one text.
    """
    text = text_of(text_col)
    hashes = F.transform(F.col("_w"), lambda w: F.xxhash64(w))
    step = docs.select(
        id_col, *keep, word_list(text).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    step = step.select(
        id_col, *keep, "n_symbols", F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), hashes.alias("_h"),
    )
    window = F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))
    step = step.withColumn("_h", F.when(F.size("_h") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    # Most texts repeat nothing: only the others sort their windows.
    order = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn("_h", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), order).otherwise(none))
    twice = F.filter("_h", lambda x, j: (x["h"] == F.get("_h", j - 1)["h"]) | (x["h"] == F.get("_h", j + 1)["h"]))
    twice = F.when(F.size("_h") > 0, F.array_sort(F.transform(twice, lambda x: x["i"]))).otherwise(F.array().cast("array<int>"))
    step = step.withColumn("_h", twice)
    covered = F.aggregate(
        F.transform("_h", lambda p, j: F.least(F.coalesce(F.get("_h", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    return step.withColumn("n_repeat_words", covered).drop("_h")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most ``k`` of ``n``) at probability ``p`` each, by summing the terms in logarithms."""
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("total"))
    odds = F.log(F.lit(p / (1 - p)))

    def add(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((n - j + 1) / j) + odds
        high = F.greatest(state["total"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(state["total"] - high) + F.exp(term - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda s: F.exp(s["total"]))


def proven_cutoffs(
    good: DataFrame, stratum: str, risk: float, doubt: float, cutoffs: Mapping[str, Sequence[int]] = CUTOFFS
) -> DataFrame:
    """One row per stratum: ``stratum`` and a column per rule, the strictest proven cutoff or null.

    ``good`` holds the counts of labelled good documents. Without any, the result is empty. All strata are tested, and all
    tests count in the correction.
    """
    measured = good.select(F.col(stratum).alias("stratum"), *[F.expr(MEASURES[r]).alias(r) for r in cutoffs])
    above = [F.count_if(F.col(r) > c).alias(f"{r}_{c}") for r in cutoffs for c in cutoffs[r]]
    counts = measured.groupBy("stratum").agg(F.count("*").alias("n"), *above)
    counts = written(counts, "strata")
    tests = max(counts.count(), 1) * sum(len(x) for x in cutoffs.values())
    counts = counts.withColumn("level", F.lit(doubt) / F.lit(tests))

    def proven(rule: str, cutoff: int) -> Column:
        k = F.col(f"{rule}_{cutoff}")
        return F.when(k < F.col("n") * risk, F.when(binomial_tail(k, F.col("n"), risk) <= F.col("level"), F.lit(cutoff)))

    return counts.select("stratum", *[F.coalesce(*[proven(r, c) for c in sorted(cutoffs[r])]).alias(r) for r in cutoffs])


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_col: str = "quality", risk: float = 0.005, doubt: float = 0.05,
) -> DataFrame:
    """One row per input row: the id, the counts of its text, ``base_failed``, ``rules`` (those that reject) and ``kept``.

    The holdout is every labelled document whose labels are all 1 and that passes the base rules; a null stratum is one
    of its own. An id that occurs more than once counts with each of its rows. Without labels only the base rules hold.
    A very long text is one array of its words; an empty table gives no rows; columns other than the three are not read.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum")
    counted = written(features(docs.select(id_col, text_col, stratum), id_col, text_col, ["stratum"]), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    counted = counted.withColumn("base_failed", failed)
    marks = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.coalesce(label_col, F.lit(0))).alias("_good")).filter("_good = 1")
    good = counted.filter(~F.col("base_failed")).join(marks, counted[id_col] == marks["_id"], "left_semi")
    cutoffs = proven_cutoffs(good, "stratum", risk, doubt)
    limits = cutoffs.select("stratum", *[F.col(r).alias(f"_{r}") for r in MEASURES])
    rejects = F.array_compact(F.array(*[F.when(F.expr(MEASURES[r]) > F.col(f"_{r}"), F.lit(r)) for r in MEASURES]))
    limits = written(limits, "cutoffs")
    limits = F.broadcast(limits) if limits.count() <= LISTED else limits
    out = counted.join(limits, "stratum", "left").withColumn("rules", rejects)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0)).drop("stratum", *[f"_{r}" for r in MEASURES])
