"""Risk-controlled quality rules (DataFrame functions only).

A rule rejects a document whose rate lies above the rule's cutoff. Labels are dealt by doc_id into a proposing part
and a holdout. In every stratum (language) each level of ``LEVELS`` proposes a cutoff per rule: that quantile of the rule's rate among the
good documents of the proposing part. On the good documents of the holdout a level's rules, taken together, pass if the exact binomial
tail P(Bin(n, alpha) <= k) of their k false rejections among n is at most delta / (strata x levels) (Bonferroni's
correction over strata and candidates). So with probability 1 - delta no stratum loses more than the fraction alpha of its good documents,
whichever of the levels that passed is chosen. Chosen is the one with the largest share of the holdout's bad documents rejected
less the share of its good ones, of equals the most lenient; if that is not above 0, or no level passes (too few labels), no
document is rejected.

Edge cases: null text has no words and fails the base rule; null language is a stratum of its own;
a document labelled more than once is good if any label says so; labels without a document and
documents without a doc_id count for nothing in the calibration; an empty table gives an empty
result. Repeated rows are judged one by one. Windows of words are told apart by 64-bit hashes. Extra columns, whatever their
names, pass through ``apply_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, facts, keys_of_rows, let, staged, text_or_empty, unused, words_of

#: Levels, lenient to strict: quantiles of the rates of good documents.
LEVELS = (1.0, 0.998, 0.995, 0.99, 0.985, 0.98)
#: One part in so many of the labels proposes, the others are the holdout.
PROPOSING = 4
RATES = ("symbol_rate", "capital_rate", "line_rate", "window_rate")
SYMBOLS = "#*$%&|<>"
NO_LANGUAGE = "(none)"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more; windows are told apart by 64-bit hashes."""
    windows = F.slice(
        F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i"))),
        1,
        F.greatest(F.size(words) - 2, F.lit(0)),
    )

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: F.get(s, j - 1)["g"].eqNullSafe(e["g"]) | F.get(s, j + 1)["g"].eqNullSafe(e["g"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    return let(F.sort_array(windows), covered)


def measures(text: Column) -> Column:
    """A struct of the counts of the contract and of what the rates need besides."""

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE + "+", "") != "")
        line_counts = let(lines, lambda v: F.struct(F.size(v).alias("n"), (F.size(v) - F.size(F.array_distinct(v))).alias("dup")))
        plain = F.translate(text, SYMBOLS, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            (F.length(text) - F.length(plain)).cast("long").alias("n_symbols"),
            line_counts["dup"].cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            line_counts["n"].cast("long").alias("n_lines"),
            F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        )

    return let(words_of(text), of_words)


def with_measures(docs: DataFrame, text: str = "text", into: str = "_m") -> DataFrame:
    return docs.withColumn(into, measures(text_or_empty(text)))


def rates(m: Column) -> list[Column]:
    def share(part: str, whole: str) -> Column:
        return m[part] / F.greatest(m[whole], F.lit(1))

    return [share("n_symbols", "word_chars"), share("n_capitals", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to rounding: terms by recurrence, summed in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    step = lambda acc, i: let(
        acc["term"] + F.log((n - i + 1) / i) + odds,
        lambda t: F.struct(t.alias("term"), (F.greatest(acc["sum"], t) + F.log1p(F.exp(-F.abs(acc["sum"] - t)))).alias("sum")),
    )
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("term"), first.alias("sum")), step, lambda acc: F.exp(acc["sum"]))
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(summed)


def certify(judged: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Staged, per stratum with a chosen level: level (index in ``LEVELS``, from 1) and its cutoffs. ``judged``: doc_id, stratum, rates."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = judged.join(keys_of_rows(known), "doc_id").where("quality is not null").withColumn("good", F.col("quality") == 1)
    held = staged(held.select("stratum", "rates", "good", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("part")), "quality-held")
    # Rates on a grid: an exact quantile holds a bounded number of distinct values.
    grid = [F.ceil(F.get("rates", i) * 4096) / 4096 for i in range(len(RATES))]
    levels = [float(q) for q in LEVELS]
    proposing = F.col("part") % PROPOSING == 0
    proposed = held.where(proposing & F.col("good")).groupBy("stratum").agg(*[F.percentile(g, levels).alias(r) for g, r in zip(grid, RATES, strict=True)])
    proposed = proposed.select("stratum", F.posexplode(F.arrays_zip(*RATES)).alias("level", "cut"))
    proposed = staged(proposed.select("stratum", (F.col("level") + 1).alias("level"), F.array(*[F.col("cut")[r] for r in RATES]).alias("cutoffs")), "quality-proposed")
    tested = held.where(~proposing).join(facts(proposed), "stratum").withColumn("hit", rejected(F.col("rates"), F.col("cutoffs")))
    counted = tested.groupBy("stratum", "level").agg(
        F.first("cutoffs").alias("cutoffs"), F.count_if("good").alias("n"), F.count_if(F.col("good") & F.col("hit")).alias("k"),
        F.count_if(~F.col("good")).alias("bad"), F.count_if(~F.col("good") & F.col("hit")).alias("caught"),
    )
    counted = staged(counted, "quality-tested")
    candidates = max(counted.count(), 1)
    gain = F.col("caught") / F.greatest("bad", F.lit(1)) - F.col("k") / F.greatest("n", F.lit(1))
    passed = counted.where((binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / candidates) & (gain > 0))
    best = passed.groupBy("stratum").agg(F.min_by(F.struct("level", "cutoffs"), F.struct(-gain, "level")).alias("b"))
    return staged(best.select("stratum", "b.level", "b.cutoffs"), "quality-levels")


def rejected(rates: Column, cutoffs: Column) -> Column:
    """Whether a rate lies above its cutoff; no cutoffs reject nothing."""
    return F.coalesce(F.exists(F.zip_with(rates, cutoffs, lambda r, c: r > c), lambda x: x), F.lit(False))


def stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit(NO_LANGUAGE))


def quality_report(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per document: counts, stratum, chosen level, verdict. The text is read once; what follows is narrow."""
    m = F.col("_m")
    narrow = with_measures(docs.select("doc_id", "text", stratum().alias("stratum")))
    narrow = narrow.select("doc_id", "stratum", *[m[c].alias(c) for c in MEASURES], F.array(*rates(m)).alias("rates"), base_failed(m).alias("base_failed"))
    narrow = staged(narrow, "quality")
    levels = certify(narrow, labels, alpha, delta)
    return narrow.join(facts(levels), "stratum", "left").select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~rejected(F.col("rates"), F.col("cutoffs"))).alias("kept"),
        "stratum", F.coalesce("level", F.lit(0)).alias("level"),
    )


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents that pass, all columns kept. Texts are measured once and staged with their rates; none is shuffled."""
    mark, of, cut = (unused(docs, n) for n in ("judged", "judged_s", "judged_c"))
    rows = with_measures(docs, into=mark)
    verdict = F.struct(F.array(*rates(F.col(mark))).alias("rates"), base_failed(F.col(mark)).alias("base"), stratum().alias("stratum"))
    rows = staged(rows.withColumn(mark, verdict), "quality-docs")
    judged = rows.select("doc_id", f"{mark}.rates", f"{mark}.stratum")
    levels = certify(judged, labels, alpha, delta)
    levels = levels.select(F.col("stratum").alias(of), F.col("cutoffs").alias(cut))
    joined = rows.join(facts(levels), F.col(f"{mark}.stratum") == F.col(of), "left")
    return joined.where(~F.col(f"{mark}.base") & ~rejected(F.col(f"{mark}.rates"), F.col(cut))).select(docs.columns)
