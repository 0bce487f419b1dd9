"""Quality rules with risk-controlled thresholds (operator 3).

Every rule is a ratio that is high for junk; a document is rejected when a
ratio exceeds the cutoff of its stratum.  Cutoffs come from a labelled holdout
(documents labelled good): a cutoff is admissible when the exact binomial test
rejects "more than ``alpha`` of the stratum's good documents exceed it" at
level ``delta`` divided by all tests made (strata x rules x cutoffs, Bonferroni),
that is, when the exact upper confidence bound on its false rejections is at
most ``alpha``.  Of the admissible cutoffs of a rule and stratum the one that
catches most labelled junk is taken, where a good document counts ``GOOD_WORTH``
times; a rule without one rejects nothing there.  With probability
``1 - delta``, no rule rejects more than ``alpha`` of any stratum's good
documents, so all together at most ``alpha`` times the number of rules.

Strata are the declared languages and "other", so the table of cutoffs has a
fixed number of rows.  The exact tail ``P(Bin(n, alpha) <= k)`` is summed from
its largest term down; beyond ``TAIL_TERMS`` terms the rest is bounded by its
geometric series from above, which can only make a cutoff inadmissible.

Defined results: a null or blank text has no words and fails the base rules;
ratios of such texts are 0; documents without a label only receive the verdict;
several labels of one document count once, good only if all are; null labels
are no labels; repeated rows are judged alike; a table without ``lang`` is one
stratum; extra columns never clash; an empty table gives an empty result.  Only DataFrame functions run
here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import SPACE_CHARS, stored, words

SYMBOLS = "#*$%&|<>"
#: Share of a stratum's good documents that one rule may reject, and the chance that any bound fails.
ALPHA, DELTA = 0.02, 0.05
#: Junk documents that one good document outweighs when a cutoff is chosen.
GOOD_WORTH = 20
#: Languages that are strata of their own; all others, and null, are one.
STRATA = ("de", "en", "es", "fr")
#: Cutoffs tried for every rule.
CUTOFFS = tuple(i / 50 for i in range(1, 50)) + (1.0, 1.25, 1.5, 2.0)
TAIL_TERMS = 2000
MIN_WORDS = 50

#: Ratio of each rule, from the columns of ``measured``.
RULES = {
    "symbols": "n_symbols / n_words",
    "repeated_words": "n_repeat_words / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
    "shouting": "q_upper / word_chars",
    "exclamations": "q_exclaim / n_words",
    "same_word_again": "q_echo / n_words",
    "few_different_words": "1 - q_distinct / least(n_words, 100)",
}


def _kept_chars(text: Column, drop: str) -> Column:
    return F.char_length(F.translate(text, drop, ""))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and what the rules need; one row per row, no shuffle.

    Steps are separate projections so that arrays used several times are computed once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.withColumns({"q_text": text, "q_words": words(F.col("text"))})
    a = a.withColumns({
        "n_words": F.size("q_words").cast("long"),
        "word_chars": _kept_chars(F.col("q_text"), SPACE_CHARS).cast("long"),
        "n_symbols": (F.char_length("q_text") - _kept_chars(F.col("q_text"), SYMBOLS)).cast("long"),
        "q_exclaim": F.char_length("q_text") - _kept_chars(F.col("q_text"), "!"),
        "q_upper": F.char_length(F.regexp_replace("q_text", r"[^\p{Lu}]+", "")),
        "q_lines": F.filter(F.split("q_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""),
        "q_hashes": F.transform("q_words", lambda w: F.xxhash64(w)),
    })
    a = a.withColumns({
        "n_lines": F.size("q_lines"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_distinct": F.size(F.array_distinct("q_hashes")),
        # A window as one number; n - 2 windows, none for shorter texts.
        "q_windows": F.when(
            F.size("q_hashes") >= 3,
            F.zip_with(
                F.zip_with(F.slice("q_hashes", F.lit(1), F.size("q_hashes") - 2), F.slice("q_hashes", F.lit(2), F.size("q_hashes") - 2),
                           lambda x, y: F.struct(x, y)),
                F.slice("q_hashes", F.lit(3), F.size("q_hashes") - 2), lambda xy, z: F.xxhash64(xy, z)),
        ).otherwise(F.array().cast("array<bigint>")),
    })
    a = a.withColumn("q_repeats", F.size(F.array_distinct("q_windows")) < F.size("q_windows"))
    echo = F.size(F.filter(F.zip_with("q_hashes", F.slice("q_hashes", 2, F.greatest(F.size("q_hashes") - 1, F.lit(0))),
                                      lambda x, y: x == y), lambda s: s))
    a = a.withColumn("q_echo", F.when(F.col("q_distinct") < F.size("q_hashes"), echo).otherwise(F.lit(0)))
    # Only texts with a repeated window sort theirs: equal windows become neighbours.
    order = F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.withColumn("q_sorted", F.when(F.col("q_repeats"), order))
    a = a.withColumn("q_near", F.when(F.col("q_repeats"), F.concat(
        F.array(F.lit(False)),
        F.zip_with(F.slice("q_sorted", F.lit(1), F.size("q_sorted") - 1), F.slice("q_sorted", F.lit(2), F.size("q_sorted") - 1),
                   lambda x, y: x["h"] == y["h"]),
        F.array(F.lit(False)))))
    a = a.withColumn("q_flags", F.when(F.col("q_repeats"), F.zip_with(
        F.slice("q_near", F.lit(1), F.size("q_near") - 1), F.slice("q_near", F.lit(2), F.size("q_near") - 1), lambda x, y: x | y)))
    a = a.withColumn("q_at", F.when(F.col("q_repeats"), F.array_sort(F.transform(
        F.filter(F.zip_with("q_sorted", "q_flags", lambda s, f: F.struct(s["i"].alias("i"), f.alias("f"))), lambda s: s["f"]),
        lambda s: s["i"]))))
    # Words under the windows at these positions: each adds three, less what the one before it already covers.
    covered = F.aggregate(
        F.zip_with(F.slice("q_at", F.lit(2), F.size("q_at") - 1), F.slice("q_at", F.lit(1), F.size("q_at") - 1), lambda x, y: x - y),
        F.lit(3), lambda n, gap: n + F.least(gap, F.lit(3)))
    a = a.withColumn("n_repeat_words", F.when(F.col("q_repeats"), covered).otherwise(F.lit(0)).cast("long"))
    ratios = F.array(*[
        F.coalesce(F.expr(f"case when n_words > 0 then {r} end"), F.lit(0.0)).cast("double") for r in RULES.values()])
    a = a.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "q_ratios": ratios, "q_stratum": stratum()})
    return a.drop(*[c for c in a.columns if c.startswith("q_") and c not in ("q_ratios", "q_stratum")], "n_lines")


def stratum() -> Column:
    """Position of the language in ``STRATA``; all others and null are one stratum."""
    out = F.lit(len(STRATA))
    for i, s in enumerate(STRATA):
        out = F.when(F.col("lang") == s, F.lit(i)).otherwise(out)
    return out


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly or a little more; 1 where k is at least the mean."""
    q = 1.0 - p
    def log_factorial(x: Column) -> Column:
        # Exact sums for small numbers, Stirling's series (error below 1e-13) above.
        x = x.cast("double")
        exact = F.aggregate(F.sequence(F.lit(1), F.least(x, F.lit(16.0)).cast("int") + 1), F.lit(0.0),
                            lambda s, i: s + F.when(i <= x, F.log(i.cast("double"))).otherwise(0.0))
        z = F.greatest(x, F.lit(16.0)) + 1
        series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
        return F.when(x <= 16, exact).otherwise(series)
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(q)))
    down = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(TAIL_TERMS)).cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["term"] * (k - j) / (n - k + j + 1) * (q / p)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")))
    ratio = (k - TAIL_TERMS) / (n - k + TAIL_TERMS + 1) * (q / p)
    rest = F.when(k > TAIL_TERMS, down["term"] / (1 - ratio)).otherwise(0.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * (down["sum"] + rest)))


def cutoffs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row (c_stratum, c_cutoffs) per stratum: the chosen admissible cutoff per rule, infinity where none is.

    ``holdout``: (q_stratum, q_ratios, good) of labelled documents."""
    tests = (len(STRATA) + 1) * len(RULES) * len(CUTOFFS)
    grid = F.array(*[F.lit(float(c)) for c in CUTOFFS])
    # Number of cutoffs that a ratio exceeds: 0 .. all of them.
    level = F.size(F.filter(grid, lambda c: F.col("ratio") > c))
    n_good, n_bad = F.count_if(F.col("good")), F.count_if(~F.col("good"))
    bins = (
        holdout.select("q_stratum", "good", F.posexplode("q_ratios").alias("rule", "ratio"))
        .groupBy("q_stratum", "rule", level.alias("level")).agg(n_good.alias("good"), n_bad.alias("bad"))
        .groupBy("q_stratum", "rule")
        .agg(F.sum("good").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", F.struct("good", "bad")))).alias("at"))
    )
    # At most strata x rules x (cutoffs + 1) rows from here on.
    tried = bins.select("q_stratum", "rule", "n", "at", F.posexplode(grid).alias("i", "cutoff"))

    def beyond(part: str) -> Column:
        return F.aggregate(F.sequence(F.col("i") + 1, F.lit(len(CUTOFFS))), F.lit(0).cast("long"),
                           lambda s, j: s + F.coalesce(F.element_at("at", j)[part], F.lit(0)))

    tried = tried.withColumns({"k": beyond("good"), "caught": beyond("bad")})
    tried = tried.withColumn("worth", F.col("caught") - GOOD_WORTH * F.col("k"))
    admissible = tried.where((F.col("worth") > 0) & (binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / tests))
    # Of equally good cutoffs the middle: fewer good documents exceed it than the lowest of them, which is admissible.
    best = (
        admissible.groupBy("q_stratum", "rule", "worth").agg(((F.min("cutoff") + F.max("cutoff")) / 2).alias("cutoff"))
        .groupBy("q_stratum", "rule").agg(F.max_by("cutoff", "worth").alias("cutoff"))
    )
    per_rule = [
        F.coalesce(F.min(F.when(F.col("rule") == i, F.col("cutoff"))), F.lit(float("inf"))) for i in range(len(RULES))]
    return best.groupBy(F.col("q_stratum").alias("c_stratum")).agg(F.array(*per_rule).alias("c_cutoffs"))


def _sql() -> str:
    grid = ", ".join(f"{c!r}::DOUBLE" for c in CUTOFFS)
    rules = ", ".join(f"coalesce(CASE WHEN n_words > 0 THEN {r} END, 0.0)::DOUBLE" for r in RULES.values()).replace(
        "q_", "f_").replace(" / ", "::DOUBLE / ")
    strata = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STRATA))
    tests = (len(STRATA) + 1) * len(RULES) * len(CUTOFFS)
    log_pmf = f"lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})"
    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, CASE lang {strata} ELSE {len(STRATA)} END AS stratum FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM worded WHERE len(w) >= 3),
times AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
under AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM times WHERE n > 1) GROUP BY doc_id),
counted AS (SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(u.n, 0) AS n_repeat_words,
    length(t) - length(replace(t, '!', '')) AS f_exclaim, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS f_upper,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS f_echo, len(list_distinct(w)) AS f_distinct
  FROM worded LEFT JOIN under u USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{rules}] AS ratios FROM counted),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
holdout AS (SELECT stratum, good, unnest(range(1, {len(RULES)} + 1)) AS rule, unnest(ratios) AS ratio
            FROM judged JOIN known USING (doc_id) WHERE NOT base_failed),
tried AS (SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND ratio > cutoff) AS k,
            count(*) FILTER (NOT good AND ratio > cutoff) AS caught
          FROM holdout CROSS JOIN (SELECT unnest([{grid}]) AS cutoff) GROUP BY stratum, rule, cutoff),
admissible AS (SELECT *, caught - {GOOD_WORTH} * k AS worth FROM tried WHERE caught - {GOOD_WORTH} * k > 0 AND k < {ALPHA} * n
               AND list_sum(list_transform(range(k + 1), lambda i: exp({log_pmf}))) <= {DELTA / tests!r}),
best AS (SELECT stratum, rule, arg_max(cutoff, worth) AS cutoff FROM (
           SELECT stratum, rule, worth, (min(cutoff) + max(cutoff)) / 2 AS cutoff FROM admissible GROUP BY stratum, rule, worth)
         GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM best b WHERE b.stratum = j.stratum AND j.ratios[b.rule] > b.cutoff) AS kept
FROM judged j
"""


#: The same on one machine; documents with ids of their own only.
SQL = _sql()


def holdout_cutoffs(measures: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The cutoffs learnt from the labelled documents; ``measures`` is narrow, no text is shuffled."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("l_id")).agg((F.min("quality") == 1).alias("good"))
    )
    narrow = measures.where(~F.col("base_failed")).select("doc_id", "q_stratum", "q_ratios")
    return cutoffs(narrow.join(known, F.col("doc_id") == F.col("l_id")), alpha, delta)


def with_verdict(measures: DataFrame, table: DataFrame) -> DataFrame:
    """``measures`` with ``kept``; ``table`` has one row per stratum, so it is broadcast."""
    over = F.exists(F.zip_with("q_ratios", "c_cutoffs", lambda r, c: r > c), lambda x: x)
    return (
        measures.join(F.broadcast(table), F.col("q_stratum") == F.col("c_stratum"), "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False)))
        .drop("q_ratios", "q_stratum", "c_stratum", "c_cutoffs")
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _rows(docs: DataFrame) -> DataFrame:
    """The caller's row as one column beside the inputs, so that no name can clash."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "doc_id", "text", lang.alias("lang"))


def _narrow(docs: DataFrame) -> DataFrame:
    return measured(_rows(docs).drop("row")).select("doc_id", *COUNTS, "base_failed", "q_stratum", "q_ratios")


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept) of every row of ``docs`` (doc_id, text, lang)."""
    measures = stored(_narrow(docs), "quality-measures")
    return with_verdict(measures, holdout_cutoffs(measures, labels, alpha, delta))


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    The measures are stored beside the rows: they are needed twice, and a filter on them must not be pushed
    below the projections that compute them step by step."""
    measures = stored(measured(_rows(docs)).drop("text", "lang"), "quality-rows")
    return with_verdict(measures, holdout_cutoffs(measures, labels, alpha, delta)).where("kept").select("row.*")
