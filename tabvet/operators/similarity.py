"""Fuzzy candidates and recommendations.

Exact Ratcliff-Obershelp ratios are computed only for pairs that two indexes
find.  A ratio of ``cut`` needs ``2 * |chars(a) & chars(b)| >= cut * (la + lb)``
over multisets of characters, so with the set of a text's (character, how often
so far) tokens, sorted by rarity, two such texts share a token of their prefixes
and have lengths within a fixed factor: pairs meet by token and length class, at
the first token that they share.  Containment is found by the rarer text's
rarest q-gram.  Pairs that share nothing never meet.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet import fixed_values as FV
from tabvet.functions.semantics import nfc
from tabvet.session import checkpoint


def sim_key(c: Column) -> Column:
    """Similarity normalisation: NFC, lower-case, whitespace removed (no cut)."""
    return F.regexp_replace(F.lower(nfc(c)), r"\s+", "")


def confidence_band(score: Column) -> Column:
    """High >= 0.82, medium >= 0.65, else low."""
    return (F.when(score >= FV.CONFIDENCE_HIGH, F.lit("high"))
            .when(score >= FV.CONFIDENCE_MEDIUM, F.lit("medium")).otherwise(F.lit("low")))


#: Characters of the grams by which contained texts are found; shorter texts are one gram.
GRAM = 3
#: Room for rounding in the bounds; the exact ratio decides.
_SLACK = 1e-9


def _char_tokens(key: str) -> Column:
    """Each character with its number among the equal ones: equal tokens of two texts count their common characters.

    In the JVM: whole batches of tokens in Python take memory by the length of the keys."""
    c = F.col(key)
    times = lambda ch: F.length(c) - F.length(F.replace(c, ch, F.lit("")))
    each = F.transform(F.array_distinct(F.split(c, "")), lambda ch: F.transform(
        F.sequence(F.lit(1), times(ch)), lambda k: F.concat(ch, k.cast("string"))))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.flatten(each))


def _with_tokens(keys: DataFrame, frequency: DataFrame) -> DataFrame:
    """(key, n, tokens): tokens rarest first."""
    rows = keys.select("key", F.explode(_char_tokens("key")).alias("token")).join(frequency, "token")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frequency", "token"))), lambda t: t["token"])
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), ordered.alias("tokens"))


def _prefixed(rows: DataFrame, cut: float) -> DataFrame:
    """With the prefix that must hold a common token of any text in reach, and the length class."""
    shared = F.ceil(F.col("n") * F.lit(cut / (2 - cut)) - _SLACK)
    return rows.withColumns({"prefix": F.slice("tokens", 1, (F.col("n") - shared + 1).cast("int")), "size_class": F.floor(F.log2("n")).cast("int")})


def similar_keys(terms: DataFrame, candidates: DataFrame, cut: float) -> DataFrame:
    """(tk, ck): all pairs of the keys (key) of both sides whose common characters allow a ratio of ``cut``."""
    both = terms.select("key").unionByName(candidates.select("key")).distinct()
    frequency = both.select(F.explode(_char_tokens("key")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))
    t = checkpoint(_prefixed(_with_tokens(terms, frequency), cut)).alias("t")
    c = checkpoint(_prefixed(_with_tokens(candidates, frequency), cut)).alias("c")
    # Lengths differ by a factor of (2 - cut) / cut at most, which spans so many classes.
    reach = 0
    while 2 ** reach < (2 - cut) / cut:
        reach += 1
    classes = F.sequence(F.col("size_class") - reach, F.col("size_class") + reach)
    probe = t.withColumn("size_class", F.explode(classes)).withColumn("token", F.explode("prefix")).alias("t")
    listed = c.withColumn("token", F.explode("prefix")).alias("c")
    enough = lambda common: 2 * common >= cut * (F.col("t.n") + F.col("c.n")) - _SLACK
    found = probe.join(
        listed,
        (F.col("t.token") == F.col("c.token")) & (F.col("t.size_class") == F.col("c.size_class"))
        & enough(F.least("t.n", "c.n")) & (F.array_intersect("t.prefix", "c.prefix")[0] == F.col("t.token"))
        & enough(F.size(F.array_intersect("t.tokens", "c.tokens"))))
    return found.select(F.col("t.key").alias("tk"), F.col("c.key").alias("ck"))


def contained_keys(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(needle, haystack): all pairs of keys (key) where the first stands inside the second."""
    def grams(size: int):
        return F.transform(F.sequence(F.lit(1), F.length("key") - size + 1), lambda i: F.substring("key", i, F.lit(size)))
    every = [F.when(F.length("key") >= q, grams(q)).otherwise(F.array().cast("array<string>")) for q in range(1, GRAM + 1)]
    index = haystacks.select("key", F.explode(F.array_distinct(F.concat(*every))).alias("gram"))
    frequency = index.groupBy("gram").agg(F.count(F.lit(1)).alias("frequency"))
    own = F.when(F.length("key") >= GRAM, grams(GRAM)).otherwise(F.array("key"))
    wanted = needles.select("key", F.explode(F.array_distinct(own)).alias("gram")).join(frequency, "gram", "left")
    # The rarest gram; a needle with a gram that no text has is in none.
    rarest = wanted.groupBy("key").agg(
        F.min_by("gram", F.struct("frequency", "gram")).alias("gram"), F.count_if(F.col("frequency").isNull()).alias("missing"))
    rarest = rarest.where("missing = 0").select(F.col("key").alias("needle"), "gram")
    return rarest.join(index.withColumnRenamed("key", "haystack"), "gram").where(F.col("haystack").contains(F.col("needle"))).select("needle", "haystack")


def candidate_pairs(terms: DataFrame, catalog: DataFrame, cut: float = FV.SIMILARITY_CUT) -> DataFrame:
    """(tk, ck, contained): the pairs of normalised keys that the indexes find; ``terms`` (tk), ``catalog`` (ck, floor_rule)."""
    t = checkpoint(terms.select(F.col("tk").alias("key")).distinct())
    c = catalog.select(F.col("ck").alias("key")).distinct()
    live = catalog.where("floor_rule = 'contain'").select(F.col("ck").alias("key")).distinct()
    inside = (
        contained_keys(t, live).select(F.col("needle").alias("tk"), F.col("haystack").alias("ck"))
        .unionByName(contained_keys(live, t).select(F.col("haystack").alias("tk"), F.col("needle").alias("ck"))).withColumn("contained", F.lit(True))
    )
    return similar_keys(t, c, cut).withColumn("contained", F.lit(False)).unionByName(inside).groupBy("tk", "ck").agg(
        F.max("contained").alias("contained"))


def _ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(ratio=[difflib.SequenceMatcher(None, t, c).ratio() for t, c in zip(b["tk"], b["ck"], strict=True)])


def keyed(terms: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their normalised keys; blank texts have nothing to compare and are left out."""
    t = terms.select("term").distinct().withColumn("tk", sim_key(F.col("term"))).where("tk <> ''")
    text = F.col("match_text") if "match_text" in catalog.columns else F.col("candidate")
    return t, catalog.withColumn("ck", sim_key(text)).where("ck <> ''")


def scored_candidates(terms: DataFrame, catalog: DataFrame, cut: float = FV.SIMILARITY_CUT) -> DataFrame:
    """One (term, kind, target_table, column_name, candidate, score) row per identity that reaches ``cut``.

    ``terms``: (term). ``catalog``: (kind, target_table, column_name, candidate,
    floor_rule[, match_text]): ``match_text`` is what terms are compared with (an
    alias), by default the candidate; floor_rule is NULL, 'contain' (live column:
    containment floors the score at 0.82) or 'alias' (a qualifying score floors at
    0.7).  An identity with several rows keeps its best score."""
    t, c = (checkpoint(x) for x in keyed(terms, catalog))
    pairs = candidate_pairs(t, c, cut).mapInPandas(_ratios, "tk string, ck string, contained boolean, ratio double")
    floor = F.when((F.col("floor_rule") == "contain") & F.col("contained"), F.greatest("ratio", F.lit(FV.CONTAINMENT_FLOOR))).otherwise(F.col("ratio"))
    scored = t.join(pairs, "tk").join(c, "ck").withColumn("score", floor).where(F.col("score") >= cut)
    alias = F.when(F.col("floor_rule") == "alias", F.greatest("score", F.lit(FV.ALIAS_FLOOR))).otherwise(F.col("score"))
    return scored.groupBy("term", "kind", "target_table", "column_name", "candidate").agg(F.max(F.round(alias, 3)).alias("score"))


def top_recommendations(scored: DataFrame, top: int = FV.TOP_RECOMMENDATIONS) -> DataFrame:
    """The best ``top`` per term and kind, ranked; equal scores by candidate, table and column."""
    w = Window.partitionBy("term", "kind").orderBy(F.col("score").desc(), "candidate", "target_table", "column_name")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def similarity_candidates(terms: DataFrame, catalog: DataFrame, cut: float = FV.SIMILARITY_CUT,
                          top: int = FV.TOP_RECOMMENDATIONS) -> DataFrame:
    """C4: per term the best ``top`` candidates per kind with a score of ``cut`` or more (see ``scored_candidates``)."""
    return top_recommendations(scored_candidates(terms, catalog, cut), top)


def recommendations(candidates: DataFrame) -> DataFrame:
    """Candidates as recommendations with their confidence; a person decides, so the action is a new preview."""
    return candidates.withColumnRenamed("candidate", "recommended_term").withColumns(
        {"confidence": confidence_band(F.col("score")), "action": F.lit("rerun_preview")})


def best_recommendation(scored: DataFrame) -> DataFrame:
    """(term, recommended): the best candidate of a term over all kinds; equal scores by candidate."""
    best = F.min_by("candidate", F.struct(-F.col("score"), "candidate"))
    return scored.groupBy("term").agg(best.alias("recommended"))
