"""Join-shaped operators.

Dictionaries (aliases, channels, policies, rules) are small, bounded
configuration tables and may be broadcast; data-side inputs are broadcast
only by the engine, from their real size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.session import materialize


def _compact_lower(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def resolve_condition_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """each requested value -> the live value equal after whitespace removal
    and lower-casing (smallest such value when several qualify).

    The distinct live values are shuffled once; the result has at most
    ``len(values)`` rows, so it is safe to broadcast back onto the fact side.
    """
    spark = df.sparkSession
    wanted = spark.createDataFrame([(v,) for v in values], "wanted string").withColumn("k", _compact_lower(F.col("wanted")))
    live = df.select(F.col(column).alias("live")).where(F.col("live").isNotNull()).distinct().withColumn("k", _compact_lower(F.col("live")))
    return (
        live.join(F.broadcast(wanted), "k")
        .groupBy("wanted")
        .agg(F.min("live").alias(column))
    )


def field_mapping_join(cells: DataFrame, mapping: DataFrame, standard: DataFrame, header_col: str = "source_field") -> DataFrame:
    """Source header -> standard field (mapping and field both active).
    Mapping and standard-field tables are bounded dictionaries: broadcast."""
    m = mapping.where(F.col("active")).select("source_field", "field_code")
    s = standard.where(F.col("active")).select("field_code")
    return cells.join(F.broadcast(m), cells[header_col] == m.source_field).drop(m.source_field).join(F.broadcast(s), "field_code")


def hash_key(*parts: Column) -> Column:
    """Surrogate key: SHA-256 of the compact JSON array of the natural key."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def dim_lookup(facts: DataFrame, dim: DataFrame, natural_key: Sequence[str], surrogate: str, out_col: str) -> DataFrame:
    """Fact row -> surrogate id by natural key (the key's parts include the code,
    as two codes under one name are two members). NULL when the fact lacks the
    attributes: a fact whose key is NULL takes no part in the join, so no task
    gathers them. A key listed twice has the smallest id."""
    keys = list(natural_key)
    d = dim.groupBy(*keys).agg(F.min(surrogate).alias(out_col))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    without = facts.where(~known).withColumn(out_col, F.lit(None).cast(dim.schema[surrogate].dataType))
    return facts.where(known).join(d, keys, "left").unionByName(without)


#: A key with more than this share of the rows is joined by broadcast; there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.0001


def join_counted(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """``rows`` left-joined to ``keyed`` (one row per key, ``count`` = how many of ``rows`` have it).

    The rows of a frequent key stay where they are and meet a broadcast of the frequent
    keys, which are at most ``1 / HEAVY_SHARE``; the others are shuffled."""
    total = keyed.agg(F.sum(count)).first()[0] or 0
    heavy = keyed.where(F.col(count) > total * HEAVY_SHARE)
    marks = F.broadcast(heavy.select(*keys, F.lit(True).alias("_heavy")))
    marked = rows.join(marks, list(keys), "left")
    return (
        marked.where("_heavy").drop("_heavy").join(F.broadcast(heavy), list(keys))
        .unionByName(marked.where("_heavy IS NULL").drop("_heavy").join(keyed.where(F.col(count) <= total * HEAVY_SHARE), list(keys), "left")))


def _common_first(sets: DataFrame, frequency: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(customer, *keep, path): the signatures of each row, the most frequent one of the customer first; unknown ones last."""
    single = sets.select("customer", *keep, F.explode("signatures").alias("sig"))
    counted = frequency.join(single.groupBy("customer", "sig").agg(F.count(F.lit(1)).alias("here")), ["customer", "sig"], "right")
    ranked = join_counted(single, counted, ["customer", "sig"], "here")
    return ranked.groupBy("customer", *keep).agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.coalesce("freq", F.lit(0))).alias("o"), "sig"))), lambda x: x["sig"]).alias("path"))


def rule_tree(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules' signature sets as a tree per customer: (frequency of signatures, nodes).

    Along a path the most frequent signature stands first, so a signature that all
    rules share is one node, however many rules there are. A node is the set of
    signatures down to it; it has the least rule below it. ``sig`` is its last (rarest)
    signature and ``second`` one that stands above it, as a key to reach it by;
    ``above`` holds the others. Nodes for sets of one or two signatures only
    (``above`` NULL) are kept once per (sig, second).
    """
    sets = materialize(
        rules.where(F.col("customer").isNotNull()).select("customer", "rule_id", F.array_sort(F.array_distinct(F.array_compact("signatures"))).alias("signatures"))
        .groupBy("customer", "signatures").agg(F.min("rule_id").alias("rule_id")), "rule-sets")
    frequency = materialize(
        sets.select("customer", F.explode("signatures").alias("sig")).groupBy("customer", "sig").agg(F.count(F.lit(1)).alias("freq")), "rule-freq")
    paths = _common_first(sets.select("customer", "rule_id", F.col("signatures").alias("own"), "signatures"), frequency, ["rule_id", "own"])
    steps = paths.select("customer", "rule_id", "path", F.posexplode("path").alias("at", "sig"))
    above = steps.select("customer", "rule_id", "sig", F.expr("slice(path, 1, at)").alias("above"))
    prefix = above.groupBy("customer", "sig", "above").agg(F.min("rule_id").alias("rule_id"))
    pairs = prefix.select("customer", "sig", F.explode("above").alias("second"), "above", "rule_id")
    nothing = F.lit(None).cast("array<string>")
    nodes = (
        prefix.groupBy("customer", "sig").agg(F.min("rule_id").alias("rule_id"))
        .select("customer", "sig", F.lit(None).cast("string").alias("second"), nothing.alias("above"), "rule_id")
        .unionByName(pairs.groupBy("customer", "sig", "second").agg(F.min("rule_id").alias("rule_id")).withColumn("above", nothing))
        .unionByName(pairs.where(F.size("above") > 1)))
    return frequency, materialize(nodes, "rule-nodes")


def rule_subset_match(requests: DataFrame, rules: DataFrame, req_key: Sequence[str]) -> DataFrame:
    """First (lowest rule_id) active, approved rule of the same customer whose
    condition signatures contain all expected ones; an empty expected set
    matches every rule.

    Equal questions are asked once, in the tree of ``rule_tree``: a question meets the
    nodes that end in its rarest signature and have its second rarest above, so of
    one or two signatures exactly one node, and of more only those whose remaining
    signatures are then compared. Rules that share a frequent signature are never
    paired with the requests that expect it.

    Defined results: NULL elements of either set are ignored; a NULL expected set, a
    NULL customer and a signature that no rule has match nothing; a rule with NULL
    signatures matches empty questions only; repeated keys of requests keep their rows.
    """
    active = rules.where(F.col("active") & (F.col("validation_status") == "approved"))
    frequency, nodes = rule_tree(active)
    known = F.col("customer").isNotNull() & F.col("expected").isNotNull()
    asked = requests.where(known).select(*req_key, F.col("customer").alias("_customer"), F.array_sort(F.array_distinct(F.array_compact("expected"))).alias("_set"))
    questions = materialize(
        asked.groupBy(F.col("_customer").alias("customer"), F.col("_set").alias("signatures")).agg(F.count(F.lit(1)).alias("asked")), "rule-questions")
    sets = questions.where(F.size("signatures") > 0).withColumn("question", F.col("signatures"))
    ordered = _common_first(sets, frequency, ["question"]).select(
        "customer", "question", F.element_at("path", -1).alias("sig"), F.try_element_at("path", F.lit(-2)).alias("second"),
        (F.size("path") > 2).alias("more"))
    found = rule_candidates(ordered, nodes).where(
        F.col("above").isNull() | (F.size(F.array_except("question", F.array_append("above", F.col("sig")))) == 0))
    best = found.groupBy("customer", "question").agg(F.min("rule_id").alias("rule_id"))
    first_rule = active.groupBy("customer").agg(F.min("rule_id").alias("rule_id"))
    empty = questions.where(F.size("signatures") == 0).join(first_rule, "customer").select("customer", F.col("signatures").alias("question"), "rule_id")
    matched = best.unionByName(empty).withColumnRenamed("question", "signatures")
    answers = questions.join(matched, ["customer", "signatures"], "left").select(F.col("customer").alias("_customer"), F.col("signatures").alias("_set"), "asked", "rule_id")
    # Requests without a customer or a set take no part in the joins, so no task gathers them.
    without = requests.where(~known).select(*req_key, F.lit(None).cast(rules.schema["rule_id"].dataType).alias("rule_id"))
    return join_counted(asked, answers, ["_customer", "_set"], "asked").select(*req_key, "rule_id").unionByName(without)


def rule_candidates(ordered: DataFrame, nodes: DataFrame) -> DataFrame:
    """(question, node) pairs to compare: sets of one or two signatures have one node, longer ones the nodes with their two rarest."""
    same = ["customer", "sig"]
    one = ordered.where("second IS NULL").drop("second").join(nodes.where("second IS NULL").drop("second"), same)
    with_two = ordered.where("second IS NOT NULL")
    two = with_two.where("NOT more").join(nodes.where("second IS NOT NULL AND above IS NULL"), [*same, "second"])
    more = with_two.where("more").join(nodes.where("second IS NOT NULL AND above IS NOT NULL"), [*same, "second"])
    columns = ["customer", "question", "sig", "above", "rule_id"]
    return one.select(*columns).unionByName(two.select(*columns)).unionByName(more.select(*columns))


def term_dictionary_join(texts: DataFrame, dictionary: DataFrame, live: DataFrame, key: Sequence[str], text_col: str = "text") -> DataFrame:
    """Dictionary term found in the text (plain substring, or every
    whitespace token of the term inside the space-free text) -> (table,
    channel) among the live channels; unambiguous only when one table matches.

    The dictionary is bounded configuration, so the non-equi ``contains``
    join is a broadcast nested-loop join that stays linear in the texts."""
    low = F.lower(F.col(text_col))
    nospace = F.regexp_replace(low, r"\s+", "")
    d = dictionary.where(F.col("active")).join(live, ["target_table", "source_channel"], "left_semi").withColumns({
        "_term": F.lower("user_term"),
        "_tokens": F.filter(F.split(F.lower("user_term"), r"\s+"), lambda t: t != ""),
    })
    t = texts.select(*key, low.alias("_low"), nospace.alias("_nos"))
    token_hit = (F.size("_tokens") > 0) & F.forall("_tokens", lambda tok: F.col("_nos").contains(tok))
    hits = t.join(F.broadcast(d), F.col("_low").contains(F.col("_term")) | token_hit)
    return hits.select(*key, "target_table", "source_channel", "user_term", "priority")


def unambiguous_channels(hits: DataFrame, key: Sequence[str]) -> DataFrame:
    """J11 result: (key, table, channels) where exactly one table matched."""
    per = hits.groupBy(*key).agg(F.count_distinct("target_table").alias("_nt"), F.first("target_table").alias("target_table"),
                                 F.array_sort(F.collect_set("source_channel")).alias("channels"))
    return per.where(F.col("_nt") == 1).select(*key, "target_table", F.array_join("channels", ",").alias("channels"))


def priority_pick(hits: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per request the dictionary row with the lowest priority (then term) wins."""
    return hits.groupBy(*key).agg(
        F.min_by(F.struct("target_table", "source_channel", "user_term"), F.struct("priority", "user_term", "source_channel")).alias("w")
    ).select(*key, "w.*")
