from __future__ import annotations

import random

from pyspark.sql import functions as F

from tabvet.operators import joins as J
from tabvet.session import materialize

REQUEST = "req long, customer string, expected array<string>, freq int"
RULE = "rule_id long, customer string, active boolean, validation_status string, signatures array<string>, freq int"


def expected(requests, rules):
    out = []
    for req, customer, want, _ in requests:
        fits = [rule for rule, c, active, status, have, _ in rules
                if want is not None and customer is not None and c == customer and active and status == "approved"
                and {w for w in want if w is not None} <= set(have or [])]
        out.append((req, min(fits, default=None)))
    return sorted(out, key=str)


def test_against_every_pair(spark):
    """Nulls in every column, repeated rows and rule ids, empty sets, unknown signatures, columns named as the operator's own."""
    rng = random.Random(11)
    signs = [f"s{i}" for i in range(9)]

    def some(most):
        return None if rng.random() < 0.05 else [None if rng.random() < 0.03 else rng.choice(signs) for _ in range(rng.randrange(most))]

    rules = [(rng.randrange(150), rng.choice(["a", "a", "a", "b", None]), rng.random() < 0.9, rng.choice(["approved", "approved", "pending", None]),
              some(8), 1) for _ in range(200)]
    requests = [(i, rng.choice(["a", "a", "b", "c", None]), some(5), 1) for i in range(200)]
    requests += requests[:5] + [(900, "a", ["s1", "nowhere"], 1), (901, "a", [], 1)]
    q, r = spark.createDataFrame(requests, REQUEST).repartition(3), spark.createDataFrame(rules, RULE).repartition(3)
    got = sorted((tuple(x) for x in J.rule_subset_match(q, r, ["req"]).collect()), key=str)
    assert got == expected(requests, rules)
    assert sum(rule is not None for _, rule in got) > 60 and sum(rule is None for _, rule in got) > 30
    assert J.rule_subset_match(q.where(F.lit(False)), r, ["req"]).count() == 0
    assert {x.rule_id for x in J.rule_subset_match(q, r.where(F.lit(False)), ["req"]).collect()} == {None}


def test_one_signature_of_all_rules(spark):
    """One customer whose rules all share two signatures, asked for by all requests: a question meets one node, not the rules."""
    rules = spark.range(4000).select(
        (F.col("id") + 7).alias("rule_id"), F.lit("a").alias("customer"), F.lit(True).alias("active"), F.lit("approved").alias("validation_status"),
        F.array(F.lit("all"), F.lit("also"), F.concat(F.lit("own"), F.col("id"))).alias("signatures"))
    requests = spark.range(3000).select(
        F.col("id").alias("req"), F.lit("a").alias("customer"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("all"))).when(F.col("id") % 3 == 1, F.array(F.lit("also"), F.lit("all")))
        .otherwise(F.array(F.lit("all"), F.lit("also"), F.concat(F.lit("own"), F.col("id")))).alias("expected"))
    rules, requests = materialize(rules, "rules"), materialize(requests, "requests")
    frequency, nodes = J.rule_tree(rules)
    assert nodes.where("sig = 'all' AND second IS NULL").count() == 1 and nodes.where("sig = 'also' AND second = 'all'").count() == 1
    out = J.rule_subset_match(requests, rules, ["req"])
    assert {tuple(x) for x in out.collect()} == {(i, 7 if i % 3 < 2 else i + 7) for i in range(3000)}
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    sets = spark.createDataFrame([("a", ["all", "also", f"own{i}"]) for i in range(50)], "customer string, signatures array<string>")
    asked = J._common_first(sets.withColumn("question", F.col("signatures")), frequency, ["question"]).select(
        "customer", "question", F.element_at("path", -1).alias("sig"), F.element_at("path", -2).alias("second"), F.lit(True).alias("more"))
    assert J.rule_candidates(asked, nodes).count() == 50


def test_frequent_keys_stay_in_place(spark):
    """Both ways of ``join_counted`` give the rows of a left join."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    got = J.join_counted(rows, keyed, ["k"], "n")
    assert got.count() == 30_000 and got.where("v = 2 * k").count() == 30_000
    assert keyed.where(F.col("n") > 30_000 * J.HEAVY_SHARE).count() == 1
