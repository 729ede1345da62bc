"""Contained texts: all of them are found, and few others are looked at."""

import random

from goodsledger.operators import candidates
from goodsledger.operators.candidates import containing

NAMES = "receiving_id long, norm string"


def test_every_contained_text(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choices("ab яё1", k=rng.choice([0, 1, 2, 3, 5, 9, 20, 40]))) for _ in range(150)})
    outer = sorted({*texts, *("x" + t + "ab" * 40 for t in texts[:40])})
    got = containing(
        spark.createDataFrame([(1, t) for t in texts], NAMES), spark.createDataFrame([(1, t) for t in outer], NAMES)
    ).collect()
    assert sorted({(r.left, r.right) for r in got}) == sorted((a, b) for a in texts for b in outer if a and a in b)


def test_codes_meet_few_candidates(spark):
    names = spark.range(1500).selectExpr("1L as receiving_id", "concat('p', lpad(id, 7, '0'), ' x', lpad(id, 7, '0')) as norm")
    pairs = containing(names, names)
    assert pairs.count() == 1500
    # rows of the join before the texts are compared
    plan = pairs._jdf.queryExecution().analyzed().child().child()
    seen = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan).count()
    assert seen <= 3000, seen
