"""Quality classifier: a sparse ensemble of rules over text statistics.

A forest of shallow trees is grown on a bounded sample of labelled rows; every path from a root is a rule, the
conjunction of its splits. A lasso logistic regression weighs the rules and leaves few. The rules with a weight
are compiled into one Spark column expression over the statistics, which are found once for every document.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.llm.common import ID, derive, held_out, intake, labelled_sample, store

#: Labelled rows that are learned from at most.
SAMPLE = 12_000
TREES, DEPTH, PENALTY, CUT, SEED = 24, 3, 0.0005, 0.3, 7
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
CAPITALS, DIGITS, ENDS = bytes(range(65, 91)), b"0123456789", b".!?:;\"'"
STATISTICS = (
    "words", "word_length", "symbols", "capitals", "digits", "bangs", "bars", "repeated_lines", "line_words",
    "ended_lines", "distinct_words", "commonest_word", "same_neighbours", "repeated_pairs",
)


def share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def without(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def statistics(text: bytes) -> tuple[float, ...]:
    """Shares and means of a whole text in the order of ``STATISTICS``; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    inner = len(text) - without(text, SPACES)
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    counted = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    return (
        float(n), inner / n, share(without(text, SYMBOLS), n), share(without(text, CAPITALS), inner), share(without(text, DIGITS), inner),
        share(text.count(b"!"), n), share(text.count(b"|"), n), share(len(lines) - len(set(lines)), len(lines)), n / len(lines),
        share(sum(line.rstrip(SPACES)[-1:] in ENDSET for line in lines), len(lines)), len(counted) / n, max(counted.values()) / n,
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), share(sum(c for c in pairs.values() if c > 1), n),
    )


ENDSET = frozenset(bytes([c]) for c in ENDS)


def text_statistics(rows: DataFrame) -> DataFrame:
    def build(texts):
        found = list(zip(*map(statistics, texts), strict=True)) or [[]] * len(STATISTICS)
        return dict(zip(STATISTICS, found, strict=True))

    return derive(rows, build, ", ".join(f"{name} double" for name in STATISTICS))


SPLIT = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(description: str) -> list[tuple]:
    """The path to every node but the roots: sorted (statistic, comparison, threshold), tightest bounds only."""
    found, path = {}, []
    for line in description.splitlines():
        if line.strip().startswith("Tree "):
            path = []
        elif split := SPLIT.match(line):
            depth = len(split[1])
            path = [(d, condition) for d, condition in path if d < depth]
            path.append((depth, (int(split[2]), split[3], float(split[4]))))
            bounds: dict[tuple[int, str], float] = {}
            for feature, comparison, threshold in (condition for _, condition in path):
                tighter = min if comparison == "<=" else max
                key = feature, comparison
                bounds[key] = tighter(bounds.get(key, threshold), threshold)
            found[tuple(sorted((f, c, t) for (f, c), t in bounds.items()))] = True
    return list(found)


def rule_column(rule: tuple) -> Column:
    tests = [F.col(STATISTICS[f]) <= t if c == "<=" else F.col(STATISTICS[f]) > t for f, c, t in rule]
    return reduce(lambda a, b: a & b, tests)


def fit(stats: DataFrame, sample: list[tuple]) -> Column:
    """The score as a column over the statistics. ``stats`` has _id; ``sample`` is (_id, label), bounded.

    Where an id repeats, its smallest statistics count, once per label, so that the bound holds for rows too.
    """
    seen = Counter(label for _, label in sample)
    if len(seen) < 2:
        return F.lit(float(next(iter(seen), 0.5)))
    wanted = stats.sparkSession.createDataFrame(sample, f"{ID} {stats.schema[ID].dataType.simpleString()}, label double")
    chosen = stats.join(F.broadcast(wanted), ID).groupBy(ID, "label").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    # a fixed place for every row: the forest draws its samples by partition and place
    placed = chosen.repartition(4, ID).sortWithinPartitions(F.xxhash64(ID), ID, "label")
    train = store(placed.select("label", "s.*"), "rule-sample").cache()
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(train)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(vectors)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return F.lit(share(seen[1], len(sample)))
    fired = train.select("label", F.array(*[rule_column(r).cast("double") for r in rules]).alias("fired"))
    names = [f"r{i}" for i in range(len(rules))]
    fired = fired.select("label", *[F.col("fired")[i].alias(name) for i, name in enumerate(names)])
    fired = VectorAssembler(inputCols=names, outputCol="features").transform(fired).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(fired)
    train.unpersist()
    terms = [F.when(rule_column(rule), float(w)).otherwise(0.0) for rule, w in zip(rules, lasso.coefficients, strict=True) if w]
    total = reduce(lambda a, b: a + b, terms, F.lit(float(lasso.intercept)))
    return 1.0 / (1.0 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", *, sample=SAMPLE) -> DataFrame:
    """Per row: id, held_out, score, predicted (score of 0.3 or more).

    Null and empty texts have zero statistics and the score of those. Without labels every score is 0.5, with
    one class only it is that class. Null ids are scored, never learned from and not held out. Repeated rows
    get equal scores; an id that repeats is one example. An empty table gives no rows.
    """
    stats = store(text_statistics(intake(docs, id_col, text_col)), "statistics")
    chosen = labelled_sample(labels, id_col, label_col, sample, ~held_out(F.col(ID)))
    score = fit(stats, [(key, float(label)) for key, label in chosen])
    return stats.select(F.col(ID).alias(id_col), held_out(F.col(ID)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int")
    )
