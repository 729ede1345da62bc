"""Quality rules, toxicity, quality model, byte-level BPE and the pipeline."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from goodsledger.llm import bpe, bpe_tables, common, quality_model, quality_rules, queries, toxicity
from goodsledger.llm.common import fold_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_statistics(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counted = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counted[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_statistics_match_the_definition():
    texts = ["", " \n ", "a b c a b c", "a a a a", "é 日本 #x y |\x1c| \na b\na b\n a b\n\n", "a b c d e a b c x y d e a", "x" * 5000]
    for text in texts:
        assert quality_rules.statistics(text.encode()) == slow_statistics(text)


def test_quality_rules_match_brute_force(edge_docs, no_docs, labels):
    got = quality_rules.quality_verdicts(edge_docs, labels).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for key, text in rows:
        np.add.at(raw, quality_rules.hashed(text.encode()), 1)
        if key in (7, 8):
            np.add.at(target, quality_rules.hashed(text.encode()), 1)
    ratios = quality_rules.log_ratios(raw, target)
    want = Counter()
    for key, text in rows:
        n = slow_statistics(text)
        grams = quality_rules.hashed(text.encode())
        score = float(np.mean(ratios[grams])) if len(grams) else 0.0
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        want[key, *n, round(score, 9), failed, not failed and score >= quality_rules.THRESHOLD] += 1
    names = quality_rules.NAMES
    assert Counter((r["doc_id"], *(r[n] for n in names), round(r["llr"], 9), r["base_failed"], r["kept"]) for r in got) == want
    assert quality_rules.quality_verdicts(no_docs, labels).count() == 0
    assert quality_rules.quality_verdicts(edge_docs, labels.where("1 = 0")).where("llr <> 0").count() == 0
    kept = quality_rules.drop_low_quality(edge_docs, labels)
    assert kept.columns == edge_docs.columns
    assert kept.count() == sum(r["kept"] for r in got)


def test_junk_is_rejected_and_clean_texts_stay(spark, sf_dir, tables):
    marked = {r["doc_id"]: r["quality"] for r in tables["labels"].collect()}
    got = [r for r in queries.op4_quality_rules(spark, sf_dir).collect() if r["doc_id"] in marked and not r["base_failed"]]
    assert all(r["kept"] for r in got if marked[r["doc_id"]] == 1)
    assert sum(not r["kept"] for r in got if marked[r["doc_id"]] == 0) >= 0.8 * sum(marked[r["doc_id"]] == 0 for r in got)


def test_ftrl_is_sparse_and_learns():
    bad, good = [b"you are a worthless thing %d" % i for i in range(60)], [b"you are a lovely thing %d" % i for i in range(200)]
    rows = [(toxicity.features(t), y) for pair in zip(bad * 3, good, strict=False) for t, y in zip(pair, (1, 0), strict=True)]
    weights = toxicity.ftrl(rows)
    assert np.count_nonzero(weights) < 40
    score = lambda t: toxicity.sigmoid(weights[toxicity.features(t)].sum())
    assert score(b"so worthless a thing") > 0.5 > score(b"so lovely a thing")


@pytest.mark.parametrize(("name", "label", "cut"), [("op5_toxicity", "toxic", 0.5), ("op9_quality_scores", "quality", 0.3)])
def test_scores_and_folds(spark, sf_dir, tables, name, label, cut):
    got = queries.queries()[name](spark, sf_dir).collect()
    assert len(got) == tables["documents"].count()
    assert all(r["held_out"] == (fold_of(r["doc_id"]) == 0) and r["predicted"] == (r["score"] >= cut) for r in got)
    marked = {r["doc_id"]: r[label] for r in tables["labels"].collect()}
    sure = [r for r in got if r["doc_id"] in marked]
    assert sum(r["predicted"] == marked[r["doc_id"]] for r in sure) >= 0.85 * len(sure)


def test_models_ignore_held_out_labels(spark, sf_dir, tables):
    flipped = tables["labels"].selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = (toxicity.fit(tables["documents"], lab) for lab in (tables["labels"], flipped))
    assert np.array_equal(a, b)


def test_models_on_edge_tables(edge_docs, no_docs, labels):
    for scores in (toxicity.toxicity_scores, quality_model.quality_scores):
        got = scores(edge_docs, labels).collect()
        assert len(got) == edge_docs.count()
        assert all(0 <= r["score"] <= 1 for r in got)
        assert scores(no_docs, labels).count() == 0
        assert {r["score"] for r in scores(edge_docs, labels.where("1 = 0")).collect()} == {0.5}


def slow_toxicity(docs, labels):
    """FTRL-proximal one coordinate after the other, in the order of the sample's places."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    place = {r["doc_id"]: r["place"] for r in docs.selectExpr("doc_id", "xxhash64('order', doc_id) as place").collect()}
    known = [(place[r["doc_id"]], r["doc_id"], r["toxic"]) for r in labels.collect() if r["doc_id"] in texts and fold_of(r["doc_id"])]
    z, n = Counter(), Counter()

    def weight(at):
        if abs(z[at]) <= toxicity.L1:
            return 0.0
        return -(z[at] - (toxicity.L1 if z[at] > 0 else -toxicity.L1)) / ((toxicity.BETA + n[at] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for _, key, label in sorted(known):
            ats = toxicity.features(texts[key]).tolist()
            weights = [weight(at) for at in ats]
            off = toxicity.sigmoid(sum(weights)) - label
            for at, w in zip(ats, weights, strict=True):
                z[at] += off - ((n[at] + off * off) ** 0.5 - n[at] ** 0.5) / toxicity.ALPHA * w
                n[at] += off * off
    return {key: toxicity.sigmoid(sum(map(weight, toxicity.features(text).tolist()))) for key, text in texts.items()}


def test_toxicity_matches_brute_force(tables):
    docs, labels = tables["documents"], tables["labels"]
    want = slow_toxicity(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key], abs=1e-6) for key in want)


def test_repeated_ids_are_one_example(spark, tables):
    """A learned id that repeats, with its text and with others, adds no example."""
    docs, labels = tables["documents"].select("doc_id", "text"), tables["labels"]
    key = next(r["doc_id"] for r in labels.orderBy("doc_id").collect() if fold_of(r["doc_id"]))
    for scores in (toxicity.toxicity_scores, quality_model.quality_scores):
        plain = {r["doc_id"]: r["score"] for r in scores(docs, labels).collect()}
        again = docs.union(docs.where(f"doc_id = {key}").crossJoin(spark.range(50)).select("doc_id", "text"))
        repeated = scores(again, labels).collect()
        assert len(repeated) == len(plain) + 50
        assert all(r["score"] == pytest.approx(plain[r["doc_id"]]) for r in repeated)
    many = spark.range(40).selectExpr(f"cast({key} as bigint) as doc_id", "concat('text ', id) as text")
    sample = common.sample_texts(common.intake(docs.union(many), "doc_id", "text"), [(key, 0), (key, 1)])
    assert sample.count() == 2


def test_rule_scores_match_brute_force(spark, tables):
    rows = common.intake(tables["documents"], "doc_id", "text")
    rules = [((0, "<=", 300.0),), ((0, ">", 100.0), (1, "<=", 5.0)), ((2, ">", 0.1),)]
    stats = quality_model.text_statistics(rows)
    columns = [quality_model.rule_column(r).alias(f"r{n}") for n, r in enumerate(rules)]
    for row in stats.select(*quality_model.STATISTICS, *columns).collect():
        for n, rule in enumerate(rules):
            values = [(row[quality_model.STATISTICS[f]], c, t) for f, c, t in rule]
            assert row[f"r{n}"] == all(v <= t if c == "<=" else v > t for v, c, t in values)


def test_tree_paths_become_rules():
    text = """Model
  Tree 0 (weight 1.0):
    If (feature 0 <= 5.0)
     If (feature 1 <= 2.5)
      Predict: 0.0
     Else (feature 1 > 2.5)
      Predict: 1.0
    Else (feature 0 > 5.0)
     If (feature 0 <= 9.0)
      Predict: 1.0
     Else (feature 0 > 9.0)
      Predict: 0.0
"""
    assert quality_model.tree_rules(text) == [
        ((0, "<=", 5.0),), ((0, "<=", 5.0), (1, "<=", 2.5)), ((0, "<=", 5.0), (1, ">", 2.5)), ((0, ">", 5.0),),
        ((0, "<=", 9.0), (0, ">", 5.0)), ((0, ">", 9.0),),
    ]


def test_packed_numbers_round_trip():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 2**31], dtype=np.uint32)
    data, ends = bpe.packed_numbers(numbers)
    assert bpe.unpacked_numbers(data).tolist() == numbers.tolist()
    assert ends[-1] == len(data)
    assert bpe.unpacked_numbers(bpe.packed_numbers(numbers[:0])[0]).tolist() == []


def check_round_trip(docs, got):
    ranks = bpe_tables.rank_file(bpe_tables.ranks_path())
    coder: tiktoken.Encoding = bpe_tables.encoding(ranks)
    want = Counter()
    for r in docs.collect():
        text = r["text"] or ""
        ids = np.array(coder.encode_ordinary(text), dtype="<u4")
        want[r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_byte_bpe_round_trip(edge_docs, no_docs, tables):
    check_round_trip(edge_docs, bpe.round_trip(edge_docs).collect())
    check_round_trip(tables["documents"], bpe.round_trip(tables["documents"]).collect())
    small = bpe.decode(bpe.encode(edge_docs, block_bytes=1000)).collect()
    assert Counter((r["_id"], bytes(r["decoded"]).decode()) for r in small) == Counter(
        (r["doc_id"], r["text"] or "") for r in edge_docs.collect()
    )
    assert bpe.round_trip(no_docs).count() == 0


def test_pipeline_stages_keep_columns_and_act(spark, sf_dir, tables):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "simhash near-dedup", "secret scans", "best-fit packing",
    ]
    docs, texts = tables["documents"], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    verdicts = {r["doc_id"]: r["kept"] for r in queries.op4_quality_rules(spark, sf_dir).collect()}
    assert texts[0].keys() == {key for key, kept in verdicts.items() if kept}
    assert sorted(texts[1].values()) == sorted(set(texts[0].values()))
    assert texts[2].keys() <= texts[1].keys() and len(texts[2]) >= 0.9 * len(texts[1])
    assert texts[3].keys() == texts[2].keys()
    assert not any(re.search("AKIA[A-Z0-9]{16}", t) for t in texts[3].values())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == texts[3].keys()
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)


def test_round_trip_decodes_where_ids_are_made(spark, edge_docs):
    both = bpe.round_trip(edge_docs)
    # tokens, words and blocks: no Python stage of its own for decoding
    text = both._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1 and text.count("FlatMapCoGroupsInArrow") == 1
    want = bpe.decode(bpe.encode(edge_docs)).selectExpr("_id as doc_id", "sha2(ids, 256) as i", "sha2(decoded, 256) as d")
    assert sorted(map(tuple, want.collect()), key=repr) == sorted(
        map(tuple, both.select("doc_id", "ids_sha256", "decoded_sha256").collect()), key=repr)
