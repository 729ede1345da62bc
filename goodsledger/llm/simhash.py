"""SimHash near-duplicates: fingerprints by shingle majority, pigeonhole blocks, Hamming check, components.

A fingerprint has one or more lanes of 64 bits, each a SimHash of its own. Two lanes that differ in at most k bits
agree on two of any k + 2 blocks they are split into, so they share a key of two blocks. Distinct fingerprints
are joined on these keys, lane by lane, and the pairs checked by their Hamming distance over all lanes. A pair
is made at one key only, that of its first two shared blocks. A key with more than ``BUCKET`` values is not
joined but split again: the bits outside the key form k + 2 smaller blocks, of which a close pair again shares
two. With k = 2 the third split fixes 56 bits, so that no bucket ever holds more than 256 values.

``drop_near_duplicates`` takes texts whose SimHashes differ in at most ``NEAR_BITS`` bits from the same blocks, and
verifies them by the Jaccard similarity of their shingles. Fingerprints further apart may belong to texts as similar, so
the rest comes from an exact set-similarity join.
Elements are put in one global order, rarest first by hashed counters over all texts. Two similar sets share one of
the first elements of both (prefix filter), and the first one they share leaves enough behind it on both sides
(length and positional filter). The pairs found are verified on the whole sets. At each element the two outermost
texts are compared with all others first, then in some turns a few others with all that lie in another class; last,
every pair that these links leave in different classes. So a large group of near copies is not paired in full, and no
link between two classes is left out, however many texts share it.

Copies meet in the distinct fingerprints and are never paired. Components of the links are found by alternating
large-star and small-star steps on the distinct fingerprints; every step is a written table.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goodsledger.llm.common import ID, byte_texts, derive, in_arrow, intake, keep_rows, store

#: Fingerprints of one key up to which they are compared as they are.
BUCKET = 256
#: Times that a crowded key is split at most.
LEVELS = 3


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words (all words if fewer), repeats included. A-Z is lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(end + 1 for end in ends[:-1])]
    hashed = xxhash.xxh64_intdigest
    last = ends[size - 1 :] or ends[-1:]
    return np.fromiter((hashed(line[a:b], seed) for a, b in zip(starts, last, strict=False)), np.uint64, len(last))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; 0 for none. Long texts are summed in slices of bounded size."""
    total = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        part = np.unpackbits(hashes[start : start + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64)
        total += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def lane_hashes(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes themselves for lane 0; others by mixing them with the lane's number."""
    if not lane:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * lane % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", *, shingle=3, seed=42, lanes=1) -> DataFrame:
    """(_id, _sha, lanes) per row; lanes are signed longs. Null, empty and wordless texts have zeros."""
    rows = intake(docs, id_col, text_col).withColumn("_sha", F.sha2("_text", 256))

    def build(texts: list[bytes]) -> dict:
        found = np.zeros((len(texts), lanes), dtype=np.uint64)
        for i, text in enumerate(texts):
            hashes = shingle_hashes(text, shingle, seed)
            found[i] = [majority(lane_hashes(hashes, lane)) for lane in range(lanes)]
        return {"lanes": list(found.view(np.int64))}

    return derive(rows, build, "lanes array<long>")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def split_masks(parents: list[tuple[int, int, list[int]]], blocks: int) -> list[tuple[int, int, int, list[int]]]:
    """The keys of the next level, two blocks of the bits that a parent (slot, mask, differ) leaves free.

    (parent slot, slot, all bits fixed, blocks that a pair made at this key must not share, here and above).
    """
    out = []
    for slot, fixed, above in parents:
        free = [bit for bit in range(64) if not fixed >> bit & 1]
        cuts = [len(free) * i // blocks for i in range(blocks + 1)]
        parts = [sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        for p, q in combinations(range(blocks), 2):
            out.append((slot, len(out), fixed | parts[p] | parts[q], above + [parts[i] for i in range(q) if i != p]))
    return out


def close_pairs(prints: DataFrame, lanes: int, lane_bits: int, near_bits: int, max_bits: int) -> DataFrame:
    """Pairs (a < b) of the nodes of the stored ``prints`` that differ in at most ``max_bits`` over all lanes.

    Every such pair with a lane that differs in at most ``lane_bits`` is found; with one lane and equal limits
    that is every pair. Pairs with a lane of at most ``near_bits`` are found where they share a key all the same.
    Nodes that agree in a lane are linked to the smallest of them, and only that one is compared in this lane.
    """
    spark, blocks = prints.sparkSession, lane_bits + 2
    values = prints.select("node", F.posexplode("lanes").alias("lane", "value"))
    rows = store(values.groupBy("lane", "value").agg(F.min("node").alias("node")), "simhash-values").withColumn("slot", F.lit(0))
    found, parents = [], [(0, 0, [])]
    for level in range(1, LEVELS + 1):
        table = split_masks(parents, blocks)
        parents = [key[1:] for key in table]
        masks = spark.createDataFrame(
            [(parent, slot, signed(mask), list(map(signed, differ))) for parent, slot, mask, differ in table],
            "slot int, next int, mask long, differ array<long>",
        )
        # below the first level few rows are left, and carry the blocks that their pairs must not share
        carried = [] if level == 1 else ["differ"]
        # one long names lane, blocks and bits; the distance check below tells apart what it might confuse
        key = F.xxhash64("lane", "next", F.col("value").bitwiseAND(F.col("mask"))).alias("key")
        keys = rows.join(F.broadcast(masks), "slot").select(key, F.col("next").alias("slot"), "lane", "node", "value", *carried)
        sizes = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        shared = store(keys.join(sizes, "key"), "simhash-keys")
        small = shared if level == LEVELS else shared.where(F.col("members") <= BUCKET)
        left = small.select("key", "slot", F.col("node").alias("a"), F.col("value").alias("a_value"), *carried)
        right = small.select("key", F.col("node").alias("b"), F.col("value").alias("b_value"))
        x = F.col("a_value").bitwiseXOR(F.col("b_value"))
        close = (F.col("a") < F.col("b")) & (F.bit_count(x) <= near_bits)
        differ = F.col("differ")
        if level == 1:
            differ = F.element_at(F.lit([list(map(signed, d)) or [-1] for *_, d in table]), F.col("slot") + 1)
        close &= F.forall(differ, lambda block: (x.bitwiseAND(block) != 0) | (block == -1))
        found.append(left.join(right, "key").where(close).select("a", "b"))
        rows = shared.where(F.col("members") > BUCKET).select("lane", "value", "node", "slot")
        if rows.isEmpty():
            break
    pairs = reduce(DataFrame.union, found).distinct()
    if lanes == 1:
        return pairs
    least = values.groupBy("lane", "value").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    equal = least.join(values.withColumnRenamed("node", "b"), ["lane", "value"]).where("a < b").select("a", "b")
    return verified(pairs, prints, lanes, max_bits).union(equal).distinct()


def verified(pairs: DataFrame, prints: DataFrame, lanes: int, max_bits: int) -> DataFrame:
    """The pairs whose Hamming distance over all lanes is at most ``max_bits``."""
    a = prints.select(F.col("node").alias("a"), F.col("lanes").alias("a_lanes"))
    b = prints.select(F.col("node").alias("b"), F.col("lanes").alias("b_lanes"))
    apart = [F.bit_count(F.col("a_lanes")[i].bitwiseXOR(F.col("b_lanes")[i])) for i in range(lanes)]
    return pairs.join(a, "a").join(b, "b").where(reduce(lambda x, y: x + y, apart) <= max_bits).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b): root is the smallest node reachable.

    Large-star hangs the larger neighbours of each node to its smallest neighbour, small-star the others; the
    links shrink to stars in a number of rounds that grows with the logarithm of the longest chain. Minima are
    combined before the shuffle, and the join that returns them is one that Spark can split where a node is hot.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:  # each node with its smaller neighbours
            both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = both.join(low, "u")
        if large:
            out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("b"), F.col("m").alias("a"))
        else:
            out = hung.select(F.col("v").alias("b"), F.col("m").alias("a")).union(
                low.select(F.col("u").alias("b"), F.col("m").alias("a"))
            )
        return out.where("a <> b").select("a", "b").distinct()

    edges = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = store(star(star(edges, True), False), "links")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)


def classes_of(marks: DataFrame, max_bits: int) -> DataFrame:
    """Stored (lanes, root): the class of every distinct fingerprint of one lane."""
    prints = store(marks.select("lanes").distinct().withColumn("node", F.monotonically_increasing_id()), "fingerprint-nodes")
    linked = components(store(close_pairs(prints, 1, max_bits, max_bits, max_bits), "simhash-pairs"))
    linked = linked.withColumnRenamed("node", "linked")
    rooted = prints.join(linked, F.col("node") == F.col("linked"), "left")
    return store(rooted.select("lanes", F.coalesce("root", "node").alias("root")), "fingerprint-classes")


def simhash_components(docs: DataFrame, id_col="doc_id", text_col="text", *, shingle=3, seed=42, max_bits=2) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id reachable; null where no id is set).

    Rows with null ids take part and get their component. Repeated rows share a fingerprint. Empty texts link
    to each other and to any other fingerprint close to zero. An empty table gives no rows.
    """
    marks = store(fingerprints(docs, id_col, text_col, shingle=shingle, seed=seed), "fingerprints")
    classes = classes_of(marks, max_bits)
    least = marks.groupBy("lanes").agg(F.min(ID).alias("least")).join(classes, "lanes")
    named = least.groupBy("root").agg(F.min("least").alias("component_id")).join(classes, "root")
    named = store(named.select("lanes", "component_id"), "fingerprint-components")
    return marks.join(named, "lanes").select(
        F.col(ID).alias(id_col), F.lower(F.lpad(F.hex(F.col("lanes")[0]), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Settings of ``drop_near_duplicates``: words of a shingle, and the similarity from which texts are linked.
WORDS, SIMILARITY = 5, 0.8
#: Counters of shingles by the first bits of their hash; they only order the shingles.
COUNTER_BITS = 18
#: Bits in which fingerprints of texts that are compared first may differ.
NEAR_BITS = 3
#: Texts to be compared up to which their hashes are sent to every task instead of being shuffled.
SENT = 50_000
#: Taken off bounds that are products of fractions, so that rounding never loses a pair.
ROUNDING = 1e-9
COUNTED, DISTINCT = 1, 2
#: Turns in which a few texts of each key are compared with all others before all that is left is paired.
HUB_TURNS = 3


def shingle_sets(text: bytes, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles, counted and distinct. The n-th repeat of a shingle is an element of its own."""
    hashes = np.sort(shingle_hashes(text, size, seed))
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    distinct = hashes[first]
    if len(distinct) == len(hashes):
        return hashes, distinct
    starts = np.flatnonzero(first)
    repeat = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    x = hashes + np.uint64(0x9E3779B97F4A7C15) * repeat.astype(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.sort(np.where(first, hashes, x ^ x >> np.uint64(31))), distinct


def counters(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def shingle_counts(rows: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """Elements of all texts by counter. ``1 << COUNTER_BITS`` sums reach the driver."""

    def run(batches):
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for text in byte_texts(batch):
                np.add.at(total, counters(shingle_sets(text, shingle, seed)[0]), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"counter": used, "n": total[used]})

    parts = in_arrow(rows.select("_text"), run, "counter long, n long")
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    summed = parts.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    total[summed["counter"].to_numpy()] = summed["n"].to_numpy()
    return total


def rare_first(found: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first elements in the order of all texts: two sets this similar share one of them."""
    order = np.lexsort((found, counts[counters(found)]))
    return found[order[: len(found) - ceil(similarity * len(found) - ROUNDING) + 1]].view(np.int64)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the elements that fall on it: two sketches differ in no more bits than their sets."""
    odd = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_marks(rows: DataFrame, shingle: int, seed: int, similarity: float) -> DataFrame:
    """(_id, _sha, lanes, digest, sizes and first elements of both sets); no second set where nothing is repeated."""
    sent = rows.sparkSession.sparkContext.broadcast(shingle_counts(rows, shingle, seed))

    def build(texts: list[bytes]) -> dict:
        out = {name: [] for name in ("lanes", "digest", *(f"{form}_{what}" for form in ("counted", "distinct") for what in ("size", "keys", "sketch")))}
        for text in texts:
            counted, distinct = shingle_sets(text, shingle, seed)
            out["lanes"].append([signed(majority(shingle_hashes(text, shingle, seed)))])
            out["digest"].append(sha256(counted.tobytes()).hexdigest())
            distinct = distinct[: len(distinct) if len(distinct) < len(counted) else 0]
            for name, found in (("counted", counted), ("distinct", distinct)):
                out[f"{name}_size"].append(len(found))
                out[f"{name}_keys"].append(rare_first(found, sent.value, similarity))
                out[f"{name}_sketch"].append(odd_sketch(found))
        return out

    form = "{0}_size int, {0}_keys array<long>, {0}_sketch array<long>"
    return derive(rows, build, f"lanes array<long>, digest string, {form.format('counted')}, {form.format('distinct')}")


def fingerprint_pairs(prints: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a < b) of nodes whose fingerprints of one lane are close; equal ones pair with the smallest of them only."""
    least = prints.groupBy("lanes").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    equal = least.join(prints.select("lanes", F.col("node").alias("b")), "lanes").where("a < b").select("a", "b")
    return close_pairs(prints.select("node", "lanes"), 1, max_bits, max_bits, max_bits).union(equal)


def candidates(left: DataFrame, right: DataFrame, apart, similarity: float) -> DataFrame:
    """Distinct pairs (a < b) of rows at one key that may be this similar by their sizes and places."""
    left = left.select("key", *[F.col(c).alias(f"a_{c}") for c in left.columns if c != "key"])
    right = right.select("key", *[F.col(c).alias(f"b_{c}") for c in right.columns if c != "key"])
    sizes = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - ROUNDING
    # at the first element they share, all that is shared lies from there on
    ahead = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    places = ahead >= similarity / (1 + similarity) * (F.col("a_size") + F.col("b_size")) - ROUNDING
    forms = F.col("a_form").bitwiseAND(F.col("b_form")) != 0
    pairs = left.join(right, "key").where(apart & forms & sizes & places)
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def similar(pairs: DataFrame, prints: DataFrame, rows: DataFrame, shingle: int, seed: int, similarity: float) -> DataFrame:
    """Stored: those of the stored ``pairs`` whose shingle sets, distinct or counted, are this similar."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = store(prints.select("node", "_sha").join(nodes, "node"), "compared")
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    texts = rows.select("_sha", "_text").join(wanted, "_sha").groupBy("node").agg(F.first("_text").alias("_text"))

    def build(found: list[bytes]) -> dict:
        sets = [shingle_sets(text, shingle, seed) for text in found]
        # the second set only where it is another one
        return {"counted": [c.view(np.int64) for c, _ in sets], "distinct": [d.view(np.int64) if len(d) < len(c) else None for c, d in sets]}

    sets = store(derive(texts, build, "counted array<long>, distinct array<long>"), "shingle-sets")
    a, b = ([F.col(c).alias(f"{side}_{c}" if c != "node" else side) for c in sets.columns] for side in "ab")

    def alike(x, y):
        both = F.size(F.array_intersect(x, y))
        return both / (F.size(x) + F.size(y) - both) >= similarity

    def distinct(side: str):
        return F.coalesce(f"{side}_distinct", f"{side}_counted")

    same = alike(distinct("a"), distinct("b")) | alike(F.col("a_counted"), F.col("b_counted"))
    found = pairs.join(sets.select(a), "a").join(sets.select(b), "b").where(same)
    return store(found.select("a", "b"), "similar")


def open_keys(keys: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of the keys whose nodes lie in several classes, with the class (``root``) of each."""
    rooted = keys.drop("root").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return rooted.join(several.select("key"), "key")


def hubs_of(keys: DataFrame, turn: int) -> DataFrame:
    """At most four nodes of each key, the same ones for keys of the same nodes: the ends of two orders by hash."""
    orders = [F.xxhash64("node", F.lit(f"{turn}-{side}")) for side in range(2)]
    ends = keys.groupBy("key").agg(*[f(o).alias(f"{f.__name__}{i}") for i, o in enumerate(orders) for f in (F.min, F.max)])
    is_hub = reduce(lambda x, y: x | y, [(o == F.col(f"min{i}")) | (o == F.col(f"max{i}")) for i, o in enumerate(orders)])
    return keys.join(ends, "key").where(is_hub).select(*keys.columns)


def with_sketches(keys: DataFrame, prints: DataFrame) -> DataFrame:
    counted = F.col("form").bitwiseAND(F.lit(COUNTED)) != 0
    sketches = prints.select("node", "counted_sketch", "distinct_sketch")
    chosen = F.when(counted, F.col("counted_sketch")).otherwise(F.col("distinct_sketch"))
    return keys.join(sketches, "node").select(*keys.columns, chosen.alias("sketch"))


def may_be_alike(similarity: float):
    """Sets of together n elements that are this similar differ in at most n (1 - s) / (1 + s); so do their sketches."""
    bits = [F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(4)]
    return reduce(lambda x, y: x + y, bits) <= (1 - similarity) / (1 + similarity) * (F.col("a_size") + F.col("b_size")) + ROUNDING


def similar_classes(marks: DataFrame, rows: DataFrame, shingle: int, seed: int, similarity: float) -> DataFrame:
    """Stored (digest, root): the class of every distinct counted set under the links of this similarity or more."""
    columns = ("_sha", "lanes", "counted_size", "counted_keys", "counted_sketch", "distinct_size", "distinct_keys", "distinct_sketch")
    first = F.min_by(F.struct(*columns), "_sha").alias("first")
    prints = marks.groupBy("digest").agg(first).select("digest", "first.*")
    prints = store(prints.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")

    alone = F.when(F.col("distinct_size") == 0, COUNTED | DISTINCT).otherwise(COUNTED)
    kinds = (("counted", alone), ("distinct", F.lit(DISTINCT)))
    keys = reduce(DataFrame.union, [
        prints.select("node", form.alias("form"), F.col(f"{name}_size").alias("size"), F.posexplode(f"{name}_keys").alias("place", "key"))
        for name, form in kinds
    ])
    ends = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    is_hub = (F.col("node") == F.col("low")) | (F.col("node") == F.col("high"))
    shared = store(keys.join(ends, "key").withColumn("hub", is_hub).drop("low", "high"), "shingle-keys")

    # texts with close fingerprints, and the first two nodes of each key against all others; then all pairs that these
    # links leave in different classes
    hubs, every = shared.where("hub").drop("hub"), shared.drop("hub")
    first = candidates(hubs, every, F.col("a_node") != F.col("b_node"), similarity)
    pairs = store(first.union(fingerprint_pairs(prints, NEAR_BITS)).distinct(), "shingle-pairs")
    links = similar(pairs, prints, rows, shingle, seed, similarity)
    done, still = pairs, every
    for turn in range(HUB_TURNS + 1):
        still = store(open_keys(still, components(links)), "shingle-open")
        if still.isEmpty():
            break
        # a few nodes of each key against all others, and last all that these links leave in different classes
        apart = F.col("a_root") != F.col("b_root")
        if turn < HUB_TURNS:
            found = candidates(hubs_of(still, turn), still, apart, similarity)
        else:
            sketched = with_sketches(still, prints)
            apart &= (F.col("a_node") < F.col("b_node")) & may_be_alike(similarity)
            found = candidates(sketched, sketched, apart, similarity)
        further = store(found.join(done, ["a", "b"], "left_anti"), "shingle-pairs")
        done, links = done.union(further), links.union(similar(further, prints, rows, shingle, seed, similarity))
    classes = prints.select("digest", "node").join(components(links), "node", "left")
    return store(classes.select("digest", F.coalesce("root", "node").alias("root")), "shingle-classes")


def drop_near_duplicates(
    docs: DataFrame, id_col="doc_id", text_col="text", *, shingle=WORDS, seed=42, similarity=SIMILARITY
) -> DataFrame:
    """One row of each component stays, with all columns: smallest id, null ids last, then smallest text hash.

    Texts are linked where the Jaccard similarity of their shingles, distinct or counted with their repeats, is
    ``similarity`` or more. Every such pair is linked or lies in one component all the same.
    """
    rows = intake(docs, id_col, text_col).withColumn("_sha", F.sha2("_text", 256))
    marks = store(shingle_marks(rows, shingle, seed, similarity), "shingles")
    classes = similar_classes(marks, rows, shingle, seed, similarity)
    order = F.struct(F.col(ID).isNull().alias("none"), F.col(ID), F.col("_sha"))
    best = marks.groupBy("digest", ID, "_sha").agg(F.count("*").alias("copies"))
    best = best.groupBy("digest").agg(F.min_by(F.struct(ID, "_sha", "copies"), order).alias("row"), F.min(order).alias("place"))
    kept = best.join(classes, "digest").groupBy("root").agg(F.min_by("row", "place").alias("row")).select("row.*")
    return keep_rows(docs, id_col, text_col, kept)
