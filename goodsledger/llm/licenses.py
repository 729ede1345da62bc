"""License scans: phrases, and an exact set-similarity join of text blocks with license notices.

A notice is the set of its pairs of adjacent words, so that words must stand in order; scattered words do not
count. A block is a window of the whole text, line ends or not, as long as the notice may grow when ``CONTAINED``
of it remains. A block meets a notice when it contains at least that share of the notice's pairs; notices of
fewer than ``WHOLE_BELOW`` pairs must be there whole. Pairs are put in one global order, rarest first by the texts that
have them. A block that meets a notice has one of the notice's first pairs in it (prefix filter), and within reach of
the first of these enough of the pairs behind it (length and positional filter), so looking around these
pairs finds every such block; the blocks found are then verified by all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goodsledger.llm.common import ID, derive, in_arrow, intake, store

CONTAINED = 0.8
WHOLE_BELOW = 10
# Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Bytes that separate words become spaces, letters A-Z small.
TO_WORDS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)
)


def standard_notices() -> list[tuple[str, str]]:
    """(label, text) of the notices that the licenses propose, one a line of the file beside this module."""
    lines = Path(__file__).with_name("license_notices.txt").read_text(encoding="utf-8").splitlines()
    return [tuple(line.split(": ", 1)) for line in lines if line]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


@dataclass(frozen=True)
class Notice:
    label: str
    pairs: tuple[tuple[bytes, bytes], ...]  # different ones, in order
    need: int
    span: int  # pairs of a block, counted with repeats


def notice_table(notices: Iterable[tuple[str, str]], contained: float, whole_below: int) -> list[Notice]:
    """Notices as pairs; those of a single word or none cannot be met and are an error."""
    table = []
    for label, text in notices:
        words = words_of(text.encode())
        if len(words) < 2:
            raise ValueError(f"a notice needs two words: {text!r}")
        pairs = tuple(dict.fromkeys(zip(words, words[1:])))
        need = len(pairs) if len(pairs) < whole_below else ceil(contained * len(pairs))
        table.append(Notice(label, pairs, need, int((len(words) - 1) / contained)))
    return table


class PairIndex:
    """Numbers of the notices' pairs, for looking up all pairs of a text at once."""

    def __init__(self, table: list[Notice]):
        self.table = table
        self.pairs = list(dict.fromkeys(p for notice in table for p in notice.pairs))
        self.words = {w: n + 1 for n, w in enumerate(dict.fromkeys(w for p in self.pairs for w in p))}
        self.needs = np.array([notice.need for notice in table])

    @cached_property
    def numbers(self) -> np.ndarray:
        """The pair's number by its two words' numbers, else -1."""
        grid = np.full((len(self.words) + 1,) * 2, -1, np.int32)
        for n, (a, b) in enumerate(self.pairs):
            grid[self.words[a], self.words[b]] = n
        return grid

    @cached_property
    def member(self) -> np.ndarray:
        """Notices by pairs: whether the notice has the pair."""
        known = {pair: n for n, pair in enumerate(self.pairs)}
        out = np.zeros((len(self.table), len(self.pairs)), bool)
        for n, notice in enumerate(self.table):
            out[n, [known[p] for p in notice.pairs]] = True
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places, pair numbers) of the notices' pairs in a text."""
        codes = np.fromiter(map(self.words.get, words, repeat(0)), np.int32, len(words))
        found = self.numbers[codes[:-1], codes[1:]]
        places = np.flatnonzero(found >= 0)
        return places, found[places]

    def possible(self, seen: np.ndarray) -> np.ndarray:
        """The notices of which a text has enough different pairs (length filter)."""
        return np.flatnonzero(self.member[:, seen].sum(axis=1) >= self.needs)


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(start, label) of each phrase whose words stand one after the other."""
    found = []
    for phrase, label in phrases:
        parts = phrase.encode().split()
        last = parts[-1]
        ends = [i for i, word in enumerate(words) if word == last]
        found += [(i - len(parts) + 1, label) for i in ends if i + 1 >= len(parts) and words[i - len(parts) + 1 : i + 1] == parts]
    return found


def best_block(places: np.ndarray, orders: np.ndarray, size: int, need: int, span: int) -> int:
    """The most different pairs that a block of ``span`` pairs holds, 0 if no block holds ``need``.

    ``places`` ascend; ``orders`` are the pairs' places in the notice's rarest-first order, 0 to ``size`` - 1.
    """
    ranges: list[list[int]] = []
    for k in np.flatnonzero(orders <= size - need):
        low, high = np.searchsorted(places, (places[k] - span + 1, places[k] + span))
        near = orders[low:high]
        if len(np.unique(near[near >= orders[k]])) < need:
            continue
        if ranges and low <= ranges[-1][1]:
            ranges[-1][1] = max(high, ranges[-1][1])
        else:
            ranges.append([low, high])
    best = 0
    for low, high in ranges:
        at, pair = places[low:high].tolist(), orders[low:high].tolist()
        held, different, end = [0] * size, 0, 0
        for start, place in enumerate(at):
            while end < len(at) and at[end] < place + span:
                different += held[pair[end]] == 0
                held[pair[end]] += 1
                end += 1
            best = max(best, different)
            held[pair[start]] -= 1
            different -= held[pair[start]] == 0
    return best if best >= need else 0


def scanned(rows: DataFrame, phrases, index: PairIndex) -> DataFrame:
    """Beside ``rows``: n_words, the phrases' places and labels, pairs seen, and the pairs of possible notices."""

    def build(texts: list[bytes]) -> dict:
        out = {name: [] for name in ("n_words", "starts", "phrase_labels", "seen", "places", "pairs")}
        for text in texts:
            words = words_of(text)
            phrased = phrase_places(words, phrases)
            places, pairs = index.hits(words)
            seen = np.unique(pairs)
            wanted = index.member[index.possible(seen)].any(axis=0)[pairs]
            out["n_words"].append(len(words))
            out["starts"].append([start for start, _ in phrased])
            out["phrase_labels"].append(sorted({label for _, label in phrased}))
            out["seen"].append(seen)
            out["places"].append(places[wanted])
            out["pairs"].append(pairs[wanted])
        return out

    fields = "n_words long, starts array<long>, phrase_labels array<string>, seen array<int>, places array<long>, pairs array<int>"
    return derive(rows, build, fields)


def met_notices(marks: DataFrame, index: PairIndex) -> DataFrame:
    """Beside ``marks`` without its pairs: ``met``, the labels of the notices that a block meets, and the largest ``share``.

    The notices are the small side of the join, held by every task; the order of their pairs takes one count
    over all texts, of which as many numbers as there are pairs reach the driver.
    """
    counts = np.zeros(len(index.pairs), np.int64)
    for r in marks.select(F.explode("seen").alias("pair")).groupBy("pair").count().collect():
        counts[r["pair"]] = r["count"]
    rarest = np.lexsort((np.arange(len(counts)), counts))
    orders = np.zeros(index.member.shape, np.int32)
    for n, has in enumerate(index.member):
        of_notice = rarest[has[rarest]]
        orders[n, of_notice] = np.arange(len(of_notice))
    kept = [f for f in marks.schema.fields if f.name not in ("seen", "places", "pairs")]
    made = T.StructType.fromDDL("met array<string>, share double")

    def search(places: np.ndarray, pairs: np.ndarray) -> tuple[list[str], float]:
        labels, share = set(), 0.0
        for n in index.possible(np.unique(pairs)):
            notice, own = index.table[n], index.member[n][pairs]
            size = len(notice.pairs)
            best = best_block(places[own], orders[n][pairs[own]], size, notice.need, notice.span)
            if best:
                labels.add(notice.label)
                share = max(share, best / size)
        return sorted(labels), share

    def run(batches):
        for batch in batches:
            columns = {f.name: batch.column(f.name) for f in kept}
            both = zip(batch.column("places"), batch.column("pairs"), strict=True)
            found = [search(a.values.to_numpy(), b.values.to_numpy()) if len(a.values) else ([], 0.0) for a, b in both]
            columns["met"] = pa.array([labels for labels, _ in found], pa.list_(pa.string()))
            columns["share"] = pa.array([share for _, share in found], pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    return in_arrow(marks, run, T.StructType([*kept, *made.fields]))


def license_labels(
    docs: DataFrame, id_col="doc_id", text_col="text", *, phrases=PHRASES, notices=None, contained=CONTAINED, whole_below=WHOLE_BELOW
) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score``: 1 with a phrase, else the largest contained share of a notice that is met, else 0. ``notices`` are
    (label, text), by default those of ``standard_notices``. Null and empty texts have no words. Null ids and
    repeated rows stay as they are. Very long texts are searched whole, in time linear in their length. An empty
    table gives no rows.
    """
    index = PairIndex(notice_table(standard_notices() if notices is None else notices, contained, whole_below))
    marks = store(scanned(intake(docs, id_col, text_col), phrases, index), "license-scan")
    return met_notices(marks, index).select(
        F.col(ID).alias(id_col),
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join("phrase_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("phrase_labels", "met")), ",").alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(F.col("share")).alias("score"),
    )


def labels_sql(phrases=PHRASES, notices=None, contained=CONTAINED, whole_below=WHOLE_BELOW) -> str:
    """The same over a table ``documents`` for the checking engine: every window of every text against every notice."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = []
    for phrase, label in phrases:
        tests = " and ".join(f"w[i + {n}] = '{part}'" for n, part in enumerate(phrase.split()))
        places.append(f"select doc_id, i - 1 as start, '{label}' as label from numbered where {tests}")
    table = notice_table(standard_notices() if notices is None else notices, contained, whole_below)
    known = ", ".join(
        f"({n}, '{notice.label}', {notice.need}, {notice.span}, [{', '.join(repr(b' '.join(p).decode()) for p in notice.pairs)}])"
        for n, notice in enumerate(table)
    )
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with low as (select doc_id, {low} as t from documents),
worded as (select doc_id, t, regexp_extract_all(t, '{word}') as w from low),
numbered as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from worded where contains(t, 'license')),
places as ({" union all ".join(places)}),
based as (select doc_id, count(*) as n, min(start) as first_word, max(start) as last_word, list(distinct label) as found from places group by doc_id),
paired as (select doc_id, place, a || ' ' || b as pair
           from (select doc_id, unnest(w) as a, unnest(w[2:]) as b, unnest(range(len(w))) as place from worded)),
known(notice, label, need, span, pairs) as (values {known}),
known_pairs as (select notice, span, unnest(pairs) as pair from known),
hits as (select doc_id, notice, span, place, pair from paired join known_pairs using (pair)),
windows as (select a.doc_id, a.notice, a.place, count(distinct b.pair) as held
            from (select distinct doc_id, notice, span, place from hits) a
            join hits b on b.doc_id = a.doc_id and b.notice = a.notice and b.place >= a.place and b.place < a.place + a.span
            group by a.doc_id, a.notice, a.place),
met as (select doc_id, label, held / len(pairs) as share from windows join known using (notice) where held >= need),
noted as (select doc_id, list(distinct label) as found, max(share) as share from met group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(b.n, 0) as n_base, b.first_word, b.last_word,
       coalesce(array_to_string(list_sort(b.found), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(m.found, [])))), ','), '') as labels,
       case when b.n > 0 then 1.0 else coalesce(m.share, 0.0) end as score
from worded d left join based b on b.doc_id = d.doc_id left join noted m on m.doc_id = d.doc_id
"""
