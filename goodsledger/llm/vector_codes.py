"""Vector codes: parts of integer vectors, each named by the nearest entry of its position's codebook.

Codebooks are fitted by rounds of nearest entry and mean. After the first full search a part keeps, in the stored
table, its ``near`` closest entries with ordered lower bounds of their distances and one outer bound for all other
entries. When entries move, the bounds are loosened by the movements; only entries whose bound does not exceed the
distance to the part's own entry are measured again, in integers, and only where the outer bound fails are all
measured. The list is shortened to what the last round needed. Bounds are rounded downwards and own distances
upwards, so they only decide what need not be measured; equal distances go to the lower index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.llm.common import ID, in_arrow, quoted, store

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries a part lists at first: an eighth of the codebook.
NEAR = 8
#: Integer components beyond this count as this, so that squared distances stay exact.
MOST = 1 << 24
MARGIN = 1e-9
#: Rows measured at a time.
CHUNK = 2048
#: Rows of a label's sum, so that one label's rows do not meet in one task.
SALTS = 16
STATE = f"{ID} {{id}}, label {{label}}, x array<int>, near binary, low binary"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """_id, label, x of the rows whose vector has ``parts`` equal parts of finite components."""
    rows = vectors.select(
        F.col(quoted(id_col)).alias(ID),
        F.col(quoted(label_col)).alias("label"),
        F.col(quoted(vec_col)).cast("array<double>").alias("v"),
    )
    sound = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & sound)

    def whole(c):
        floors = F.floor(F.lit(float(scale)) * F.greatest(F.least(c, F.lit(1e9)), F.lit(-1e9)))
        return F.greatest(F.least(floors, F.lit(MOST)), F.lit(-MOST)).cast("int")

    return rows.select(ID, "label", F.transform("v", whole).alias("x"))


def starts(rows: DataFrame, entries: int) -> tuple[DataFrame, np.ndarray]:
    """The rows as long as the first one, and the vectors of the smallest ids (nulls last, ties by components)."""
    first = lambda df: [r["x"] for r in df.orderBy(F.col(ID).asc_nulls_last(), "x").limit(entries).select("x").collect()]
    found = first(rows)
    if len(set(map(len, found))) > 1:
        rows = rows.where(F.size("x") == len(found[0]))
        found = first(rows)
    elif found:
        rows = rows.where(F.size("x") == len(found[0]))
    return rows, np.array(found, dtype=np.int64)


def down16(values: np.ndarray) -> np.ndarray:
    """The nearest half-precision numbers that are not larger."""
    half = np.clip(values, -65504, 65504).astype(np.float16)
    high = half > values
    half[high] = np.nextafter(half[high], np.float16(-np.inf))
    return half


def squares(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    difference = part - entries
    return np.einsum("...w,...w->...", difference, difference)


def search(part: np.ndarray, book: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full search: the closest entries, lower bounds (all but the own entry's, then the outer one), squared distance."""
    found = squares(part[:, None], book[None])
    order = np.argsort(found, axis=1, kind="stable")[:, : near + 1]
    exact = np.take_along_axis(found, order, 1)
    low = np.full((len(part), near), np.inf)
    low[:, : order.shape[1] - 1] = np.sqrt(exact[:, 1:]) * (1 - MARGIN)
    return order[:, :near].astype(np.uint8), down16(low), exact[:, 0]


def refine(part, near, low, book, moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``search`` by the bounds of the last round; the last value is the number of entries measured per row."""
    near, low = near.copy(), low.astype(np.float64)
    best = squares(part, book[near[:, 0]])
    reach = np.sqrt(best) * (1 + MARGIN)
    low[:, :-1] -= moved[near[:, 1:]]
    low[:, -1] -= moved.max()
    measured = (low[:, :-1] <= reach[:, None]).sum(1)
    outside = low[:, -1] <= reach
    some = np.flatnonzero((measured > 0) & ~outside)
    if len(some):
        listed, doubtful = near[some], np.ones((len(some), near.shape[1]), dtype=bool)
        doubtful[:, 1:] = low[some, :-1] <= reach[some, None]
        exact = squares(part[some, None], book[listed])
        exact = np.where(doubtful, exact, np.iinfo(np.int64).max)
        order = np.lexsort((listed, exact), axis=1)
        bounds = np.concatenate([np.zeros((len(some), 1)), low[some, :-1]], axis=1)
        bounds = np.where(doubtful, np.sqrt(exact.astype(np.float64)) * (1 - MARGIN), bounds)
        near[some] = np.take_along_axis(listed, order, 1)
        low[some, :-1] = np.take_along_axis(bounds, order, 1)[:, 1:]
        best[some] = np.take_along_axis(exact, order[:, :1], 1)[:, 0]
    order = np.argsort(low[:, :-1], axis=1, kind="stable")
    low[:, :-1], near[:, 1:] = np.take_along_axis(low[:, :-1], order, 1), np.take_along_axis(near[:, 1:], order, 1)
    low = down16(low)
    if outside.any():
        near[outside], low[outside], best[outside] = search(part[outside], book, near.shape[1])
    return near, low, best, np.where(outside, near.shape[1], measured)


def shortened(near: np.ndarray, low: np.ndarray, measured: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists cut to the entries that nearly all rows needed; what is cut falls under the outer bound."""
    keep = int(np.clip(np.percentile(measured, 98) + 2, 2, near.shape[-1]))
    if keep == near.shape[-1]:
        return near, low
    outer = low[..., keep - 1 :].min(-1, keepdims=True)
    return near[..., :keep], np.concatenate([low[..., : keep - 1], outer], axis=-1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def blobs(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray | None, near: int) -> DataFrame:
    """The state after a search in ``books``: full where there are no bounds yet (``moved`` is None)."""
    sent = state.sparkSession.sparkContext.broadcast((books, moved))
    fields = state.schema
    schema = STATE.format(id=fields[ID].dataType.simpleString(), label=fields["label"].dataType.simpleString()) + ", error long"

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        books, moved = sent.value
        count, n = len(books), batch.num_rows
        x = matrix(batch.column("x")).reshape(n, count, -1)
        if moved is None:
            found = [search(x[:, p], books[p], min(near, books.shape[1])) for p in range(count)]
            closest, low = np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)
        else:
            old = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint8).reshape(n, count, -1)
            bounds = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.float16).reshape(old.shape)
            found = [refine(x[:, p], old[:, p], bounds[:, p], books[p], moved[p]) for p in range(count)]
            closest, low = shortened(np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), np.stack([f[3] for f in found], 1))
        made = {"near": blobs(closest), "low": blobs(low), "error": pa.array(sum(f[2] for f in found))}
        return pa.RecordBatch.from_pydict({name: batch.column(name) for name in (ID, "label", "x")} | made)

    def run(batches):
        for batch in batches:
            sizes = np.zeros(batch.num_rows, int) if moved is None else np.array([len(v) for v in batch.column("near").to_pylist()], int)
            for size in np.unique(sizes):
                same = batch.filter(pa.array(sizes == size))
                for start in range(0, same.num_rows, CHUNK):
                    yield piece(same.slice(start, CHUNK))

    return in_arrow(state, run, schema)


def own_entries(parts: int) -> Column:
    """Two hex digits for the first listed entry of each part."""
    width = f"(length(near) div {parts})"
    return F.expr(f"array_join(transform(sequence(0, {parts - 1}), p -> hex(substring(near, cast(p * {width} + 1 as int), 1))), '')")


def means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks. Sums and counts per entry are formed in each task; one number per component reaches the driver."""
    count, entries, width = books.shape

    def run(batches):
        sums = np.zeros((count, entries, width + 1), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x")).reshape(batch.num_rows, count, width)
            own = np.array([list(v) for v in batch.column("near").to_pylist()], dtype=np.int64).reshape(batch.num_rows, count)
            for p in range(count):
                np.add.at(sums[p, :, :width], own[:, p], x[:, p])
                sums[p, :, width] += np.bincount(own[:, p], minlength=entries)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"place": pa.array(used), "total": pa.array(sums.reshape(-1)[used])})

    rows = state.select("x", F.unhex(own_entries(count)).alias("near"))
    sums = np.zeros(count * entries * (width + 1), dtype=np.int64)
    for row in in_arrow(rows, run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
        sums[row["place"]] = row["total"]
    sums = sums.reshape(count, entries, width + 1)
    filled = sums[..., width:] > 0
    return np.where(filled, sums[..., :width] // np.maximum(sums[..., width:], 1), books)


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", *, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, near=NEAR
) -> DataFrame:
    """Per row: id, code (two hex digits per part), error, label_error (summed over equal labels), codebooks_sha256.

    Rows whose vector is null, empty, not divisible into ``parts``, of another length than the first id's, or holds
    a null or non-finite component are left out. Null ids are coded and come last when entries are started;
    repeated rows are coded each, and of equal ids the smaller vector comes first. Fewer rows than ``entries``
    give as many entries. Integer components beyond ``MOST`` count as ``MOST``. An empty table gives no rows.
    """
    rows, first = starts(integer_vectors(vectors, id_col, vec_col, label_col, parts=parts), entries)
    if not len(first):
        return rows.select(
            F.col(ID).alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"),
        )
    books = first.reshape(len(first), parts, -1).swapaxes(0, 1).copy()
    state, moved = rows, None
    for _ in range(rounds):
        state = store(assigned(state, books, moved, near).drop("error"), "vector-bounds")
        fresh = means(state, books)
        moved = np.sqrt(squares(fresh, books)) * (1 + MARGIN)
        books = fresh
    final = store(assigned(state, books, moved, near).select(ID, "label", F.lower(own_entries(parts)).alias("code"), "error"), "vector-codes")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sums = final.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", salt.alias("salt"))
    joined = final.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.pmod(F.xxhash64(ID, "code"), F.lit(SALTS))))
    return joined.select(F.col(ID).alias(id_col), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same codes by plain searches over all entries."""
    search = """assign{r} as (
  select n, p, v, best % {k} as e, best // {k} as d from (
    select p.n, p.p, any_value(p.v) as v,
           min(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * {k} + b.e) as best
    from parts p join book{r} b using (p) group by p.n, p.p))"""
    update = """sums{r} as (
  select p, e, i, sum(c) as total, count(*) as m from (select p, e, unnest(v) as c, unnest(range(len(v))) as i from assign{r}) group by p, e, i),
means{r} as (select p, e, list(((total - ((total % m) + m) % m) // m)::bigint order by i) as v from sums{r} group by p, e),
book{s} as (select b.p, b.e, coalesce(m.v, b.v) as v from book{r} b left join means{r} m using (p, e))"""
    steps = []
    for r in range(rounds):
        steps += [search.format(r=r, k=entries), update.format(r=r, s=r + 1)]
    steps.append(search.format(r=rounds, k=entries))
    return f"""
with whole as (
  select row_number() over (order by vec_id nulls last, embedding) - 1 as n, vec_id, label,
         list_transform(embedding, lambda c: floor({scale} * c::double)::bigint) as x
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
parts as (
  select n, p, list_slice(x, p * (len(x) // {parts}) + 1, (p + 1) * (len(x) // {parts})) as v
  from whole, (select unnest(range({parts})) as p)),
book0 as (select p, n as e, v from parts where n < {entries}),
{",".join(steps)},
coded as (
  select n, string_agg(printf('%02x', e::int), '' order by p) as code, sum(d)::bigint as error from assign{rounds} group by n),
books as (
  select sha256(string_agg(c::varchar, ',' order by p, e, i)) as codebooks_sha256
  from (select p, e, unnest(v) as c, unnest(range(len(v))) as i from book{rounds}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from whole join coded using (n), books
"""
