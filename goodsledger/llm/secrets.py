"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds (``assign``, ``access``, ``hex``) are reported wherever they stand. Weak kinds - access names,
secret-like values and endpoints, each too common to report alone - are reported only when the complementary
part stands within the same scope, ``SCOPE`` code points: an access name beside a secret, a secret beside an
access name or identifier, an endpoint beside both. Parts meet in an interval join: scopes are cut into cells,
a weak part is copied to the cells its scope touches, a complementary part to the cells it covers itself, and
equal cells are joined. A cell holds as many parts as fit into its width, so no join grows with a long text.

Spans depend on the text alone, so they are found once per distinct text (SHA-256) and joined back to all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goodsledger.llm.common import ID, TEXT, intake, packed_rows, store

SCOPE = 240


@dataclass(frozen=True)
class Kind:
    """``pattern`` without look-around; ``least``: length of the match, or of ``group``, from which it counts.

    ``marks``: any match holds one of these texts, which are faster to look for than the pattern.
    """

    name: str
    pattern: str
    role: str
    least: int = 0
    group: int = 0
    weak: bool = False
    marks: tuple[str, ...] = ()

    def possible(self, text: Column) -> Column:
        """Whether the text has a match."""
        found = text.rlike(self.pattern)
        return reduce(lambda a, b: a | b, [text.contains(mark) for mark in self.marks]) & found if self.marks else found


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: Between a name and its value.
GIVES = r"""["']?\x20*[:=]\x20*["']?"""
# Fixed patterns of the base kinds, in order of report.
BASE = (
    Kind("assign", f"({either_case('password|passwd|secret|token|api_?key')}){GIVES}([A-Za-z0-9+/_.=-]+)", "secret", 6, 2, marks=(":", "=")),
    Kind("access", "AKIA[A-Z0-9]+", "access", 20, marks=("AKIA",)),
    Kind("hex", "[0-9a-f]{24,}", "secret"),  # the same runs as of one and more, without the many short ones
)
WEAK = (
    Kind("weak_access", f"({either_case('access_?key_?id|client_?id|user_?name|user|login|account')}){GIVES}([A-Za-z0-9@._-]+)",
         "access", 3, 2, True, (":", "=")),
    Kind("weak_secret", f"({either_case('pass|pwd|access_?key|private_?key|credential|auth')}){GIVES}([A-Za-z0-9+/_.=-]+)",
         "secret", 6, 2, True, (":", "=")),
    Kind("weak_endpoint", r"[a-z][a-z0-9+]{0,19}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", "endpoint", 10, 0, True, ("://",)),
)
# An endpoint's scheme has at most 20 characters, so that a long run of letters is not read again from each of them.
KINDS = (*BASE, *WEAK)
#: Other roles that must all stand in the scope of a weak part.
NEEDS = {"access": ("secret",), "secret": ("access",), "endpoint": ("access", "secret")}
NOTHING = "array<struct<kind:int,gap:int,size:int,counts:boolean>>"


def matches(text: Column, number: int, kind: Kind) -> Column:
    """Per match, leftmost and non-overlapping: code points between it and the one before, its length, if it counts.

    Splitting by the pattern gives the texts between the matches, in the same order.
    """
    pattern = F.lit(f"({kind.pattern})")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, kind.pattern, -1)
    value = (lambda m: F.regexp_extract(m, kind.pattern, kind.group)) if kind.group else (lambda m: m)
    each = F.zip_with(
        F.slice(between, 1, F.size(found)),
        found,
        lambda gap, m: F.struct(
            F.lit(number).alias("kind"), F.length(gap).alias("gap"), F.length(m).alias("size"),
            (F.length(value(m)) >= kind.least).alias("counts"),
        ),
    )
    return F.when(kind.possible(text), each).otherwise(F.array().cast(NOTHING))


def scanned(rows: DataFrame) -> DataFrame:
    """``rows`` without the text, with ``key`` (SHA-256 of the text) and all matches of all kinds."""
    found = F.concat(*[matches(F.col(TEXT), n, kind) for n, kind in enumerate(KINDS)])
    return rows.withColumn("key", F.sha2(TEXT, 256)).withColumn("found", found).drop(TEXT)


def parts_of(marks: DataFrame) -> DataFrame:
    """(key, kind, start, end) of the counting matches of each distinct text. Ends are exclusive."""
    texts = marks.where(F.size("found") > 0).groupBy("key").agg(F.first("found").alias("found"))
    rows = texts.select("key", F.posexplode("found").alias("nth", "m")).select("key", "nth", "m.*")
    before = Window.partitionBy("key", "kind").orderBy("nth")
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    return ends.where("counts").select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def kinds_where(test) -> list[int]:
    return [n for n, kind in enumerate(KINDS) if test(kind)]


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts whose complementary roles all stand within ``scope`` code points, none overlapping it."""
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    cover = F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))
    found = None
    for role, needs in NEEDS.items():
        weak = parts.where(F.col("kind").isin(kinds_where(lambda k, role=role: k.weak and k.role == role)))
        for need in needs:
            others = parts.where(F.col("kind").isin(kinds_where(lambda k, need=need: k.role == need)))
            others = others.select(
                "key", F.explode(cover).alias("cell"), F.col("start").alias("o_start"), F.col("end").alias("o_end")
            )
            near = ((F.col("o_start") >= F.col("end")) & (F.col("o_start") - F.col("end") <= scope)) | (
                (F.col("o_end") <= F.col("start")) & (F.col("start") - F.col("o_end") <= scope)
            )
            reached = weak.withColumn("cell", F.explode(reach)).alias("w")
            beside = reached.join(others.alias("o"), (F.col("w.key") == F.col("o.key")) & (F.col("w.cell") == F.col("o.cell")) & near, "left_semi")
            weak = beside.drop("cell").distinct()
        found = weak if found is None else found.union(weak)
    return found


def listed(spans: Column) -> Column:
    """``kind:start:end`` in order of start, then of kind, comma-joined."""
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    each = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(each, ",")


def spans_by_text(marks: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, spans): the reported spans of each distinct text that has any, in order. Bounded by the text itself."""
    parts = store(parts_of(marks), "secret-parts")
    reported = parts.where(F.col("kind").isin(kinds_where(lambda k: not k.weak))).union(linked(parts, scope))
    span = F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"))
    return reported.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def of_kind(number: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")


def secret_spans(docs: DataFrame, id_col="doc_id", text_col="text", *, scope: int = SCOPE) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans (and the digest of an empty list). Null ids and repeated rows stay as
    they are, further columns are ignored, an empty table gives no rows. Positions are code points.
    """
    marks = store(scanned(intake(docs, id_col, text_col)), "secret-scan")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    rows = marks.select(ID, "key").join(spans_by_text(marks, scope), "key", "left")
    rows = rows.withColumn("spans", F.coalesce("spans", none))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [of_kind(n).alias(f"n_{kind.name}") for n, kind in enumerate(BASE)]
    return rows.select(
        F.col(ID).alias(id_col), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each run of overlapping or touching spans replaced by ``mask``."""
    state = "struct<at:bigint,out:string>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")).cast(state)

    def step(done: Column, span: Column) -> Column:
        clear = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        fresh = (span["start"] > done["at"]) | (done["at"] == 0)
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(done["out"], clear, F.lit(mask))).otherwise(done["out"]).alias("out"),
        ).cast(state)

    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def mask_secrets(
    docs: DataFrame, id_col="doc_id", text_col="text", *, mask="[secret]", size_col: str | None = None, scope: int = SCOPE
) -> DataFrame:
    """All rows with all columns; reported spans in the text become ``mask``, ``size_col`` the text's new length.

    Rows without spans, null texts among them, are unchanged.
    """
    marks = store(scanned(intake(docs, id_col, text_col)).drop(ID).where(F.size("found") > 0), "secret-scan")
    hit = spans_by_text(marks, scope)
    rows = packed_rows(docs, id_col, text_col)
    any_match = reduce(lambda a, b: a | b, [kind.possible(F.col(TEXT)) for kind in KINDS])
    # rows without any match stay where they are: their texts are not shuffled
    clean = rows.where(~any_match).withColumn("spans", F.lit(None).cast(hit.schema["spans"].dataType))
    matched = rows.where(any_match).withColumn("key", F.sha2(TEXT, 256)).join(hit, "key", "left")
    rows = clean.unionByName(matched.drop("key"))
    changed = F.when(F.col("spans").isNull(), F.col("row")[text_col]).otherwise(masked(F.col(TEXT), F.col("spans"), mask))
    rows = rows.withColumn("masked", changed)
    out = []
    for field in docs.schema.fields:
        value = F.col("row")[field.name]
        if field.name == text_col:
            value = F.col("masked")
        elif field.name == size_col:
            value = F.when(F.col("spans").isNull(), value).otherwise(F.length("masked").cast(field.dataType))
        out.append(value.alias(field.name))
    return rows.select(*out)


def spans_sql(scope: int = SCOPE) -> str:
    """The same as ``secret_spans`` over a table ``documents`` for the checking engine; links are sought among all pairs."""

    def text_of(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    found = " union all ".join(
        f"""select t, {n} as kind, i, length(gaps[i]) + length(ms[i]) as step, length(ms[i]) as size,
        length(regexp_extract(ms[i], {text_of(k.pattern)}, {k.group})) >= {k.least} as counts
        from (select t, ms, gaps, unnest(range(1, len(ms) + 1)) as i from
              (select t, regexp_extract_all(t, {text_of(k.pattern)}) as ms, string_split_regex(t, {text_of(k.pattern)}) as gaps from texts))"""
        for n, k in enumerate(KINDS)
    )
    roles = ", ".join(f"({n}, '{k.name}', '{k.role}', {str(k.weak).lower()})" for n, k in enumerate(KINDS))
    needs = ", ".join(f"('{role}', '{need}')" for role, needed in NEEDS.items() for need in needed)
    return f"""
with texts as (select distinct coalesce(text, '') as t from documents),
found as ({found}),
kinds(kind, name, role, weak) as (values {roles}),
needs(role, need) as (values {needs}),
ends as (select *, sum(step) over (partition by t, kind order by i) as "end" from found),
parts as (select t, kind, name, role, weak, "end" - size as start, "end" from ends join kinds using (kind) where counts),
met as (select distinct w.t, w.kind, w.start, w."end", n.need from parts w join needs n using (role) join parts o
        on o.t = w.t and o.role = n.need and (o.start - w."end" between 0 and {scope} or w.start - o."end" between 0 and {scope})
        where w.weak),
linked as (select t, kind, start, "end" from met join kinds using (kind)
           group by t, kind, start, "end", role having count(*) = (select count(*) from needs x where x.role = kinds.role)),
reported as (select t, kind, start, "end", name, kind < {len(BASE)} as base from
             (select t, kind, start, "end" from parts where not weak union all select * from linked) join kinds using (kind)),
by_text as (select t, {", ".join(f"count(*) filter (kind = {n}) as n_{k.name}" for n, k in enumerate(BASE))},
            string_agg(name || ':' || start || ':' || "end", ',' order by start, kind) filter (base) as b,
            string_agg(name || ':' || start || ':' || "end", ',' order by start, kind) as s from reported group by t)
select doc_id, {", ".join(f"coalesce(n_{k.name}, 0) as n_{k.name}" for k in BASE)},
       sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans
from documents left join by_text on by_text.t = coalesce(text, '')
"""
