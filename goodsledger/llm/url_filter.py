"""URL filter: longest host/path rule first, then a weighted vocabulary.

Rules name a host and the start of a path; the longest that fits decides. Other urls are scanned once with an
Aho-Corasick automaton over the vocabulary. A hit counts when no letter or digit touches it. One strict term,
or ``soft_limit`` different soft terms, block the url.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.llm.common import in_arrow, quoted

# Default vocabulary.
STRICT = ("porn", "porno", "xxx", "hentai", "warez", "casino", "jackpot", "spam-farm", "payday-loan", "cheap-pills")
SOFT = ("adult", "bet", "bonus", "cheap", "crack", "deal", "farm", "free", "loan", "nude", "pills", "poker", "sex",
        "slots", "spam", "torrent", "viagra", "win")
SOFT_LIMIT = 2
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for weight, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            built.add_word(term, (term, weight))
    built.make_automaton()
    return built


def term_hits(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """The different strict and soft terms in a url, in order."""
    text = url.translate(LOWER)
    found = {"strict": set(), "soft": set()}
    for end, (term, weight) in automaton(strict, soft).iter(text):
        before, after = end - len(term), end + 1
        if not (before >= 0 and text[before] in WORD) and not (after < len(text) and text[after] in WORD):
            found[weight].add(term)
    return sorted(found["strict"]), sorted(found["soft"])


LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def url_verdicts(
    pages: DataFrame, id_col="page_id", url_col="url", *, rules=RULES, strict=STRICT, soft=SOFT, soft_limit=SOFT_LIMIT
) -> DataFrame:
    """Per row: id, host, path, rule (or null), verdict, strict_terms and soft_terms (comma-joined).

    A null url, or one without ``://``, has an empty host and path and is judged by its terms; null has none.
    Null ids and repeated rows stay as they are. Further columns are ignored. No shuffle.
    """
    url = F.col(quoted(url_col)).cast("string")
    host, path = host_and_path(url)
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(quoted(id_col)).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule.alias("rule"), said.alias("said"))
    strict, soft = tuple(strict), tuple(soft)

    def run(batches):
        for batch in batches:
            hits = [term_hits(u or "", strict, soft) for u in batch.column("url").to_pylist()]
            kept = {name: batch.column(name) for name in ("id", "host", "path", "rule", "said")}
            yield pa.RecordBatch.from_pydict(
                kept | {"strict": pa.array([h[0] for h in hits], LIST), "soft": pa.array([h[1] for h in hits], LIST)}
            )

    kind = rows.schema["id"].dataType.simpleString()
    judged = in_arrow(
        rows, run, f"id {kind}, host string, path string, rule string, said string, strict array<string>, soft array<string>"
    )
    blocked = (F.size("strict") > 0) | (F.size("soft") >= soft_limit)
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("said", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.array_join("strict", ",").alias("strict_terms"), F.array_join("soft", ",").alias("soft_terms"),
    )


LIST = pa.list_(pa.string())


def verdict_sql(rules=RULES, strict=STRICT, soft=SOFT, soft_limit=SOFT_LIMIT) -> str:
    """The same over a table ``pages`` for the checking engine, from the same settings."""

    def hits(terms):
        tests = ", ".join(
            f"case when regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') then '{t}' end" for t in sorted(terms)
        )
        return f"list_filter([{tests}], lambda x: x is not null)"

    fits = []
    for text, said in rules:
        name, slash, start = text.partition("/")
        fits.append(
            f"select page_id, {len(text)} as size, '{text}' as rule, '{said}' as said from parts "
            f"where (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash}{start}')"
        )
    return f"""
with behind as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from behind
), fits as ({" union all ".join(fits)}),
best as (select page_id, arg_max(rule, size) as rule, arg_max(said, size) as said from fits group by page_id),
terms as (select page_id, host, path, {hits(strict)} as strict, {hits(soft)} as soft from parts)
select t.page_id, host, path, rule,
       coalesce(said, case when len(strict) > 0 or len(soft) >= {soft_limit} then 'block' else 'allow' end) as verdict,
       coalesce(array_to_string(strict, ','), '') as strict_terms, coalesce(array_to_string(soft, ','), '') as soft_terms
from terms t left join best b on t.page_id = b.page_id
"""
