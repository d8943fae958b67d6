"""Queries of those parts of the operators that SQL can say, with their DuckDB SQL.

Each calls the operator's own functions over its whole table and leaves out the columns
that a model decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, quality, secret_scan, url_filter
from .common import table


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets by kind, and the characters of the hex ones."""
    found = secret_scan.searched(table(spark, sf_dir, "documents"))
    chars = F.aggregate("hex", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], chars.alias("hex_chars"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base personal data by kind."""
    found = pii.searched(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS])


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the rules, and whether a rule fails the text."""
    return quality.statistics(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, quality.failed().alias("base_failed"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, and the rule's part of the verdict."""
    return url_filter.parsed(table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("rule_verdict"))


QUERIES = {f.__name__: f for f in (secret_counts, pii_counts, quality_counts, url_rules)}

_KEYWORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"


def _case(value) -> str:
    """The longest rule that fits, as SQL; ``value`` makes a rule's outcome."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    return "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{value(v, h, p)}'" for v, h, p in rules) + " end"


ORACLES = {
    "secret_counts": f"""
with d as (select doc_id, coalesce(text, '') as text from documents), m as (
  select doc_id,
    len(list_filter(regexp_extract_all(text, '({_KEYWORDS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) as n_assign,
    len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as n_access,
    list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24) as hex
  from d
)
select doc_id, n_assign, n_access, len(hex) as n_hex, cast(coalesce(list_sum(list_transform(hex, lambda x: length(x))), 0) as bigint) as hex_chars from m
""",
    "pii_counts": """
with d as (select doc_id, coalesce(text, '') as text from documents), m as (
  select doc_id,
    len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) as n_email,
    len(list_filter(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: try_cast(p as hugeint))) <= 255 and len(list_filter(string_split(x, '.'), lambda p: try_cast(p as hugeint) is null)) = 0)) as n_ip,
    list_filter(list_transform(regexp_extract_all(text, '[0-9]([\\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) between 14 and 19) as cards,
    len(list_filter(list_transform(regexp_extract_all(text, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) between 10 and 15)) as n_phone
  from d
)
select doc_id, n_email, n_ip,
  len(list_filter(cards, lambda c: list_sum(list_transform(range(length(c)), lambda i: case when i % 2 = 0 then cast(c[length(c) - i] as int) else (2 * cast(c[length(c) - i] as int)) // 10 + (2 * cast(c[length(c) - i] as int)) % 10 end)) % 10 = 0)) as n_card,
  n_phone
from m
""",
    "quality_counts": """
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents), w as (
  select row, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d
), g as (
  select row, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] as gram from (select row, words, unnest(range(1, len(words) - 1)) as i from w)
), again as (
  select row, i from (select *, count(*) over (partition by row, gram) as n from g) where n > 1
), inside as (
  select row, count(distinct i + k) as n from again, (values (0), (1), (2)) as t(k) group by row
), c as (
  select doc_id, len(words) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(inside.n, 0) as n_repeat_words
  from w left join inside using (row)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c
""",
    "url_rules": f"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages
)
select *, {_case(lambda v, h, p: h + p)} as rule, {_case(lambda v, h, p: v)} as rule_verdict from u
""",
}
