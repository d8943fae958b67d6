"""URL filtering with SQL functions alone: rules first, then a logistic regression.

The model sees hashed character 3- to 5-grams of host and path.  It is trained on
a small labelled table of URLs (host, path, blocked), which may come from anywhere; its
weights are one array literal in the scoring expression.  Where there is no such table,
:func:`labelled` makes one from the URLs that the rules decide, so that the model carries
the rules' verdicts over to URLs that look like theirs.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is judged by the model on these empty strings.  Rows are judged one
by one, and the labelled table holds each URL once, so repeated rows, ids (null ones
too) and extra columns change nothing; ties of rules can't occur, as two rules of one
length that fit one url are the same.  Without a labelled row the model allows
everything.  The time follows the length of a URL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let

# Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SLOTS = 2048
SIZES = (3, 4, 5)


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parsed(pages: DataFrame, keep: list[str], rules: tuple = RULES) -> DataFrame:
    rows = pages.select(*keep, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))


def slots(host: Column, path: Column) -> Column:
    """Slots of the distinct hashed n-grams of host and path; the ends are marked."""

    def grams(part: Column, tag: str, n: int) -> Column:
        def cut(chars: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(f"{tag}{n}"), F.array_join(F.slice(chars, i, F.lit(n)), "")), F.lit(SLOTS)).cast("int"))

        return let(F.split(F.concat(F.lit("^"), part, F.lit("$")), ""), cut)

    return F.array_distinct(F.concat(*[grams(host, "h", n) for n in SIZES], *[grams(path, "p", n) for n in SIZES]))


@dataclass
class Model:
    intercept: float = 0.0
    weights: list[float] = field(default_factory=lambda: [0.0] * SLOTS)


def labelled(pages: DataFrame, rows: int, rules: tuple = RULES) -> DataFrame:
    """(host, path, blocked) of ``rows`` distinct URLs that a rule decides, those of the lowest hashes."""
    urls = parsed(pages, [], rules).where("fit is not null").select("host", "path", (F.col("fit.verdict") == "block").alias("blocked")).distinct()
    return urls.orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows)


def train(labelled: DataFrame, rows: int, rounds: int = 800, decay: float = 1e-4) -> Model:
    """A model from (host, path, blocked), which must have at most ``rows`` rows."""
    table = labelled.select(F.col("blocked").cast("int").alias("y"), F.array_sort(slots(F.col("host"), F.col("path"))).alias("x")).limit(rows + 1).collect()
    if len(table) > rows:
        raise ValueError(f"the labelled table has over {rows} rows")
    if not table:
        return Model(intercept=-1.0)
    table.sort(key=lambda r: (r["x"], r["y"]))
    x = np.zeros((len(table), SLOTS))
    for i, r in enumerate(table):
        x[i, r["x"]] = 1 / np.sqrt(len(r["x"]))
    y = np.array([r["y"] for r in table], float)
    w, b = np.zeros(SLOTS), 0.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= 2.0 * (x.T @ g / len(y) + decay * w)
        b -= 2.0 * g.mean()
    return Model(round(float(b), 6), [round(float(v), 6) for v in w])


def judge(pages: DataFrame, model: Model, keep: list[str] | None = None, rules: tuple = RULES) -> DataFrame:
    """``keep`` columns (page_id) with host, path, rule, verdict, and ``score``, the model's probability of a block."""
    rows = parsed(pages, keep or ["page_id"], rules)
    weights = F.split(F.lit(",".join(map(str, model.weights))), ",").cast("array<double>")
    found = slots(F.col("host"), F.col("path"))
    odds = F.aggregate(found, F.lit(0.0), lambda acc, i: acc + F.element_at(weights, i + 1)) / F.sqrt(F.size(found).cast("double")) + F.lit(model.intercept)
    rows = rows.withColumn("score", F.round(1 / (1 + F.exp(-odds)), 6))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return rows.select(*(keep or ["page_id"]), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
