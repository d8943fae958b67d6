"""Personal data by weak supervision, with SQL functions alone.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.
Looser candidates (number groups, spelled-out addresses, titled names) are voted
on by four labelers: regex shape, gazetteer cues in the words before, context of
the neighbouring characters, and the check digit.  Each votes yes, no or abstains.
The counts of the vote patterns over all texts are a small table (at most 81
patterns times the feature classes); expectation-maximisation on it estimates the
reliability of each labeler, of its votes alone, and the posterior of each pattern,
and a logistic regression of those posteriors on votes and shape features is the span
classifier.  The spans it adds are of the kinds ``number``, ``address`` and ``name``.

The texts are searched once (:func:`searched`); learning and judging read what was found.
Patterns and span lists take time in proportion to a text and its matches.

Edge cases: a null text is the empty string.  Rows are judged one by one, so
repeated rows, repeated ids and extra columns change nothing; an empty table, or
one without candidates, learns nothing and adds no span.  Spans the classifier
adds never touch a base span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import find_spans, joined, let, replaced, tagged, touching

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Atomic forms of them that find the same matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser shapes that are only candidates.
NUMBER = r"(?<![A-Za-z0-9+/_=.-])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+"
SPELLED = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[(\[{](?:at|AT)[)\]}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{](?:dot|DOT)[)\]}]\x20?)[A-Za-z0-9-]++)++"
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
TITLED = rf"\b(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?"
# Gazetteers of cue words before a span.
CUES_YES = ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "contact", "email", "mail", "ssn", "card", "visa", "account", "iban", "passport", "telefon", "handy", "kontakt", "téléphone", "teléfono", "móvil")
CUES_NO = ("version", "isbn", "issn", "order", "issue", "page", "figure", "section", "article", "release", "build", "commit", "revision", "chapter", "seite", "número", "página")
LABELERS = ("regex", "gazetteer", "context", "digits")
#: Kinds of the spans that the classifier adds, by shape.
ADDED = ("number", "address", "name")
ABSTAIN, NO, YES = 0, 1, 2


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the check-digit rule."""

    def part(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, c.cast("int")).otherwise(twice % 10 + F.floor(twice / 10).cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans by kind, as listed."""
    ip = find_spans(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))
    card = find_spans(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"))
    phone = find_spans(text, PHONE, F.contains(text, F.lit("+")))
    low = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return {
        "email": find_spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(ip, lambda x: F.forall(F.split(x["m"], r"\."), lambda p: (F.length(low(p)) <= 3) & (F.substring(low(p), 1, 3).cast("int") <= 255))),
        "card": F.filter(card, lambda x: F.length(_digits(x["m"])).between(14, 19) & F.when(F.length(_digits(x["m"])) <= 19, luhn(_digits(x["m"]))).otherwise(F.lit(False))),
        "phone": F.filter(phone, lambda x: F.length(_digits(x["m"])).between(10, 15)),
    }


def _candidates(text: Column, base: Column) -> Column:
    """Candidate spans with their votes, shape features, and whether they touch a base span."""
    found = find_spans(text, f"{SPELLED}|{TITLED}|{NUMBER}", text.rlike(rf"[0-9][\x20()./-]{{0,2}}[0-9][\x20()./-]{{0,2}}[0-9]|[(\[{{](?:at|AT)[)\]}}]|(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}"))
    found = F.filter(found, lambda x: x["m"].rlike(r"^\p{Lu}|[(\[{](?:at|AT)") | ~x["after"].rlike("^[A-Za-z0-9_]"))
    words = lambda names: "|".join(names)

    def one(x: Column, hit: Column) -> Column:
        m, d = x["m"], _digits(x["m"])
        near = F.lower(F.right(x["before"], F.lit(40)))
        left, right = F.right(x["before"], F.lit(1)), F.substring(x["after"], 1, 1)
        shape = F.when(m.rlike(r"[(\[{](?:at|AT)"), F.lit(1)).when(m.rlike(r"^\p{Lu}"), F.lit(2)).otherwise(F.lit(0))
        strict = m.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$") | m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
        dull = m.rlike(r"^(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}") | m.rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}") | d.rlike(r"^([0-9])\1*$")
        n = F.length(d)
        votes = {
            "regex": F.when((shape == 1) | hit | strict, YES).when((shape == 0) & dull, NO).otherwise(ABSTAIN),
            "gazetteer": F.when((shape == 2) | near.rlike(rf"\b(?:{words(CUES_YES)})\b"), YES).when(near.rlike(rf"\b(?:{words(CUES_NO)})\b"), NO).otherwise(ABSTAIN),
            "context": F.when(left.rlike(r"[#$€£%*=/\\<>&|]") | right.rlike(r"[#$€£%*=/\\<>&|]"), NO).when(near.rlike(r"[:(]\s*$"), YES).otherwise(ABSTAIN),
            "digits": F.when(shape != 0, ABSTAIN).when(n.between(12, 19) & F.when(n <= 19, luhn(d)).otherwise(F.lit(False)), YES).when(n > 11, NO).otherwise(ABSTAIN),
        }
        width = F.when(shape != 0, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 20, 4).otherwise(5)
        parts = F.when(shape != 0, 0).when(m.rlike("[^0-9]"), 1).otherwise(0)
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), hit.alias("hit"), *[v.cast("int").alias(k) for k, v in votes.items()], shape.cast("int").alias("shape"), width.cast("int").alias("width"), parts.cast("int").alias("parts")
        )

    return let(found, lambda xs: F.transform(F.arrays_zip(xs.alias("x"), touching(xs, base).alias("hit")), lambda r: one(r["x"], r["hit"])))


FEATURES = {**dict.fromkeys(LABELERS, 3), "shape": 3, "width": 6, "parts": 2}


@dataclass
class Classifier:
    """Log-odds by feature value; ``reliability`` has the share of each labeler's votes that are right."""

    intercept: float
    weights: dict[str, list[float]]
    reliability: dict[str, float]


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 60, prior: tuple[float, float] = (9.0, 1.0)) -> tuple[np.ndarray, list[float]]:
    """Posterior of each vote pattern and how often each labeler's votes are right, by expectation-maximisation.

    A labeler is right as often on either class, so that one which only ever says yes is
    still evidence; ``prior`` counts as votes that were right and wrong.  Either class is
    as likely before the votes, for most labelers speak on one only.  An abstention says
    nothing in either step.
    """
    yes, no = (votes == YES).sum(1), (votes == NO).sum(1)
    q = 0.1 + 0.8 * (yes + 0.5) / (yes + no + 1.0)
    right = [0.0] * votes.shape[1]
    for _ in range(rounds):
        log = np.zeros(len(q))
        for j in range(votes.shape[1]):
            said = np.select([votes[:, j] == YES, votes[:, j] == NO], [1, -1], 0)
            agreed = np.select([said > 0, said < 0], [q, 1 - q], 0.0)
            right[j] = float(((n * agreed).sum() + prior[0]) / (n[said != 0].sum() + sum(prior)))
            log += said * math.log(right[j] / (1 - right[j]))
        q = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return q, right


def searched(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) with the ``base`` spans by kind and the candidates, ``maybe``, of each row's text."""
    keep = keep or ["doc_id"]
    rows = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", F.struct(*[F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k, c in base_spans(F.col("text")).items()]))
    rows = rows.withColumn("maybe", _candidates(F.col("text"), F.concat(*[F.col(f"base.{k}") for k in KINDS])))
    return rows.select(F.struct(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)]).alias("row"), "base", "maybe")


def learn(found: DataFrame, rounds: int = 3000, decay: float = 1e-3) -> Classifier | None:
    """The span classifier from the candidates of all rows of :func:`searched`; None if there is none."""
    table = found.select(F.explode("maybe").alias("x")).groupBy(*[F.col(f"x.{k}").alias(k) for k in FEATURES]).count().collect()
    if not table:
        return None
    table.sort(key=tuple)
    x = np.array([[r[k] for k in FEATURES] for r in table])
    n = np.array([r["count"] for r in table], float)
    y, reliability = reliabilities(x[:, : len(LABELERS)], n)
    hot = np.concatenate([np.eye(size)[x[:, j]] for j, size in enumerate(FEATURES.values())], axis=1)
    w, b, share = np.zeros(hot.shape[1]), 0.0, n / n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(hot @ w + b)))
        g = share * (p - y)
        w -= 0.5 * (hot.T @ g + decay * w)
        b -= 0.5 * g.sum()
    weights, at = {}, 0
    for k, size in FEATURES.items():
        weights[k] = [round(float(v), 6) for v in w[at : at + size]]
        at += size
    return Classifier(round(float(b), 6), weights, dict(zip(LABELERS, reliability, strict=True)))


def find(found: DataFrame, model: Classifier | None, least: float = 0.8) -> DataFrame:
    """``row``, arrays of base spans by kind, and ``pii``: what the classifier adds at ``least``, of the ADDED kinds."""

    def good(x: Column) -> Column:
        odds = F.lit(model.intercept)
        for k, w in model.weights.items():
            odds = odds + F.element_at(F.array(*[F.lit(v) for v in w]), x[k] + 1)
        return ~x["hit"] & (odds >= math.log(least / (1 - least)))

    more = F.filter("maybe", good if model else lambda x: F.lit(False))
    named = F.array(*[F.lit(k) for k in ADDED])
    more = F.transform(more, lambda x: F.struct(x["s"].alias("s"), (x["shape"] + len(KINDS)).alias("o"), x["e"].alias("e"), F.element_at(named, x["shape"] + 1).alias("k")))
    return found.select("row", *[F.col(f"base.{k}").alias(k) for k in KINDS], more.alias("pii"))


def _tagged_base() -> Column:
    return F.concat(*[tagged(F.col(k), i, k) for i, k in enumerate(KINDS)])


def digest(spans: DataFrame) -> DataFrame:
    """The columns of the contract from :func:`find`'s."""
    rows = spans.select("row.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], _tagged_base().alias("base"), F.col("pii").alias("more"))
    return rows.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_pii")
    )


def redacted(spans: DataFrame) -> DataFrame:
    """The kept columns of :func:`searched`, ``text`` among them, with each span in the text replaced by its kind in brackets.

    Where spans overlap, the first names them.  A null text stays null.
    """
    clean = replaced(F.col("row.text"), F.concat(_tagged_base(), "pii"))
    return spans.select(*[clean.alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in spans.schema["row"].dataType.names])
