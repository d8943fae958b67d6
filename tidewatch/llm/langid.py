"""Language identification with interpolated Kneser-Ney character models.

Each language gets an order-4 character model with absolute discounting and
continuation counts below the top order.  The models of all languages live in
one sorted array of n-gram keys per order, with a row of log-probabilities (one
column per language) beside each key.  A text goes to the language with the
lowest cross-entropy per character; a rejection bound on that cross-entropy, a quantile by
language and length class, is calibrated on labelled documents that the models have
not counted, so that a few mixed or mislabelled ones don't move it.

Edge cases: a null text, an empty one, or one with no letter gets ``und``, score
0 and ``rejected``.  Rows are judged one by one, so repeated rows and repeated
ids are kept as they come, ties go to the alphabetically first language, and an
empty table gives an empty result.  Extra columns of the input are ignored by
:func:`predict`; a table without labelled rows gives ``und`` for every text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4
DISCOUNT = 0.75
UND = "und"
#: Characters that are worked on at once, so that memory doesn't follow the length of a text.
CHUNK = 1 << 19
#: Length classes, in characters, of the rejection bounds; the quantile of the labelled gaps, and the least documents of a class that have one of their own.
CLASSES = (50, 200, 1000)
QUANTILE, CLASS_DOCS = 0.98, 50
#: A bound is at least this share of the way from a language's mean to the uniform distribution.
LEAST_SHARE = 0.25


@dataclass
class Model:
    """Sorted keys and log-probabilities by order; ``bow`` has the back-off weights by context order."""

    langs: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    ctx: dict[int, np.ndarray] = field(default_factory=dict)
    bow: dict[int, np.ndarray] = field(default_factory=dict)
    floor: float = 0.0
    mean: np.ndarray | None = None
    #: By language and length class, how far above the mean a cross-entropy may lie.
    bounds: np.ndarray | None = None
    temper: float = 1.0


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _symbols(texts: list[str], before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of the texts, 16 bits each, with runs of other characters as one 0; three zeros before each text.

    Letters above the first plane share the 6,400 symbols of its private-use area.
    With ``before``, the first text goes on after these three symbols.
    Returns the symbols and the place where each text starts.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\0\0\0" + "\0\0\0".join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, low), np.int64, len(low))
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if before is not None and before[-1] and lens[0]:
        keep[3] = True  # a run of other characters begins here
    starts = np.concatenate([[0], np.cumsum(lens + 3)[:-1]])
    for k in range(3):
        keep[starts + k] = True
    out = np.where(letter, np.where(codes > 0xFFFF, 0xE000 + codes % 6400, codes), 0)[keep].astype(np.uint64)
    if before is not None:
        out[:3] = before
    return out, (np.cumsum(keep) - keep)[starts]


def _grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each place, 16 bits a symbol."""
    out = symbols.copy()
    for k in range(1, order):
        out[k:] |= symbols[:-k] << np.uint64(16 * k)
    return out


def _scored(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    mask = np.ones(len(symbols), bool)
    for k in range(3):
        mask[starts + k] = False
    return mask


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(indices of texts, :func:`_symbols` of them) for at most CHUNK characters at once; a longer text comes in parts, each with the symbols before it."""
    at, part, n, before = [], [], 0, None
    for i, t in enumerate(texts):
        for k in range(0, max(len(t), 1), CHUNK):
            s = t[k : k + CHUNK]
            if part and (k or n + len(s) > CHUNK):
                symbols, starts = _symbols(part, before)
                yield at, symbols, starts
                at, part, n, before = [], [], 0, symbols[-3:] if k else None
            at.append(i)
            part.append(s)
            n += len(s)
    if part:
        yield at, *_symbols(part, before)


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, dict[int, int]] = {}
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            total = sums.setdefault(lang, {})
            for _, symbols, starts in _pieces(group["text"].tolist()):
                keys, n = np.unique(_grams(symbols, ORDER)[_scored(symbols, starts)], return_counts=True)
                for k, c in zip(keys.tolist(), n.tolist(), strict=True):
                    total[k] = total.get(k, 0) + c
    for lang, total in sums.items():
        if total:
            keys = np.fromiter(total, np.uint64, len(total)).view(np.int64)
            yield pd.DataFrame({"lang": lang, "gram": keys, "n": np.fromiter(total.values(), np.int64, len(total))})


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    np.minimum(at, len(keys) - 1, out=at)
    return at, keys[at] == wanted


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from the order-4 counts (keys, n) of each language."""
    model = Model(sorted(counts))
    width = len(model.langs)
    low = {o: np.uint64((1 << 16 * o) - 1) for o in range(1, ORDER)}
    grams: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {o: [] for o in range(1, ORDER + 1)}
    for lang in model.langs:
        keys, n = counts[lang]
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.float64)
        grams[ORDER].append((keys, n))
        for o in range(ORDER - 1, 0, -1):
            keys, n = np.unique(keys & low[o], return_counts=True)  # in how many ways each continues
            grams[o].append((keys, n.astype(np.float64)))
    vocab = len(np.unique(np.concatenate([k for k, _ in grams[1]] or [np.zeros(0, np.uint64)]))) + 1
    model.floor = -math.log(vocab)
    lower = np.full((1, width), 1.0 / vocab)
    for o in range(1, ORDER + 1):
        union = np.unique(np.concatenate([k for k, _ in grams[o]] or [np.zeros(0, np.uint64)]))
        contexts = np.unique(union >> np.uint64(16))
        p, bow = np.zeros((len(union), width)), np.ones((len(contexts), width))
        under = np.searchsorted(contexts, union >> np.uint64(16))
        for j, (keys, n) in enumerate(grams[o]):
            at = np.searchsorted(union, keys)
            total = np.bincount(under[at], n, len(contexts))
            kinds = np.bincount(under[at], minlength=len(contexts))
            seen = total > 0
            bow[seen, j] = DISCOUNT * kinds[seen] / total[seen]
            p[at, j] = np.maximum(n - DISCOUNT, 0) / total[under[at]]
        if o == 1:
            p += bow[under] * lower
        else:
            # a suffix is found in the table below, as its n-gram continues one of that table
            below, hit = _find(model.keys[o - 1], union & low[o - 1])
            p += bow[under] * np.where(hit[:, None], np.exp(model.logp[o - 1])[below], 1.0 / vocab)
        model.keys[o], model.logp[o] = union, np.log(p)
        model.ctx[o], model.bow[o] = contexts, np.log(bow)
    return model


def _losses(model: Model, symbols: np.ndarray) -> np.ndarray:
    """Negative log-probability at each place, a column for each language."""
    gram = _grams(symbols, ORDER)
    at, hit = _find(model.keys[ORDER], gram)
    out = model.logp[ORDER][at].astype(np.float32)
    rest = np.flatnonzero(~hit)
    if len(rest):
        out[rest] = 0
        for o in range(ORDER - 1, -1, -1):
            g = gram[rest]
            ctx = (g >> np.uint64(16)) & np.uint64((1 << 16 * o) - 1)
            c, known = _find(model.ctx[o + 1], ctx)
            out[rest] += np.where(known[:, None], model.bow[o + 1][c], 0)
            if o == 0:
                out[rest] += model.floor
                break
            at, hit = _find(model.keys[o], g & np.uint64((1 << 16 * o) - 1))
            out[rest[hit]] += model.logp[o][at[hit]]
            rest = rest[~hit]
            if not len(rest):
                break
    return -out


def cross_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text under each language, and its number of characters."""
    total, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    for at, symbols, starts in _pieces(texts):
        mask = _scored(symbols, starts)
        loss = _losses(model, symbols)
        loss[~mask] = 0
        np.add.at(total, at, np.add.reduceat(loss, starts, axis=0, dtype=np.float64))
        np.add.at(n, at, np.add.reduceat(mask.astype(np.int64), starts))
    return total / np.maximum(n, 1)[:, None], n


def fit(
    docs: DataFrame,
    *,
    docs_per_lang: int = 1000,
    calibration_docs_per_lang: int = 400,
    max_langs: int = 1000,
    slack: float = 1.25,
) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) with a language and a text.

    Rows with remainder 1 of crc32(doc_id) mod 4 calibrate, the others are counted.
    ``docs_per_lang`` and ``calibration_docs_per_lang`` bound, in expectation, the
    documents of each language that are used; they are chosen by a hash of id and text, and
    a repeated row counts once.  ``max_langs`` bounds the languages, by their rows.
    ``slack`` widens the rejection bounds beyond the calibration documents' QUANTILE.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    rows = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text", (fold == 1).alias("held"))
    langs = rows.groupBy("lang").agg(F.count_if(~F.col("held")).alias("counted"), F.count_if("held").alias("held")).orderBy(F.desc(F.col("counted") + F.col("held")), "lang").limit(max_langs).collect()
    if not langs:
        return Model([])
    slots = 1 << 30
    shares = [(r["lang"], h, int(min(1.0, most / max(r[k], 1)) * slots)) for r in langs for h, k, most in ((False, "counted", docs_per_lang), (True, "held", calibration_docs_per_lang))]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, held boolean, share long")  # at most 2 * max_langs rows
    spot = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(slots))
    rows = rows.join(F.broadcast(shares), ["lang", "held"]).where(spot < F.col("share")).dropDuplicates(["lang", "doc_id", "text"])
    counted = rows.where("not held").select("lang", "text").mapInPandas(_count_grams, "lang string, gram long, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    model = kneser_ney({lang: (g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for lang, g in table.groupby("lang")})
    if not model.langs:
        return model

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, n = cross_entropies(model, pdf["text"].tolist())
            yield pd.DataFrame({"lang": pdf["lang"], "n": n, "h": list(h)})

    held = rows.where("held").select("lang", "text").mapInPandas(measure, "lang string, n long, h array<double>").toPandas()
    held = held[(held["n"] > 0) & held["lang"].isin(model.langs)]
    _calibrate(model, held, slack)
    return model


def _calibrate(model: Model, held: pd.DataFrame, slack: float) -> None:
    """Mean of each language's own cross-entropy, the rejection bounds, and the score's temperature."""
    width = len(model.langs)
    model.mean, model.bounds = np.full(width, -model.floor), np.full((width, len(CLASSES) + 1), math.inf)
    if not len(held):
        return
    h, n = np.array(held["h"].tolist()), held["n"].to_numpy()
    own = np.array([model.langs.index(x) for x in held["lang"]])
    mine = h[np.arange(len(h)), own]
    for j in range(width):
        if (own == j).any():
            model.mean[j] = np.average(mine[own == j], weights=n[own == j])
    above, size = mine - model.mean[own], np.digitize(n, CLASSES)
    for j in range(width):
        least = LEAST_SHARE * (-model.floor - model.mean[j])
        for k in range(len(CLASSES) + 1):
            some = (own == j) & (size == k)
            if some.sum() < CLASS_DOCS:
                some = own == j
            if some.any():
                model.bounds[j, k] = max(least, float(np.quantile(above[some], QUANTILE)) * slack)
    gap = (h - h.min(1, keepdims=True)) * np.sqrt(n)[:, None]

    def loss(t: float) -> float:
        e = np.exp(-t * gap)
        return -np.mean(np.log(np.maximum(e[np.arange(len(h)), own] / e.sum(1), 1e-9)))

    model.temper = min((2.0**k for k in range(-4, 7)), key=loss)


def judge(model: Model, texts: list[str]) -> pd.DataFrame:
    """Language, score and rejection of each text."""
    if not model.langs:
        return pd.DataFrame({"lang_pred": [UND] * len(texts), "score": 0.0, "cross_entropy": np.nan, "rejected": True})
    h, n = cross_entropies(model, texts)
    best = h.argmin(1)
    low = h[np.arange(len(h)), best]
    some = n > 0
    e = np.exp(-model.temper * (h - low[:, None]) * np.sqrt(n)[:, None])
    odd = low - model.mean[best] > model.bounds[best, np.digitize(n, CLASSES)]
    return pd.DataFrame(
        {
            "lang_pred": np.where(some, np.array(model.langs, object)[best], UND),
            "score": np.where(some, np.round(1 / e.sum(1), 6), 0.0),
            "cross_entropy": np.where(some, np.round(low, 6), np.nan),
            "rejected": ~some | odd,
        }
    )


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) with lang_pred, score, cross_entropy and rejected for each row of ``docs``.

    With ``text`` among ``keep`` the text is handed through.
    """
    keep = keep or ["doc_id"]
    cols = [*keep, *(["text"] if "text" not in keep else [])]
    handle = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the bounded sample, not the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = judge(handle.value, [t if isinstance(t, str) else "" for t in pdf["text"]])
            yield pd.concat([pdf[keep].reset_index(drop=True), got], axis=1)

    source = docs.select(*cols)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    return source.mapInPandas(run, f"{kinds}, lang_pred string, score double, cross_entropy double, rejected boolean")


def held_out(doc_id: str = "doc_id"):
    """The fold that a contract sets aside: remainder 2 of crc32 of the id's text, by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
