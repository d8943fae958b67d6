"""Cross-entropy difference of a target and a background character model.

Both are order-4 models over one vocabulary, all characters of all documents, with
Witten-Bell interpolation down to the uniform distribution.  The background counts every
document, the target those labelled good.  Every character of a text has a loss under
both; the mean losses and their difference score the text (below 0: more like the
target).  A target row is scored by the target rows of the other half, by a hash of its
text, so that it isn't judged by its own counts (nor by its copies').

A character is its lower-cased code point, a run of white space one space; code points
above the first plane share the 6,400 symbols of its private-use area.  (Bigrams of whole
words were tried: in texts of many words nearly every one is new, and their shuffle alone
is seven times the texts.)

The tables grow with the corpus and are never collected or broadcast.  The texts are
dealt into blocks of about ``BLOCK`` characters, each with its distinct 4-grams and their
counts.  The 4-grams of all blocks are summed by key, get their losses by joins with the
sums of their contexts and with the next lower order, and go back to their blocks, where
the texts add them up.  A task holds a block.

Edge cases: a null or empty text has no character and scores 0.  A repeated row counts
again in the models and is scored again; labels with a null id or quality are passed
over, of several labels of one id the lowest counts.  Without a target row the target
models are uniform.  A text of any length is in one block, worked on in parts of
``CHUNK`` characters.  Extra columns change nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ORDER = 4
BLOCK = 32_000_000
#: The characters that a partition should have.
LEAST = 4_000_000
#: A block also ends with so many distinct 4-grams; both are looked at after each SLICE characters.
DISTINCT, SLICE = 1 << 20, 1 << 21
CHUNK = 1 << 20
SPACE = 32
#: Count columns: of all rows, and of the target rows of either half.
KINDS = ("n", "t0", "t1")
#: Models: the background, and the target's halves and whole.
MODELS = ("n", "t0", "t1", "t2")

_SPACES: np.ndarray | None = None


def _spaces() -> np.ndarray:
    """Whether each code point is white space, as 0 is taken to be."""
    global _SPACES
    if _SPACES is None:
        _SPACES = np.fromiter((c == 0 or chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
    return _SPACES


def symbols(texts: list[str], before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """16-bit symbols of the texts with three zeros before each one, and the place where each text's zeros start.

    With ``before``, the first text goes on after these three symbols.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\0\0\0" + "\0\0\0".join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.concatenate([[0], np.cumsum(lens + 3)[:-1]])
    out = np.where(_spaces()[codes], SPACE, np.where(codes > 0xFFFF, 0xE000 + codes % 6400, codes)).astype(np.uint64)
    for k in range(3):
        out[starts + k] = 0
    if before is not None:
        out[:3] = before
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != SPACE) | (out[:-1] != SPACE)
    keep[:3] = True
    return out[keep], (np.cumsum(keep) - keep)[starts]


def grams(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(indices of texts, the 4-gram that ends at each character, number of characters by text) for CHUNK characters at once; a longer text in parts."""

    def cut(part: list[str], before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, starts = symbols(part, before)
        out = s.copy()
        for k in range(1, ORDER):
            out[k:] |= s[:-k] << np.uint64(16 * k)
        live = np.ones(len(s), bool)
        for k in range(3):
            live[starts + k] = False
        return s[-3:], out[live].view(np.int64), np.diff(np.append(starts, len(s))) - 3

    at, part, n, before = [], [], 0, None
    for i, t in enumerate(texts):
        for k in range(0, max(len(t), 1), CHUNK):
            piece = t[k : k + CHUNK]
            if part and (k or n + len(piece) > CHUNK):
                last, found, sizes = cut(part, before)
                yield at, found, sizes
                at, part, n, before = [], [], 0, last if k else None
            at.append(i)
            part.append(piece)
            n += len(piece)
    if part:
        yield at, *cut(part, before)[1:]


def _summed(found: list[np.ndarray]) -> np.ndarray:
    """Rows (key, counts) with the counts of equal keys summed, by key."""
    rows = np.concatenate(found, 1)
    keys, at = np.unique(rows[0], return_inverse=True)
    return np.stack([keys, *(np.bincount(at, r, len(keys)).astype(np.int64) for r in rows[1:])])


def _counts(texts: list[str], half: np.ndarray) -> np.ndarray:
    """(key, n, t0, t1) of the distinct 4-grams of the texts; ``half`` is 2 for a text that is no target."""
    found = [np.zeros((4, 0), np.int64)]
    for at, g, sizes in grams(texts):
        keys, place = np.unique(g, return_inverse=True)
        of = np.repeat(half[at], sizes)
        found.append(np.stack([keys, np.bincount(place, minlength=len(keys)), *(np.bincount(place[of == h], minlength=len(keys)) for h in (0, 1))]))
        if len(found) > 8:
            found = [_summed(found)]
    return _summed(found)


def _blocks(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Rows (doc_id, text, target, half) of each block, their halves (2: no target), and their table of 4-grams."""

    def half(some: list[tuple]) -> np.ndarray:
        return np.array([r[3] if r[2] else 2 for r in some], np.int64)

    rows, table, size, fresh, waits = [], np.zeros((4, 0), np.int64), 0, [], 0
    for pdf in chain(pdfs, [None]):
        for row in zip(pdf["doc_id"], pdf["text"], pdf["target"], pdf["half"], strict=True) if pdf is not None else [None]:
            if row is not None:
                rows.append(row)
                fresh.append(row)
                waits += len(row[1])
                if waits < SLICE:
                    continue
            table = _summed([table, _counts([r[1] for r in fresh], half(fresh))])
            size, fresh, waits = size + waits, [], 0
            if rows and (row is None or size >= BLOCK or table.shape[1] >= DISTINCT):
                yield rows, half(rows), table
                rows, table, size = [], np.zeros((4, 0), np.int64), 0


def _dealt(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows with their block and the target model that judges them (2: the whole), and for each block a row with its 4-grams."""
    part = pyspark.TaskContext.get().partitionId()
    for k, (rows, half, table) in enumerate(_blocks(pdfs)):
        gone = [None] * len(rows)
        yield pd.DataFrame(
            {
                "block": (part << 24) | k,
                "doc_id": pd.Series([r[0] for r in rows] + [None], dtype=object),
                "text": [r[1] for r in rows] + [None],
                "fold": [*np.where(half == 2, 2, 1 - half).tolist(), -1],
                **{c: [*gone, x] for c, x in zip(("keys", *KINDS), table, strict=True)},
            }
        )


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, its ``size``, ``target``: whether the row is labelled good, and ``half``, by a hash of its text.

    Labels grow with the documents, so they are joined by a shuffle at every size.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("good_id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("size", F.length("text")).join(good.hint("merge"), F.col("doc_id") == F.col("good_id"), "left")
    return rows.select("doc_id", "text", "size", F.col("good_id").isNotNull().alias("target"), F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).cast("int").alias("half"))


def dealt(rows: DataFrame) -> DataFrame:
    """:func:`marked`'s rows in blocks; stored, as a block's number holds for one reading.

    Partitions of fewer than LEAST characters are read together, for a block's distinct
    4-grams are many beside its characters where it is small.
    """
    chars = rows.agg(F.sum("size")).first()[0] or 0  # the texts themselves aren't shuffled for this
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "target", "half").coalesce(-(-chars // LEAST) or 1)
    return stored(rows.mapInPandas(_dealt, "block long, doc_id string, text string, fold int, keys array<long>, " + ", ".join(f"{c} array<long>" for c in KINDS)), "lm-blocks")


def asked(blocks: DataFrame) -> DataFrame:
    """(block, key) and the counts of each distinct 4-gram of each block."""
    pairs = blocks.where("keys is not null").select("block", F.explode(F.arrays_zip("keys", *KINDS)).alias("x"))
    return pairs.select("block", F.col("x.keys").alias("key"), *[F.col(f"x.{c}").alias(c) for c in KINDS])


def _summed_by_key(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in KINDS])


def count(rows: DataFrame) -> DataFrame:
    """The models' table, key and KINDS, from :func:`marked`'s rows."""
    return _summed_by_key(asked(dealt(rows)))


def _of(model: str) -> Column:
    return F.col("t0") + F.col("t1") if model == "t2" else F.col(model)


def probabilities(counts: DataFrame) -> DataFrame:
    """key and ``p_n`` to ``p_t2``, its probability under each model, from the summed counts of 4-grams."""
    tables = {ORDER: counts}
    for o in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND((1 << 16 * o) - 1).alias("key")
        tables[o] = stored(tables[o + 1].groupBy(suffix).agg(*[F.sum(c).alias(c) for c in KINDS]), f"lm-order{o}")
    sums = lambda: [x for m in MODELS for x in (F.sum(_of(m)).alias(f"all_{m}"), F.count_if(_of(m) > 0).alias(f"kinds_{m}"))]
    whole = tables[1].agg(F.count("*").alias("vocabulary"), *sums()).first()
    flat = 1.0 / max(whole["vocabulary"], 1)
    one = lambda m: (_of(m) + whole[f"kinds_{m}"] * flat) / float(whole[f"all_{m}"] + whole[f"kinds_{m}"]) if whole[f"all_{m}"] else F.lit(flat)
    lower = tables[1].select("key", *[one(m).alias(f"p_{m}") for m in MODELS])
    for o in range(2, ORDER + 1):
        context = F.shiftrightunsigned("key", 16)
        rows = tables[o].withColumn("context", context).join(tables[o].groupBy(context.alias("context")).agg(*sums()), "context")
        below = lower.select(F.col("key").alias("suffix"), *[F.col(f"p_{m}").alias(f"low_{m}") for m in MODELS])
        rows = rows.withColumn("suffix", F.col("key").bitwiseAND((1 << 16 * (o - 1)) - 1)).join(below, "suffix")
        some = lambda m: (_of(m) + F.col(f"kinds_{m}") * F.col(f"low_{m}")) / (F.col(f"all_{m}") + F.col(f"kinds_{m}"))
        lower = stored(rows.select("key", *[F.when(F.col(f"all_{m}") > 0, some(m)).otherwise(F.col(f"low_{m}")).alias(f"p_{m}") for m in MODELS]), f"lm-p{o}")
    return lower


def _added(key: tuple, docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Scores of a block's texts from the probabilities of its 4-grams."""
    known = known.sort_values("key")
    keys, loss = known["key"].to_numpy(), -np.log(known[[f"p_{m}" for m in MODELS]].to_numpy(np.float64))
    texts, fold = docs["text"].tolist(), docs["fold"].to_numpy()
    total, n = np.zeros((len(texts), 2)), np.zeros(len(texts), np.int64)
    for at, g, sizes in grams(texts):
        spot = np.searchsorted(keys, g)
        both = np.zeros((len(g) + 1, 2))
        both[:-1, 0], both[:-1, 1] = loss[spot, 1 + np.repeat(fold[at], sizes)], loss[spot, 0]
        sums = np.add.reduceat(both, np.cumsum(sizes) - sizes, axis=0)
        sums[sizes == 0] = 0
        np.add.at(total, at, sums)
        np.add.at(n, at, sizes)
    ce = total / np.maximum(n, 1)[:, None]
    return pd.DataFrame({"doc_id": docs["doc_id"].to_numpy(), "n_tokens": n, "target_ce": np.round(ce[:, 0], 6), "background_ce": np.round(ce[:, 1], 6), "ce_diff": np.round(ce[:, 0] - ce[:, 1], 6)})


def score(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, target_ce, background_ce and ce_diff of each of :func:`marked`'s rows, by the models of these rows or of other ``counts``."""
    blocks = dealt(rows)
    wanted = asked(blocks)
    if counts is not None:
        table = counts.select("key", *KINDS).unionByName(wanted.select("key", *[F.lit(0).cast("long").alias(c) for c in KINDS]))
    else:
        table = wanted.drop("block")
    answers = wanted.select(F.col("block").alias("of"), "key").join(probabilities(stored(_summed_by_key(table), "lm-counts")), "key")
    texts = blocks.where("fold >= 0").select("block", "doc_id", "text", "fold")
    added = texts.groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(_added, "doc_id string, n_tokens long, target_ce double, background_ce double, ce_diff double")
    return added.withColumn("doc_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType))
