"""Quality rules with an isolation forest on rule statistics.

Two plain rules fail a text (under 50 words, or more than half of its words in
repeated three-word windows).  The statistics behind the rules, and a few more of
the same kind, go to an isolation forest: random splits isolate odd rows on short
paths.  Its trees draw their samples from all rows; the cut on its
score has the best balanced accuracy over every labelled row that the rules let pass.

Edge cases: a null or empty text has no words, all statistics 0 and fails.  Rows
are judged one by one (repeated rows, repeated ids and extra columns change
nothing); labels with a null id or quality are passed over, of several labels of
one id the lowest counts; without labels of both kinds only the rules decide.  An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share, stored

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_kinds", "n_upper", "n_digits", "n_marks", "n_lines"]
# Symbols of the rules, and marks that are counted beside them.
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?;:()[]{}=+/\\~^_@\""
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS, _MARKS, _SPACE = (np.frombuffer(x, np.uint8) for x in (SYMBOLS, MARKS, SPACE))


def statistics_of(text: str) -> tuple[int, ...]:
    """COUNTS and MORE of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at the six bytes of SPACE only
    if not words:
        return (0,) * (len(COUNTS) + len(MORE))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    repeated = 0
    if len(ids) > 3:
        v = len(index)
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        _, at, n = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
        start = np.flatnonzero(n[at] > 1)
        inside = np.zeros(len(ids), bool)
        for k in range(3):
            inside[start + k] = True
        repeated = int(inside.sum())
    return (
        len(words),
        len(text) - int(hist[_SPACE].sum()),
        int(hist[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated,
        len(index),
        int(hist[65:91].sum()),
        int(hist[48:58].sum()),
        int(hist[_MARKS].sum()),
        len(lines),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id with COUNTS and MORE of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [statistics_of(t) if isinstance(t, str) else statistics_of("") for t in pdf["text"]]
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=COUNTS + MORE, dtype=np.int64)], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS + MORE))


def features(pdf: pd.DataFrame) -> np.ndarray:
    """Rates that don't follow the length of a text."""
    n, chars = np.maximum(pdf["n_words"].to_numpy(float), 1), np.maximum(pdf["word_chars"].to_numpy(float), 1)
    lines = np.maximum(pdf["n_lines"].to_numpy(float), 1)
    share = lambda c, by: pdf[c].to_numpy(float) / by
    return np.column_stack(
        [
            chars / n,
            share("n_symbols", chars),
            share("n_dup_lines", lines),
            share("n_repeat_words", n),
            share("n_kinds", n**0.8),  # kinds of words grow more slowly than words
            share("n_upper", chars),
            share("n_digits", chars),
            share("n_marks", chars),
        ]
    )


class Forest:
    """An isolation forest; ``score`` is 2 ** (-mean path length / expected path length)."""

    def __init__(self, x: np.ndarray, trees: int, sample: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.expected = self._mean_path(min(sample, len(x)))
        self.trees = [self._grow(x[rng.permutation(len(x))[:sample]], rng, math.ceil(math.log2(max(sample, 2)))) for _ in range(trees)]

    @staticmethod
    def _mean_path(n: float) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
        """Arrays feature, cut, left, right, path; a leaf has feature -1."""
        nodes: list[list[float]] = []

        def add(rows: np.ndarray, at: int) -> int:
            k = len(nodes)
            nodes.append([-1, 0.0, 0, 0, at + self._mean_path(len(rows))])
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (0, 0)
            wide = np.flatnonzero(high > low) if len(rows) > 1 else []
            if at < depth and len(wide):
                f = int(rng.choice(wide))
                cut = float(rng.uniform(low[f], high[f]))
                less = rows[:, f] <= cut
                nodes[k][:4] = [f, cut, add(rows[less], at + 1), add(rows[~less], at + 1)]
            return k

        add(x, 0)
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, cut, left, right, path in self.trees:
            at = np.zeros(len(x), int)
            live = np.flatnonzero(f[at] >= 0)
            while len(live):
                here = at[live]
                at[live] = np.where(x[live, f[here]] <= cut[here], left[here], right[here])
                live = live[f[at[live]] >= 0]
            total += path[at]
        return 2 ** (-total / len(self.trees) / max(self.expected, 1e-9))


def fit(stats: DataFrame, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest | None:
    """A forest whose trees draw ``sample`` rows each from about ``trees * sample`` of all rows that have words.

    These are chosen by a hash of the whole row, a repeated row once.
    """
    rows = stats.where("n_words > 0")
    n = rows.count()
    if not n:
        return None
    some = hash_share(F.xxhash64("doc_id", *COUNTS, *MORE), trees * sample / n, "forest")
    x = rows.where(some).dropDuplicates().orderBy("doc_id", *COUNTS, *MORE).toPandas()
    return Forest(features(x), trees, sample, seed) if len(x) else None


def scored(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """``stats`` with ``anomaly``, from 0 to 1; 0 without a forest."""
    handle = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["anomaly"] = np.round(handle.value.score(features(pdf)), 4) if handle.value and len(pdf) else 0.0
            yield pdf

    return stats.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", anomaly double")


def failed() -> Column:
    """Whether a plain rule fails the row."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def threshold(rows: DataFrame, labels: DataFrame) -> float:
    """The cut on the anomaly with the best balanced accuracy over the labelled rows that the rules let pass; 1 unless there are rows of both labels."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = rows.where(~failed()).select("doc_id", "anomaly").join(marks.where("quality in (0, 1)"), "doc_id")
    found = some.groupBy("anomaly").agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good")).collect()  # at most 10,001 values
    counts = sorted((r["anomaly"], r["bad"], r["good"]) for r in found)
    all_bad, all_good = sum(b for _, b, _ in counts), sum(g for _, _, g in counts)
    if not all_bad or not all_good:
        return 1.0
    best, cut, bad, good = 0.0, 1.0, all_bad, all_good
    for value, b, g in reversed(counts):  # rows above the value are rejected; of equal cuts the highest counts
        gain = (all_bad - bad) / all_bad - (all_good - good) / all_good
        if gain > best:
            best, cut = gain, value
        bad, good = bad - b, good - g
    return cut


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, anomaly and threshold for each row of ``docs``."""
    stats = stored(statistics(docs), "quality-statistics")  # read three times, and a hundredth of the texts
    rows = scored(stats, fit(stats))
    cut = threshold(rows, labels)
    return rows.select("doc_id", *COUNTS, failed().alias("base_failed"), (~failed() & (F.col("anomaly") <= cut)).alias("kept"), "anomaly", F.lit(cut).alias("threshold"))
