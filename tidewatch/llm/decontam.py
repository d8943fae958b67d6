"""Benchmark decontamination by pigeonhole edit matching.

An item of m normalised characters may differ by k = floor(rate * m) edits.  It is
split into k + 1 pieces: within k edits at least one piece is untouched, so every
occurrence has an exact piece hit.  One Aho-Corasick automaton over the pieces of
all items finds the hits in one pass over a text; around each hit, Myers'
bit-parallel distance verifies the item in a window that k edits can't leave.

Normalisation: lower case, runs of white space as one space.  An item shorter than
``least_chars`` matches without edits and as whole words only, for a few edits would make
other words of it.  Edge cases: a null text is the empty string; items that are null or
have no character match nothing; items with one normalised text match together, and of
several texts of one item id the nearest counts; a null item id is an id.
Rows are judged one by one, so repeated rows, ids and extra columns change
nothing; an empty benchmark clears every row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: In place of an edit budget: the item matches as whole words.
WHOLE = -1


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly one length."""
    n = len(item)
    ends = [n * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def search_distance(item: dict[str, int], m: int, text: str) -> int:
    """Least edit distance of the item (its masks, m characters) to any substring of ``text``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = item.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return best


class Matcher:
    """Items ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int) -> None:
        self.ids: list[list[int]] = []
        self.items: list[tuple[str, int]] = []
        self.masks: dict[int, dict[str, int]] = {}
        by_text: dict[str, list[int]] = {}
        for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            if s := normalised(text):
                by_text.setdefault(s, []).append(i)
        spots: dict[str, list[tuple[int, int]]] = {}
        for at, (s, ids) in enumerate(by_text.items()):
            k = int(rate * len(s)) if len(s) >= least_chars else WHOLE
            self.items.append((s, k))
            self.ids.append(ids)
            for offset, piece in pieces(s, max(k, 0)):
                spots.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in spots.items():
            self.automaton.add_word(piece, (len(piece), where))
        if spots:
            self.automaton.make_automaton()
        self.some = bool(spots)

    def find(self, text: str) -> dict[int, int]:
        """Least distance of each item that occurs within its budget, by item id."""
        if not self.some:
            return {}
        s = normalised(text)
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(s):
            for at, offset in where:
                starts.setdefault(at, set()).add(end + 1 - size - offset)
        best: dict[int, int] = {}
        for at, found in starts.items():
            item, k = self.items[at]
            m = len(item)
            if k == WHOLE:
                if any(not s[max(a - 1, 0) : a].isalnum() and not s[a + m : a + m + 1].isalnum() for a in found):
                    best[at] = 0
                continue
            if any(a >= 0 and s.startswith(item, a) for a in found):
                best[at] = 0
                continue
            least, to = k + 1, -1
            for a in sorted(found):
                if a <= to:
                    continue  # hits near one start share a window of twice the slack
                to = a + k
                window = s[max(0, a - k) : a + m + 2 * k]
                least = min(least, search_distance(self.masks.setdefault(at, masks(item)), m, window))
            if least <= k:
                best[at] = least
        out: dict[int, int] = {}
        for at, d in best.items():
            for i in self.ids[at]:
                out[i] = min(d, out.get(i, d))
        return out


_MATCHERS: dict[str, Matcher] = {}


def _matcher(name: str, items: list, rate: float, least_chars: int) -> Matcher:
    """The matcher of this name; a worker keeps the last one."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(items, rate, least_chars)
    return _MATCHERS[name]


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rate: float = 0.06,
    least_chars: int = 30,
    block_chars: int = 20_000_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (doc_id) with ``item_ids``, sorted, and ``distances`` beside them.

    Items go to the executors in blocks of at most about ``block_chars`` characters.  Each
    block takes one pass over the rows, whose result is stored before the next block is
    read, so that neither a broadcast nor a worker grows with the benchmark.
    """
    keep = keep or ["doc_id"]
    cols = [*keep, *(["text"] if "text" not in keep else [])]
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    none = "array<struct<item_id:bigint,distance:int>>"
    rows = docs.select(*cols, F.array().cast(none).alias("hits"))
    handed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema)
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        listed = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.collect()])

        def run(batches: Iterator[pd.DataFrame], listed=listed, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            matcher = _matcher(name, listed.value, rate, least_chars)
            for pdf in batches:
                found = [matcher.find(t) if isinstance(t, str) else {} for t in pdf["text"]]
                pdf["hits"] = [[*h, *({"item_id": i, "distance": d} for i, d in f.items())] for h, f in zip(pdf["hits"], found, strict=True)]
                yield pdf

        last, rows = rows, rows.mapInPandas(run, f"{handed}, hits {none}")
        if b < blocks - 1:
            rows = stored(rows, "decontamination")
            listed.unpersist()
            dropped(last)
    best = F.aggregate(F.array_sort("hits"), F.array().cast(none), lambda acc, x: F.when((F.size(acc) > 0) & F.element_at(acc, -1)["item_id"].eqNullSafe(x["item_id"]), acc).otherwise(F.concat(acc, F.array(x))))
    hits = best if blocks > 1 else F.array_sort("hits")  # two texts of one item may be in two blocks
    return rows.select(*keep, hits["item_id"].alias("item_ids"), hits["distance"].alias("distances"))
