"""SentencePiece encoding by lattice sampling, and lossless decoding.

A text is a chain of segments, each a run of spaces with the characters up to the
next space; no piece crosses such a boundary, so the piece lattice of a text
factors into those of its segments.  (A segment of over ``LONGEST`` characters counts
as several.)  Each distinct segment of a chunk gets its lattice once: forward filtering sums the weights of all segmentations up to every
place, and keeps for each place the cumulative probabilities of the pieces that
can end there.  Backward sampling then draws one piece per occurrence and step,
with uniforms that are a hash of the row key, the segment's number in the text and
the step.  The result depends on key, text, seed and vocabulary only.

The weight of a piece is (2 - score) ** -alpha, for the vocabulary's scores are
minus its ranks.  A character without a piece falls back to its bytes.

Lossless: one space is put before the text and taken off again, the white-space
mark itself goes by bytes, nothing is normalised.  Edge cases: a null text is
encoded as the empty string, which has no pieces; a null key counts as 0; equal
(key, text) rows get equal pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Stands for the mark itself where a text holds it; no character has this code.
OTHER = 0x110000
#: Characters that are encoded at once; a text longer than that goes in parts, so that memory follows this and not the text.
CHUNK = 1 << 19
#: A longer segment is cut, as no word of any language is; places in a segment are 16-bit numbers.
LONGEST = 1 << 15
#: More than the characters of any piece.
WIDEST = 256
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEGMENT = re.compile(" +[^ ]*")


def _mix(z: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lens[i] - 1 of all i in a row."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


class Numbered(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: str) -> int:
        out = self[key] = len(self)
        return out


class Vocabulary:
    """Pieces, their weights, and a table of the hashes of all their prefixes by length."""

    NOTHING = -2

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int], alpha: float = 1.0) -> None:
        self.size = len(pieces)
        usable = [i for i in range(self.size) if i not in special and i not in set(byte_ids) and pieces[i]]
        self.logw = np.full(self.size, -np.inf)
        self.logw[usable] = [-alpha * np.log(2.0 - min(scores[i], 1.0)) for i in usable]
        self.byte_ids = np.array(byte_ids, np.int32)
        self.byte_logw = -alpha * np.log(2.0 + self.size)
        raw = [b""] * self.size
        for i in usable:
            raw[i] = pieces[i].replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        found: list[dict[str, int]] = []
        for i in usable:
            p = pieces[i]
            if MARK in p.lstrip(MARK):
                continue  # such a piece would cross a boundary
            for k in range(1, len(p) + 1):
                while len(found) < k:
                    found.append({})
                found[k - 1].setdefault(p[:k], -1)
            found[len(p) - 1][p] = i
        if len(found) >= WIDEST:
            raise ValueError(f"a piece has {len(found)} characters")
        #: By code point: the piece of that one character, NOTHING if no piece begins with it, or between them if only longer ones do.
        self.first = np.full(OTHER + 1, self.NOTHING, np.int32)
        #: By length: hashes of all prefixes in order, with one that is none at the end; their pieces, or -1; and their last characters.
        self.prefixes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, table in enumerate(found, 1):
            codes = np.frombuffer("".join(table).encode("utf-32-le"), np.uint32).reshape(-1, k)
            ids = np.fromiter(table.values(), np.int32, len(table))
            if k == 1:
                self.first[codes[:, 0]] = ids
            h = np.zeros(len(codes), np.uint64)
            for j in range(k):
                h = h * _BASE + codes[:, j].astype(np.uint64)
            order = np.argsort(h)
            self.prefixes.append((np.append(h[order], np.uint64(0)), np.append(ids[order], np.int32(-1)), np.append(codes[order, -1], np.uint32(OTHER + 1))))

    @classmethod
    def load(cls, path: str, alpha: float = 1.0) -> Vocabulary:
        """From a SentencePiece model file with byte fallback."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(pieces, [sp.get_score(i) for i in range(n)], byte_ids, special, alpha)

    # -- lattices ---------------------------------------------------------------

    def _lattices(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """(last node of each segment, first edge of each node, cumulative probability, previous node, token, token table).

        A segment of m characters has m + 1 nodes. Tokens from ``size`` on stand for characters that go by bytes.
        """
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        codes = np.where(codes == ord(MARK), OTHER, np.where(codes == 32, ord(MARK), codes)).astype(np.uint32)
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(lens)
        seg = np.repeat(np.arange(len(lens)), lens)
        here = np.arange(len(codes), dtype=np.int32)
        left = ends[seg].astype(np.int32) - here  # characters from here to the segment's end
        offset = lens[seg].astype(np.int32) - left
        node = here + seg.astype(np.int32)  # each segment has a node more than characters
        first = self.first[codes]
        rest, at = np.flatnonzero(first < 0).astype(np.int32), np.flatnonzero(first >= 0).astype(np.int32)
        e_at, e_len, e_tok = [at], [np.ones(len(at), np.int32)], [first[at]]
        at, h = np.flatnonzero(first > self.NOTHING).astype(np.int32), None
        for k, (hashes, ids, spelled) in enumerate(self.prefixes[1:], 2):
            fits = left[at] >= k
            at, h = at[fits], codes[at[fits]].astype(np.uint64) if h is None else h[fits]
            if not len(at):
                break
            last = codes[at + (k - 1)]
            h = h * _BASE + last
            spot = np.searchsorted(hashes[:-1], h)
            ok = (hashes[spot] == h) & (spelled[spot] == last)
            at, h, token = at[ok], h[ok], ids[spot[ok]]
            whole = token >= 0
            e_at.append(at[whole])
            e_len.append(np.full(len(e_at[-1]), k, np.int32))
            e_tok.append(token[whole])
        chars, which = np.unique(codes[rest], return_inverse=True)
        spelled_bytes = [chr(ord(MARK) if c == OTHER else c).encode() for c in chars.tolist()]
        e_at.append(rest)
        e_len.append(np.ones(len(rest), np.int32))
        e_tok.append((self.size + which).astype(np.int32))
        a, n, tok = (np.concatenate(x) for x in (e_at, e_len, e_tok))
        extra = np.array([len(x) * self.byte_logw for x in spelled_bytes])
        logw = np.concatenate([self.logw, extra])[tok]
        start, end, to = node[a], node[a] + n, offset[a] + n
        by_end = np.argsort(end.astype(np.int64) * WIDEST + n)  # no two edges are equal in both
        start, end, tok, to = start[by_end], end[by_end], tok[by_end], to[by_end].astype(np.uint16)
        order = np.argsort(to, kind="stable")  # all edges to places k, then to places k + 1, by node
        back, steps = (start, end), np.searchsorted(to[order], np.arange(1, int(to.max(initial=0)) + 2))
        start, end, logw = start[order], end[order], logw[by_end][order]
        nodes = len(codes) + len(lens)
        alpha, share = np.zeros(nodes), np.empty(len(start))
        for lo, hi in zip(steps[:-1], steps[1:], strict=True):
            v = alpha[start[lo:hi]] + logw[lo:hi]
            e = end[lo:hi]
            head = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            size = np.diff(np.append(head, hi - lo))
            top = np.repeat(np.maximum.reduceat(v, head), size)
            w = np.exp(v - top)
            total = np.add.reduceat(w, head)
            alpha[e[head]] = top[head] + np.log(total)
            share[lo:hi] = w / np.repeat(total, size)
        (start, end), share[order] = back, share.copy()
        ptr = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=nodes))])
        run = np.cumsum(share)
        cum = run - np.repeat(np.concatenate([[0.0], run])[ptr[:-1]], np.diff(ptr))
        cum[ptr[1:][np.diff(ptr) > 0] - 1] = 2.0  # the last edge takes what is left
        table_len = np.concatenate([np.ones(self.size, np.int64), np.array([len(x) for x in spelled_bytes], np.int64)])
        table = np.concatenate([np.arange(self.size, dtype=np.int32), self.byte_ids[np.frombuffer(b"".join(spelled_bytes), np.uint8)]])
        return ends + np.arange(len(lens)), ptr, cum, start, tok, table_len, table

    def encode(self, texts: list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        return self.encode_segments([segments(t) for t in texts], keys, np.zeros(len(texts), np.int64), seed)

    def encode_segments(self, parts: list[list[str]], keys: np.ndarray, first: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, number of ids of each); a part is the segments of a text from number ``first`` on."""
        index = Numbered()
        which = [np.fromiter(map(index.__getitem__, part), np.int64, len(part)) for part in parts]
        per = np.fromiter(map(len, parts), np.int64, len(parts))
        if not index:
            return np.zeros(0, np.int32), per
        last, ptr, cum, prev, tok, table_len, table = self._lattices(list(index))
        occ = np.concatenate(which)
        number = _spread(first, per)
        salt = _mix(_mix(keys.astype(np.uint64) + np.uint64(seed * int(_BASE) % 2**64)).repeat(per) + number.astype(np.uint64) * _BASE)
        at, live, drawn = last[occ], np.arange(len(occ)), []
        step = 0
        while len(live):
            u = (_mix(salt[live] + np.uint64(step + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = ptr[at]
            todo = np.flatnonzero(cum[edge] <= u)
            while len(todo):
                edge[todo] += 1
                todo = todo[cum[edge[todo]] <= u[todo]]
            drawn.append((live, tok[edge]))
            at = prev[edge]
            go = ptr[at + 1] > ptr[at]  # a node without edges begins a segment
            live, at = live[go], at[go]
            step += 1
        count = np.zeros(len(occ), np.int64)
        for who, _ in drawn:
            count[who] += 1
        end = np.cumsum(count)
        tokens = np.empty(end[-1], np.int64)
        for k, (who, token) in enumerate(drawn):
            tokens[end[who] - 1 - k] = token
        bounds = np.concatenate([[0], np.cumsum(per)])
        tokens_per = np.diff(np.concatenate([[0], end])[bounds])
        if len(table_len) == self.size:
            return tokens.astype(np.int32), tokens_per
        size = table_len[tokens]
        ids = table[_spread((np.cumsum(table_len) - table_len)[tokens], size)]
        run = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(run[np.concatenate([[0], np.cumsum(tokens_per)])])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids, each text with its leading space."""
        n = self.raw_len[ids]
        return self.raw[_spread(self.raw_at[ids], n)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of one row's ids."""
        return self.decode_bytes(np.asarray(ids, np.int64))[1:].decode("utf-8", "replace")


def segments(text: str) -> list[str]:
    """The segments of a text with a space before it; none of an empty one."""
    found = _SEGMENT.findall(" " + text) if text else []
    if len(text) < LONGEST:
        return found
    return [s[k : k + LONGEST] for s in found for k in range(0, len(s), LONGEST)]


def _parts(text: str) -> Iterator[list[str]]:
    """The segments of a text in lists of about CHUNK characters."""
    part, n = [], 0
    for found in _SEGMENT.finditer(" " + text if text else ""):
        s = found.group()
        for k in range(0, len(s), LONGEST):
            part.append(s[k : k + LONGEST])
            n += len(part[-1])
            if n >= CHUNK:
                yield part
                part, n = [], 0
    if part:
        yield part


def _encode_rows(v: Vocabulary, texts: list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each, whether each decodes to itself)."""
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        found, same, number = [], True, 0
        for part in _parts(texts[0]):
            ids, _ = v.encode_segments([part], keys, np.array([number]), seed)
            same &= v.decode_bytes(ids) == "".join(part).encode()
            found.append(ids)
            number += len(part)
        ids = np.concatenate(found or [np.zeros(0, np.int32)])
        return ids, np.array([len(ids)]), np.array([same])
    ids, n = v.encode(texts, keys, seed)
    same = np.ones(len(texts), bool)
    if v.decode_bytes(ids) != "".join(" " + t for t in texts if t).encode():
        ends = np.cumsum(n)
        same = np.array([v.decode(ids[e - k : e]) == t for e, k, t in zip(ends, n, texts, strict=True)])
    return ids, n, same


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of rows that have at most CHUNK characters together; a longer row is alone."""
    lo, n = 0, 0
    for i, size in enumerate(lengths):
        if i > lo and n + size > CHUNK:
            yield lo, i
            lo, n = i, 0
        n += size
    if lo < len(lengths):
        yield lo, len(lengths)


def encode(docs: DataFrame, path: str, *, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """doc_id, n_pieces, piece_ids, and ``lossless``: that decoding the ids gives the text again."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path, alpha))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            for lo, hi in _slices(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
                rows = batch.slice(lo, hi - lo)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                keys = np.array([k or 0 for k in rows.column(0).to_pylist()], np.int64)
                ids, n, same = _encode_rows(v, texts, keys, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), lists, pa.array(same)], ["doc_id", "n_pieces", "piece_ids", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, piece_ids array<int>, lossless boolean")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` from doc_id and piece_ids; null ids are no ids."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, ids = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [vocabulary.value.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", F.coalesce("piece_ids", F.array().cast("array<int>")).alias("piece_ids")).mapInArrow(run, "doc_id long, text string")
