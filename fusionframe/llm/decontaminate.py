"""Benchmark decontamination: word n-gram seeds, then Smith-Waterman alignment of words.

Every n-gram of an item is a seed, however rare or common; n is short enough that each alignment
of at least the threshold holds some of them unbroken, and the least number that it holds decides
where an item is laid on a document (see `Need`). Both are then aligned word by word, so the scores
are those of aligning each item with each whole document. Items go in blocks of bounded bytes,
each against all documents; no document or hit is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, arrow_map, byte_slices, gram_hashes, lowered, packed, table, word_spans

MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20
HITS = 1 << 21


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]


def _words(column: pa.Array):
    data, starts = packed(column)
    low = lowered(data)
    begin, end, text = word_spans(low, starts, alnum=True)
    return data, starts, begin, end, text, SpanHash(low).of(begin, end) if len(begin) else np.zeros(0, np.uint64)


def items_of(rows: list[tuple[int, str]]) -> Items:
    *_, text, words = _words(pa.array([t or "" for _, t in rows], pa.string()))
    cut = np.searchsorted(text, np.arange(len(rows) + 1))
    return Items([i for i, _ in rows], [words[a:b] for a, b in zip(cut, cut[1:])])


class Need:
    """What an alignment of each item has to hold to score at least `threshold`.

    An item of L words needs a score S. With m matches and p mismatches and gaps, S <= MATCH m - p and
    m <= L, so p <= slack = MATCH L - S. The matches lie in at most p + 1 unbroken runs, which hold
    at least m - (g - 1)(p + 1) g-grams; for g > 1 this is least at m = L, for g = 1 it is S / MATCH. `size` is the
    largest g up to n for which this is at least 1, `hits` the number; `size` is 0 where no score can do.
    The starts of the item that its hits tell (place in the document less place in the item) differ by
    at most slack, and the alignment lies within slack of the item laid at any of them.
    """

    def __init__(self, items: Items, n: int, threshold: float):
        self.length = np.array([len(w) for w in items.words], np.int64)
        self.size, self.hits, self.slack = (np.zeros(len(self.length), np.int64) for _ in range(3))
        for k, length in enumerate(self.length.tolist()):
            full = MATCH * length
            score = max(1, int(full * threshold) - 1)
            while score <= full and score / full < threshold:
                score += 1
            if not length or score > full:
                continue
            self.slack[k] = full - score
            self.size[k], self.hits[k] = 1, -(-score // MATCH)
            for g in range(2, min(n, length) + 1):
                held = length - (g - 1) * (full - score + 1)
                if held >= 1:
                    self.size[k], self.hits[k] = g, held


class Finder:
    """Which of many hashes are in a fixed set: a bit table first, then a binary search."""

    def __init__(self, keys):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(self.keys) or not len(maybe):
            return maybe[:0]
        at = np.searchsorted(self.keys, h[maybe])
        return maybe[self.keys[np.minimum(at, len(self.keys) - 1)] == h[maybe]]


@dataclass
class Seeds:
    """The grams of one size with their places: (item, offset) of grams[j] are those from cut[j] to cut[j + 1]."""

    size: int
    finder: Finder
    cut: np.ndarray
    item: np.ndarray
    offset: np.ndarray


def seeds_of(items: Items, need: Need) -> list[Seeds]:
    out = []
    for g in sorted(set(need.size.tolist()) - {0}):
        own = np.flatnonzero(need.size == g)
        words, at = np.concatenate([items.words[k] for k in own]), np.repeat(own, need.length[own])
        first = np.concatenate(([0], np.cumsum(need.length[own])[:-1]))
        h, place = gram_hashes(words, at, g)
        order = np.argsort(h, kind="stable")
        h, place = h[order], place[order]
        offset = place - np.repeat(first, need.length[own])[place]
        finder = Finder(h)
        out.append(Seeds(g, finder, np.append(np.searchsorted(h, finder.keys), len(h)), at[place], offset))
    return out


def smith_waterman(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end in b, exclusive) of each pair of word sequences; linear gaps."""
    n, m, w = len(a), max(map(len, a)), max(map(len, b))
    x, y = np.zeros((n, m), np.uint64), np.ones((n, w), np.uint64)
    for k in range(n):
        x[k, : len(a[k])] = a[k] | np.uint64(2)
        y[k, : len(b[k])] = b[k] | np.uint64(2)
    slope = (np.arange(w) * -GAP).astype(np.int32)
    before, best, end = np.zeros((n, w), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(m):
        cur = np.where(y == x[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
        cur[:, 1:] += before[:, :-1]
        np.maximum(cur, before + GAP, out=cur)
        np.maximum(cur, 0, out=cur)
        cur += slope
        np.maximum.accumulate(cur, axis=1, out=cur)
        cur -= slope
        top = cur.argmax(1)
        s = cur[np.arange(n), top]
        better = s > best
        best[better], end[better] = s[better], top[better] + 1
        before = cur
    return best, end


def _starts(words: np.ndarray, text: np.ndarray, seeds: list[Seeds], n_items: int, lead: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, hits): how many hits tell that an item starts at a word of a text; code is ((text, item), start + lead) in a base of span."""
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in seeds:
        h, at = gram_hashes(words, text, s.size)
        hit = s.finder.hits(h)
        which = np.searchsorted(s.finder.keys, h[hit])
        at, many = at[hit], (s.cut[which + 1] - s.cut[which])
        ends, done = np.cumsum(many), 0
        while done < len(hit):  # a bounded number of hits at once
            base = int(ends[done - 1]) if done else 0
            to = max(done + 1, int(np.searchsorted(ends, base + HITS, "right")))
            n = many[done:to]
            place = np.repeat(s.cut[which[done:to]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pos = np.repeat(at[done:to], n)
            code = (text[pos] * n_items + s.item[place]) * span + pos - s.offset[place] + lead
            code, n = np.unique(code, return_counts=True)
            codes.append(code)
            counts.append(n)
            done = to
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate(counts), len(code)).astype(np.int64)


def _windows(words: np.ndarray, text: np.ndarray, limits: np.ndarray, seeds: list[Seeds], need: Need) -> list[tuple[int, int, int, int]]:
    """(text, item, first, last) word ranges that hold every alignment of at least the threshold, overlapping ones joined."""
    n_items = len(need.length)
    lead = int((need.length + need.slack).max(initial=0)) + 1
    span = len(words) + 2 * lead
    code, hits = _starts(words, text, seeds, n_items, lead, span)
    if not len(code):
        return []
    pair = code // span
    t, k, start = pair // n_items, pair % n_items, code % span - lead
    low = np.searchsorted(code, code - need.slack[k])  # never another pair's: a start has at least slack below it
    sums = np.concatenate(([0], np.cumsum(hits)))
    enough = np.flatnonzero(sums[1:] - sums[low] >= need.hits[k])
    edge = np.zeros(len(code) + 1, np.int64)
    np.add.at(edge, low[enough], 1)
    np.add.at(edge, enough + 1, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(kept):
        return []
    t, k, start, pair = t[kept], k[kept], start[kept], pair[kept]
    a = np.maximum(limits[t], start - need.slack[k])
    b = np.minimum(limits[t + 1], start + need.length[k] + need.slack[k])
    new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (a[1:] > b[:-1]))))
    last = np.append(new[1:], len(a)) - 1
    return list(zip(t[new].tolist(), k[new].tolist(), a[new].tolist(), b[last].tolist(), strict=True))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, start, end: the best passage of each document for each item that it leaks.

    score is the alignment score over that of a perfect copy (at least `threshold`); start and
    end are code points of the passage. Words are runs of letters and digits, small letters.
    `n` is the longest seed; shorter ones are taken where longer ones could miss an alignment.
    A null or empty text or item leaks nothing; repeated rows of documents give repeated rows, repeated items one row; rows with a null
    item id are left out, a null document id stays null; very long texts are taken whole; other
    columns are ignored. Ids are whole numbers, or texts of digits; others are an error.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tests = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("k"), F.col(item_text).alias("t")).distinct()
    total = tests.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    blocks = -(-int(total) // block_bytes) or 1
    out = None
    for b in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b)
        items = items_of(sorted((r.k, r.t) for r in part.collect()))  # about block_bytes
        found = _block_leaks(own, items, n, threshold)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint, score double, start bigint, end bigint")


def _block_leaks(docs: DataFrame, items: Items, n: int, threshold: float) -> DataFrame:
    need = Need(items, n, threshold)
    shared = docs.sparkSession.sparkContext.broadcast((items, need, seeds_of(items, need)))
    types = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def rows(batch: pa.RecordBatch):
        items, need, seeds = shared.value
        for a, b in byte_slices(batch.column(1)):
            data, starts, begin, end, text, words = _words(batch.column(1).slice(a, b - a))
            limits = np.searchsorted(text, np.arange(b - a + 1))
            found = _windows(words, text, limits, seeds, need)
            best: dict[tuple[int, int], tuple] = {}
            found.sort(key=lambda x: (x[3] - x[2], len(items.words[x[1]])))
            at = 0
            while at < len(found):
                to = at + 1
                while to < len(found) and (to - at) * (found[to][3] - found[to][2]) < 1 << 18:
                    to += 1
                part = found[at:to]
                score, stop = smith_waterman([items.words[k] for _, k, _, _ in part], [words[x:y] for _, _, x, y in part])
                for (t, k, x, _), s, e in zip(part, score.tolist(), stop.tolist(), strict=True):
                    share = s / (MATCH * len(items.words[k]))
                    if share >= threshold and (-share, x) < best.get((t, items.ids[k]), (0, 0, 0))[:2]:
                        best[t, items.ids[k]] = (-share, x, k, x + e)
                at = to
            out = []
            for (t, ident), (share, x, k, e) in sorted(best.items()):
                _, back = smith_waterman([items.words[k][::-1]], [words[x:e][::-1]])
                first = begin[e - int(back[0])]
                head = bytes(data[starts[t] : end[e - 1]])
                lead = len(head[: first - starts[t]].decode("utf-8", "replace"))
                out.append((batch.column(0)[a + t].as_py(), ident, -share, lead, len(head.decode("utf-8", "replace"))))
            yield {name: [x[j] for x in out] for j, name in enumerate(types.names)}

    return arrow_map(docs, rows, "doc_id bigint, item_id bigint, score double, start bigint, end bigint", types)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))
