"""Phrase collocation mining by sorted suffixes.

1. Words are counted by language. Words under `min_count` can't stand in a frequent phrase, so they end
   pieces in the next step; a bitmap of fixed size (BITS) says which words to keep. It may keep a rare word
   by a collision, which costs time but changes nothing.
2. From every word on, the suffix of its piece, cut after `max_n` words, is one row; equal ones
   of a batch are one row with a count. Rows are dealt by language and first word and sorted in
   descending order of the suffix. Going down the sorted rows, all prefixes are counted with one stack of open
   phrases: where a row shares fewer words with the row above it, the deeper open phrases are done.
3. A first word with more than 1 / HOT of all words is dealt over several tasks by its further words. Its phrases come out in
   parts that are added up; there are at most HOT such words.
4. The frequencies of the parts of each candidate are joined by (language, phrase), and the scores are taken in decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, byte_slices, mixed, stored, table

BITS = 23  # of the bitmap of frequent words: 1 MB
HOT = 1024  # at most so many first words are dealt over several tasks
SLICE = 8 << 20  # bytes of text handled at once; a longer text is taken whole
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False
_ROWS = pa.schema([("suffix", pa.string()), ("n", pa.int32()), ("salt", pa.int32())])
_DONE = pa.schema([("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())])
_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """(piece of each word, the words as a dictionary, a hash of each entry of it), texts one after another with a break between."""
    raw = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    piece = np.cumsum(_BREAK[data])[begin]
    ends = np.concatenate(([0], np.cumsum(end - begin)))
    flat = data[inside]
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
    entries = words.dictionary
    at = np.frombuffer(entries.buffers()[1], np.int64)[entries.offset : entries.offset + len(entries) + 1]
    packed = np.frombuffer(entries.buffers()[2], np.uint8)[: at[-1]] if len(entries) else np.zeros(0, np.uint8)
    hashes = SpanHash(packed).of(at[:-1], at[1:]) if len(entries) else np.zeros(0, np.uint64)
    return piece, words, hashes


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language at a time, about SLICE bytes of them."""
    for batch in batches:
        for a, b in byte_slices(batch.column(1), SLICE):
            langs, texts = pc.fill_null(batch.column(0).slice(a, b - a), "und"), batch.column(1).slice(a, b - a)
            for lang in pc.unique(langs).to_pylist():
                yield lang, texts.filter(pc.equal(langs, lang))


def _buckets(lang: str, hashes: np.ndarray) -> np.ndarray:
    salt = SpanHash(np.frombuffer(lang.encode() + b"\0", np.uint8)).of(np.array([0]), np.array([len(lang.encode()) + 1]))
    return (mixed(hashes ^ salt) >> np.uint64(64 - BITS)).astype(np.int32)


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word, bucket (of the bitmap), n."""

    def run(batches):
        for lang, texts in _by_lang(batches):
            _, words, hashes = _words(texts)
            if len(words):
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), words.dictionary.cast(pa.string()), pa.array(_buckets(lang, hashes)), pa.array(n, pa.int64())], schema=_COUNTS)

    got = docs.select(F.col(lang_col).cast("string"), text_col).mapInArrow(run, "lang string, word string, bucket int, n bigint")
    return got.groupBy("lang", "word", "bucket").agg(F.sum("n").alias("n"))


def _bitmap(words: DataFrame, min_count: int) -> np.ndarray:
    """Whether a bucket has a frequent word; 2**BITS / 64 words of 64 bits at most go to the driver."""
    rows = words.where(F.col("n") >= min_count).groupBy((F.col("bucket") / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bucket") % 64)).alias("bits"))
    out = np.zeros(1 << BITS - 6, np.int64)
    got = rows.toArrow()
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _suffixes(docs: DataFrame, kept: np.ndarray, hot: dict[tuple[str, str], int], max_n: int, lang_col: str, text_col: str) -> DataFrame:
    """suffix (first word, language, further words, each ended by a newline, which no word holds), n, salt."""
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(kept), hot))

    def run(batches):
        bits, hot = shared.value
        frequent = np.unpackbits(bits).view(bool)
        for lang, texts in _by_lang(batches):
            piece, words, hashes = _words(texts)
            entries, ids = words.dictionary.cast(pa.string()), words.indices.to_numpy().astype(np.int64)
            keep = frequent[_buckets(lang, hashes)][ids] if len(ids) else np.zeros(0, bool)
            # Rare words end a piece as breaks do.
            run_of = np.concatenate(([0], np.cumsum((piece[1:] != piece[:-1]) | ~keep[1:] | ~keep[:-1]))) if len(ids) else ids
            m, size = len(ids), len(entries) + 1
            here = np.flatnonzero(keep[:-1] & (run_of[1:] == run_of[:-1])) if m > 1 else np.zeros(0, np.int64)
            if not len(here):
                continue
            key, columns = ids[here], [ids[here]]
            for k in range(1, max_n):  # the next word's number, or none
                at = np.minimum(here + k, m - 1)
                nxt = np.where((here + k < m) & (run_of[at] == run_of[here]), ids[at] + 1, 0)
                columns.append(nxt)
                if size ** (k + 1) >= 1 << 63:  # numbers of the words so far that stay within 64 bits
                    key = np.unique(key, return_inverse=True)[1]
                key = key * size + nxt
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            head = pa.scalar(lang.replace("\\", "\\\\").replace("\n", "\\n"))
            salt = np.zeros(len(first), np.int32)
            spread = np.array([hot.get((lang, w), 1) for w in entries.to_pylist()], np.uint64)[columns[0][first]]
            if (spread > 1).any():
                more = np.zeros(len(first), np.uint64)
                for c in columns[1:]:
                    more = mixed(more * np.uint64(3) + np.concatenate((np.zeros(1, np.uint64), hashes))[c[first]])
                salt = (more % spread + (spread > 1)).astype(np.int32)  # 1 and more: the word's counts come in parts
            for a in range(0, len(first), 1 << 16):
                own = first[a : a + (1 << 16)]
                parts = [pc.take(entries, pa.array(columns[0][own]))] + [pc.take(entries, pa.array(c[own] - 1, mask=c[own] == 0)) for c in columns[1:]]
                suffix = pc.binary_join_element_wise(parts[0], head, *parts[1:], "", "\n", null_handling="skip")
                yield pa.RecordBatch.from_arrays([suffix, pa.array(counts[a : a + (1 << 16)], pa.int32()), pa.array(salt[a : a + (1 << 16)])], schema=_ROWS)

    return docs.select(F.col(lang_col).cast("string"), text_col).mapInArrow(run, "suffix string, n int, salt int")


def _fields(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(newline-ended fields that each row begins with as the row above does, 0 for the first; fields of each row); rows lie one after another."""
    sizes = np.diff(starts)
    above = np.concatenate((sizes[:1] * 0, sizes[:-1]))  # size of the row above, whose bytes lie that far back
    at = np.arange(len(data), dtype=np.int32)
    same = data == data[at - np.repeat(above.astype(np.int32), sizes)]
    differs = np.flatnonzero(~same)
    stop = np.concatenate((differs, [len(data)]))[np.searchsorted(differs, starts[:-1])]
    stop = np.minimum(np.minimum(stop, starts[1:]), starts[:-1] + above)
    ends = np.flatnonzero(data == 10)
    before = np.searchsorted(ends, starts)
    return np.maximum(np.searchsorted(ends, stop) - before[:-1], 0), np.diff(before)


class Stack:
    """Counts of all open phrases of sorted suffixes; a phrase is given out as soon as a row doesn't begin with it."""

    def __init__(self, max_n: int, min_count: int):
        self.max_n, self.least = max_n, min_count
        self.row, self.part = b"", False  # the last row, and whether its first word's counts come in parts
        self.open = [0] * (max_n + 1)  # its count at each depth

    def _out(self, found: list[tuple[list[bytes], list[int], int]]) -> pa.RecordBatch:
        columns = [[p.decode() for f in found for p in f[0]], [f[2] for f in found for _ in f[0]], [int(a) for f in found for a in f[1]]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _DONE)], schema=_DONE)

    def add(self, suffix: pa.Array, n: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        """The phrases that these rows close. A row's fields are its first word, the language and its further words."""
        starts = np.frombuffer(suffix.buffers()[1], np.int32)[suffix.offset : suffix.offset + len(suffix) + 1].astype(np.int64)
        data = np.frombuffer(suffix.buffers()[2], np.uint8)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        shared, depth = _fields(data, starts)
        whole = lambda i: data[starts[i] : starts[i + 1]].tobytes()
        for x, y in zip(self.row.split(b"\n")[:-1], whole(0).split(b"\n")[:-1]):
            if x != y:
                break
            shared[0] += 1
        found = []
        for d in range(2, self.max_n + 1):  # fields: the language and d words
            cut = np.flatnonzero(shared < d + 1)  # rows that don't go on with the phrase above them
            sums = np.bincount(np.cumsum(shared < d + 1), np.where(depth >= d + 1, n, 0), len(cut) + 1).astype(np.int64)
            self.open[d] += int(sums[0])
            if not len(cut):
                continue
            out, counts = [], []
            if self.open[d] and (self.open[d] >= self.least or self.part):
                out, counts = [self._prefix(self.row, d)], [self.open[d]]
            done = np.flatnonzero((depth[cut[:-1]] >= d + 1) & ((sums[1:-1] >= self.least) | part[cut[:-1]]))
            out += [self._prefix(whole(i), d) for i in cut[done].tolist()]
            counts += sums[1:-1][done].tolist()
            found.append((out, counts, d))
            self.open[d] = int(sums[-1]) if depth[cut[-1]] >= d + 1 else 0
        self.row, self.part = whole(len(suffix) - 1), bool(part[-1])
        return self._out(found)

    def end(self) -> pa.RecordBatch:
        return self._out([([self._prefix(self.row, d)], [self.open[d]], d) for d in range(2, self.max_n + 1) if self.open[d] and (self.open[d] >= self.least or self.part)])

    @staticmethod
    def _prefix(row: bytes, words: int) -> bytes:
        return b"\n".join(row.split(b"\n", words + 1)[: words + 1])


def phrase_counts(suffixes: DataFrame, max_n: int, min_count: int) -> DataFrame:
    """phrase (first word, language, further words, newlines between), words, a: all phrases of 2 to max_n words that stand at least min_count times."""

    def run(batches):
        stack = Stack(max_n, min_count)
        for batch in batches:
            if len(batch):
                yield stack.add(batch.column(0), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy() > 0)
        if stack.row:
            yield stack.end()

    dealt = suffixes.repartition(F.substring_index("suffix", "\n", 2), "salt").sortWithinPartitions(F.desc("suffix"))
    parts = dealt.mapInArrow(run, "phrase string, words int, a bigint")
    return parts.groupBy("phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def _lang(escaped: Column) -> Column:
    """The language, its escapes undone."""
    return F.array_join(F.transform(F.split(escaped, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _score(a: str, left: str, right: str) -> Column:
    """floor(10**6 a a / (left right)) in decimals; the product fits 38 digits up to counts of 10**15."""
    d = lambda c: F.col(c).cast("decimal(15,0)")
    top = (d(a) * d(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, d(left) * d(right))


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language, ranked; shares of a language are cut first, so that no task sorts all its phrases."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for shares in (4096, 64):
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        scored = scored.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top).drop("share", "rank")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, max_n: int = 3, min_count: int = 10, inside_percent: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to max_n words of each language.

    a, l, r are the frequencies of the phrase and of the two parts of its lowest-scoring cut (the first of equal
    ones), n counts all words of the language. A phrase inside a longer candidate that has at
    least inside_percent of its frequency is left out. A null language is `und`; null and empty texts
    have no words; very long texts are taken whole; repeated rows count again; ties go to the phrase in byte order;
    other columns are ignored. No rows, or no phrase frequent enough: no rows.
    """
    words = stored(word_counts(docs, lang_col, text_col))
    total = words.agg(F.sum("n")).first()[0] or 0
    # At most HOT words have a share of 1 / HOT.
    hot = {(r.lang, r.word): -(-r.n * HOT // total) for r in words.where(F.col("n") * HOT > total).collect()}
    found = stored(phrase_counts(_suffixes(docs, _bitmap(words, min_count), hot, max_n, lang_col, text_col), max_n, min_count))
    fields = F.split("phrase", "\n", -1)
    text = F.concat_ws(" ", fields[0], F.array_join(F.slice(fields, F.lit(3), F.col("words") - 1), " "))
    phrases = found.select(_lang(fields[1]).alias("lang"), text.alias("phrase"), "words", "a")
    parts = words.where(F.col("n") >= min_count).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")).unionByName(phrases.select("lang", "phrase", F.col("a").alias("f")))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    piece = F.split("phrase", " ", -1)
    cuts = cuts.withColumn("left", F.array_join(F.slice(piece, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(piece, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    side = lambda name, count: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).withColumn("s", _score("a", "l", "r"))
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("s", "k", "l", "r")).alias("m"))
    # What stands in a longer candidate, and the frequency of the greatest of these.
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' ', -1), i, m), ' '))))")
    inner = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
    best = _first(kept.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.s").alias("score")), top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m, count(*) AS a FROM g, range(1, 4) t(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND a >= 10),
cut AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, l.a AS l, r.a AS r, (1000000 * c.a::HUGEINT * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (
  SELECT low.* FROM low LEFT JOIN longer o ON o.lang = low.lang AND o.phrase = low.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * low.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n ON n.lang = kept.lang
QUALIFY rank <= 2000
"""
