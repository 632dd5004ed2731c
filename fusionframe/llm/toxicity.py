"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or not: hashed words, word beginnings, word pairs, and skip-grams over one
word. Each coordinate has its own learning rate, and the L1 term keeps most weights at zero,
so what goes to the executors is a short list of buckets and weights. The fit takes a bounded
sample of labelled rows (`sample_rows`, smallest hash of the id first); all else covers every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, arrow_map, byte_slices, gram_hashes, lowered, mixed, packed, schema_of, table, to_arrow_schema, word_spans

BITS = 20
STEMS = (5, 7)  # characters from a word's start that are features of their own


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    bits: int


def _features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature occurrence."""
    data, starts = packed(column)
    low = lowered(data)
    begin, end, text = word_spans(low, starts, alnum=True)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = SpanHash(low)
    words = spans.of(begin, end)
    kinds = [(words, text)]
    chars = np.concatenate(([0], np.cumsum((low & 0xC0) != 0x80)))  # code points before each byte
    lead = np.flatnonzero((low & 0xC0) != 0x80)
    for n in STEMS:
        long = np.flatnonzero(chars[end] - chars[begin] > n)
        stop = lead[chars[begin[long]] + n]
        kinds.append((mixed(spans.raw(begin[long], stop) + np.uint64(n)), text[long]))
    for n, salt in ((2, 2), (1, 3)):
        if salt == 2:
            h, at = gram_hashes(words, text, n)
            kinds.append((h ^ np.uint64(0x5851F42D4C957F2D), text[at]))
        elif len(words) > 2:
            at = np.flatnonzero(text[:-2] == text[2:])
            kinds.append((mixed(words[at] * np.uint64(3) + words[at + 2] + np.uint64(11)), text[at]))
    return np.concatenate([t for _, t in kinds]), (np.concatenate([h for h, _ in kinds]) >> np.uint64(64 - bits)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0) -> Model:
    """Per-coordinate FTRL-proximal over rows of feature buckets, in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    bias = 0.0
    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > l1, (np.sign(zx) * l1 - zx) / ((beta + np.sqrt(nx)) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    kept = np.flatnonzero(w)
    return Model(kept, w[kept].astype(np.float64), float(bias), bits)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on at most `sample_rows` labelled ids whose crc32 mod 5 isn't 0; None without any.

    Rows with a null id or label are left out; an id labelled twice counts as toxic if it is once.
    """
    key = F.col(id_col)
    kept = labels.where(key.isNotNull() & F.col(label_col).isNotNull() & (F.crc32(key.cast("string").cast("binary")) % 5 != 0)).groupBy(key).agg(F.max((F.col(label_col) != 0).cast("int")).alias("y"))
    chosen = kept.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).select(F.col(id_col).alias("k"), "y").collect()
    if not chosen:
        return None
    y_of = {r.k: r.y for r in chosen}
    ids = docs.sparkSession.createDataFrame([(k,) for k in y_of], "k bigint")  # at most sample_rows ids

    def rows(batch: pa.RecordBatch):
        for a, b in byte_slices(batch.column(1)):
            text, bucket = _features(batch.column(1).slice(a, b - a), bits)
            keys = np.unique(text << bits | bucket)
            cut = np.searchsorted(keys >> bits, np.arange(b - a + 1))
            own = (keys & ((1 << bits) - 1)).astype(np.int32)
            yield {"k": batch.column(0).slice(a, b - a), "x": [own[i:j].tobytes() for i, j in zip(cut, cut[1:])]}

    mine = docs.select(key.alias("k"), text_col).join(F.broadcast(ids), "k", "left_semi")
    got = arrow_map(mine, rows, "k bigint, x binary", pa.schema([("k", pa.int64()), ("x", pa.binary())])).collect()
    got = sorted(((r.k * 0x9E3779B97F4A7C15 & (1 << 64) - 1, r.k, bytes(r.x)) for r in got))
    if not got:
        return None
    return ftrl([np.frombuffer(x, np.int32) for _, _, x in got], np.array([y_of[k] for _, k, _ in got], float), bits)


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, score double between 0 and 1, predicted int, one row per input row.

    Null and empty texts get the score of the bias alone; without a model every score is 0. Very long
    texts are taken whole; repeated rows are scored alike; a null id stays null; other columns are ignored, or
    those in `keep` are passed through, before score and predicted. Without `keep`, ids are whole numbers, or texts of digits.
    """
    own = docs.select(*keep) if keep else docs.select(F.col(id_col).cast("long"), text_col)
    out = own.columns if keep else [id_col]
    at = own.columns.index(text_col)
    kept = to_arrow_schema(own.select(*out).schema)
    types = pa.schema([*kept, ("score", pa.float64()), ("predicted", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch):
        m = shared.value
        dense = np.zeros(1 << m.bits, np.float64) if m else None
        if m:
            dense[m.buckets] = m.weights
        for a, b in byte_slices(batch.column(at)):
            score = np.zeros(b - a)
            if m:
                text, bucket = _features(batch.column(at).slice(a, b - a), m.bits)
                hit = np.flatnonzero(dense[bucket])
                keys = np.unique(text[hit] << m.bits | bucket[hit])
                total = np.bincount(keys >> m.bits, dense[keys & ((1 << m.bits) - 1)], b - a)
                score = 1 / (1 + np.exp(-np.clip(total + m.bias, -35, 35)))
            yield {c: batch.column(k).slice(a, b - a) for k, c in enumerate(out)} | {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return arrow_map(own, rows, schema_of(own, out) + ", score double, predicted int", types)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
