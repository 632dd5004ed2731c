"""N-gram Jaccard self-join by MinHash banding, with exact verification.

Documents with the same set of word n-grams are one class at once: they are never compared.
One representative of each class is signed; rows and bands are chosen for a target
recall at the threshold, and the shuffle is on band keys. A band key with few documents gives
their pairs. Keys with more than `small` documents are joined to components first; a
component is laid out in blocks, each pair of blocks is one task's work, and what comes out is
a spanning forest of the links and counts of links, never the pairs. Both ways verify on the full
n-gram sets, every pair is judged once, and no candidate is dropped. N-grams are told apart by 32-bit hashes: two
sets of 500 have a false common one with a chance of 6e-5, which moves their similarity by 0.002.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, arrow_map, byte_slices, dropped, gram_hashes, packed, stored, table, word_spans
from .components import connected_components

BLOCK = 128


def choose_bands(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands find a pair at the threshold with at least `recall`.

    A ValueError says that no choice of at most `most` hashes reaches it.
    """
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = (max(1, bands), rows)
    if best is None:
        raise ValueError(f"no choice of {most} hashes finds pairs at {threshold} with recall {recall}")
    return best


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit n-gram hashes, sorted and distinct within each text; row limits). A text of fewer words has one gram, of all its words."""
    data, starts = packed(column)
    begin, end, text = word_spans(data, starts)
    words = SpanHash(data).of(begin, end) if len(begin) else np.zeros(0, np.uint64)
    grams, at = gram_hashes(words, text, n)
    owner = text[at]
    per = np.bincount(text, minlength=len(column))
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        first = np.searchsorted(text, short)
        extra = np.array([words[f : f + per[t]].astype(object) @ np.array([3**k for k in range(1, per[t] + 1)], object) % (1 << 64) for t, f in zip(short, first)], np.uint64)
        grams, owner = np.concatenate((grams, extra)), np.concatenate((owner, short))
    keys = np.unique(owner.astype(np.uint64) << np.uint64(32) | grams >> np.uint64(32))
    limits = np.searchsorted(keys >> np.uint64(32), np.arange(len(column) + 1, dtype=np.uint64))
    return keys.astype(np.uint32), limits


def _signatures(grams: np.ndarray, limits: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) keys of the band's minima; all texts have grams."""
    rng = np.random.default_rng(11)
    mult = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    g = grams ^ (grams >> np.uint32(16))
    g = g * np.uint32(0x85EBCA6B)
    g ^= g >> np.uint32(13)
    out = np.zeros((len(limits) - 1, bands), np.uint64)
    tmp = np.empty_like(g)
    for k in range(bands * rows):
        np.multiply(g, mult[k], out=tmp)
        np.add(tmp, add[k], out=tmp)
        least = np.minimum.reduceat(tmp, limits[:-1]).astype(np.uint64)
        b = k // rows
        out[:, b] = (out[:, b] ^ least) * np.uint64(0x9E3779B97F4A7C15)
        out[:, b] ^= out[:, b] >> np.uint64(29)
    return out


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a), len(b)) sizes of the common sets."""
    vocab, inverse = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    sizes = [len(x) for x in (*a, *b)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(a), len(b)), np.float32)
    step = max(1, (1 << 22) // len(sizes))
    order = np.argsort(inverse, kind="stable")
    cut = np.searchsorted(inverse[order], np.arange(0, len(vocab) + step, step))
    for k in range(len(cut) - 1):
        part = order[cut[k] : cut[k + 1]]
        m = np.zeros((len(sizes), min(step, len(vocab) - k * step)), np.float32)
        m[row[part], inverse[part] - k * step] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _linked(common: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    return common >= threshold * (na[:, None] + nb[None, :] - common) - 1e-6


def signed_sets(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows_a_band: int) -> DataFrame:
    """id, rep (hash of the set, null without words), grams binary (sorted 32-bit hashes), keys array<bigint> (one a band)."""
    types = pa.schema([("id", pa.int64()), ("rep", pa.int64()), ("grams", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def rows(batch: pa.RecordBatch):
        for a, b in byte_slices(batch.column(1)):
            grams, limits = _sets(batch.column(1).slice(a, b - a), n)
            raw = [grams[i:j].tobytes() for i, j in zip(limits, limits[1:])]
            some = np.flatnonzero(np.diff(limits))
            keys: list = [None] * len(raw)
            if len(some):
                for k, own in zip(some, _signatures(grams, np.append(limits[some], limits[-1]), bands, rows_a_band).view(np.int64), strict=True):
                    keys[k] = own
            rep = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) if x else None for x in raw]
            yield {"id": batch.column(0).slice(a, b - a), "rep": rep, "grams": raw, "keys": keys}

    return arrow_map(docs.select(F.col(id_col).cast("long"), text_col), rows, "id bigint, rep bigint, grams binary, keys array<bigint>", types)


def _pairs(keys: DataFrame, members: DataFrame) -> DataFrame:
    """a < b, once per pair, of documents that share a key and aren't in one large component; `keys` have few documents each."""
    own = keys.join(members, "rep", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "component"))).alias("m"))

    def later(x, i):
        rest = F.filter(F.slice("m", i + 2, F.size("m")), lambda y: ~F.coalesce(x["component"] == y["component"], F.lit(False)))
        return F.transform(rest, lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))

    return own.select(F.explode(F.flatten(F.transform("m", later))).alias("p")).select("p.*").distinct()


def _verified(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs whose full sets are similar enough, once each."""
    joined = pairs.join(grams.select(F.col("rep").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("rep").alias("b"), F.col("grams").alias("gb")), "b").select("a", "b", "ga", "gb")
    types = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def similar(p: np.ndarray, q: np.ndarray) -> bool:
        if min(len(p), len(q)) < threshold * max(len(p), len(q)):
            return False
        both = np.concatenate((p, q))
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return common >= threshold * (len(p) + len(q) - common) - 1e-6

    def rows(batch: pa.RecordBatch):
        keep = pa.array([similar(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
        yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return arrow_map(joined, rows, "a bigint, b bigint", types).distinct()


def _forest(rows: np.ndarray, cols: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the same nodes as all links do, fewer than there are nodes."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(rows.tolist(), cols.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(ids[x]), int(ids[y])))
    return out


def _large_links(members: DataFrame, grams: DataFrame, threshold: float, block: int) -> DataFrame:
    """a, b, n: forest edges (n null), and for each document of a block pair the documents linked there (b null), within components of (rep, component)."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = members.join(sizes, "component").select("rep", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("mine"))
    work = placed.join(grams, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("rep", "copies", "grams", "mine", "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def judge(key, pdf):
        import pandas as pd

        _, i, j = key
        pdf = pdf.drop_duplicates("rep").sort_values("rep")
        ids, copies, mine = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["mine"].to_numpy()
        sets = [np.frombuffer(x, np.uint32) for x in pdf["grams"]]
        n = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        counts, edges = np.zeros(len(ids), np.int64), []
        if len(left) and len(right):
            link = _linked(_intersections([sets[k] for k in left], [sets[k] for k in right]), n[left], n[right], threshold)
            if i == j:
                np.fill_diagonal(link, False)
            counts[left] += link @ copies[right]
            if i != j:
                counts[right] += link.T @ copies[left]
            r, c = np.nonzero(link)
            edges = _forest(left[r], right[c], ids)
        some = np.flatnonzero(counts)
        return pd.DataFrame({"a": pd.array([x for x, _ in edges] + ids[some].tolist(), "Int64"), "b": pd.array([y for _, y in edges] + [None] * len(some), "Int64"), "n": pd.array([None] * len(edges) + counts[some].tolist(), "Int64")})

    return work.groupBy("component", "i", "j").applyInPandas(judge, "a bigint, b bigint, n bigint")


def ngram_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, small: int = 32, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, n_links, n_copies: one row per document.

    class_id is the smallest id of the documents joined by links (Jaccard similarity of the word
    n-gram sets at `threshold` or more), n_links the number of other documents linked to this one
    directly, n_copies that of other documents with the same set. Words are split at ASCII
    white space; a text of fewer than n words has one gram of them all. A null or empty text, or one
    of white space, has no grams and is a class of its own, as is a row with a null id (class_id
    null). A repeated row counts as another document; where one id has several texts, each row
    goes by its own text. Very long texts are taken whole. No rows give no rows; other columns are ignored. Ids are whole
    numbers, or texts of digits; others are an error.
    """
    bands, per = choose_bands(threshold, recall)
    signed = stored(signed_sets(docs, id_col, text_col, n, bands, per))
    known = signed.where(F.col("id").isNotNull() & F.col("rep").isNotNull())
    classes = stored(known.groupBy("rep").agg(F.min("id").alias("low"), F.count("*").alias("copies")))
    # Copies fall together in distinct(), before the shuffle where they meet in one task.
    keys = known.select("rep", F.posexplode("keys").alias("band", "k")).select(F.xxhash64("band", "k").alias("key"), "rep").distinct()
    counts = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("first")).where("c > 1")
    shared = stored(keys.join(counts, "key"))
    members = connected_components(shared.where(F.col("c") > small).select(F.col("first").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("rep"), "component")
    pairs = stored(_pairs(shared.where(F.col("c") <= small).select("key", "rep"), members))
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(members.select("rep")).distinct().join(classes, "rep")
    grams = stored(known.select("id", F.col("rep").alias("own"), "grams").join(wanted, (F.col("id") == F.col("low")) & (F.col("own") == F.col("rep"))).select("rep", "copies", "grams"))
    links = stored(_verified(pairs, grams, threshold))
    large = stored(_large_links(members, grams, threshold, block))
    rows = stored(signed.select("id", "rep"))
    dropped(shared, pairs, grams, signed)
    found = connected_components(links.union(large.where("b is not null").select("a", "b"))).select(F.col("node").alias("rep"), "component")
    ways = links.union(links.select("b", "a"))
    degree = ways.join(classes.select(F.col("rep").alias("b"), "copies"), "b").select(F.col("a").alias("rep"), F.col("copies").alias("n")).union(large.where("b is null").select("a", "n")).groupBy("rep").agg(F.sum("n").alias("n"))
    lows = found.join(classes, "rep").groupBy("component").agg(F.min("low").alias("class_id"))
    linked = found.join(lows, "component").select("rep", "class_id")
    per_class = stored(classes.join(linked, "rep", "left").join(degree, "rep", "left").select("rep", F.coalesce("class_id", "low").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies")))  # on its own, so that the join below can split the rows of a hot class
    out = rows.where(F.col("id").isNotNull() & F.col("rep").isNotNull()).join(per_class, "rep").select("id", "class_id", "n_links", "n_copies")
    alone = rows.where(F.col("id").isNull() | F.col("rep").isNull()).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return out.union(alone).withColumnRenamed("id", id_col)


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT rid, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.rid <> b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y, k = a.n AND k = b.n AS copy FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE k >= 0.8e0 * (a.n + b.n - k) - 1e-6),
c AS (SELECT rid, rid AS root FROM w UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.rid),
m AS (SELECT c.rid, min(r.doc_id) AS class_id FROM c JOIN w r ON r.rid = c.root GROUP BY c.rid),
d AS (SELECT x AS rid, count(*) AS n_links, count(*) FILTER (WHERE copy) AS n_copies FROM l GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 0)::BIGINT AS n_copies FROM w JOIN m USING (rid) LEFT JOIN d USING (rid)
"""
