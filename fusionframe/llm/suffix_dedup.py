"""Exact removal of repeated byte strings by distributed prefix doubling over sparse positions.

Ranking every byte of a corpus would sort many times its size, so a first pass finds the
positions that need no ranking. Of every `length` bytes it takes the anchor, the position of the smallest hash of its `SEED`
bytes, which any two equal strings of that length share at the same place. The strings that have one anchor
are a run of 50 to 80 bytes. A run whose anchor is unique is done; one that stands whole in a
smaller document repeats throughout; of the others those strings stay undecided of which at least
four fifths around the anchor stand in another document.

Prefix doubling then ranks the undecided positions. Each brings the names of the bytes at offsets 0, 16 and 32. Spark
sorts the pairs (name at p, name at p + 16), which gives ranks of 32 bytes; positions whose rank is
unique drop out. The rest is sorted again as pairs (rank at p, name at p + 32), which is past the threshold:
a position repeats if a smaller document has the same rank. Rounds are written tables, and each releases its shuffle files.

Names are 64-bit hashes, and no two strings are taken as equal on fewer than 128 bits of them
(anchor and run, or the three names of a position); bytes are not compared again.
In the first pass entries are packed into byte planes by their bucket, over several batches so that many buckets don't make short rows;
Spark deals the buckets, and each task sorts its own. The second pass ranks the names in `TURNS` shares, so that only one share is shuffled at once. Before
each shuffle a batch answers by itself what it can, and sends one entry for a string it has often, so a passage in a third of all
documents is one entry a batch and no task gets it all.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, arrow_map, byte_slices, dropped, mixed, packed, stored, table

SEED = 20
OFFSETS = (0, 16, 32)  # of the names of a position; the last name ends with the string
BATCH_BYTES = 2 << 20
GATHER_BYTES = 8 << 20  # text whose entries are dealt out together
BUCKET_BYTES = 3 << 20
PARTS = 3  # of the places that an anchor can have in a string; each has a digest of what its strings share
ENTRY = np.dtype([("name", "<u8"), ("rest", "<u8"), ("at", "<u4"), ("n", "u1"), ("off", "u1"), ("doc", "<u4"), ("part", "<u2", (PARTS,))])
LONE = np.uint32(0xFFFFFFFF)  # a marker's document
TURNS = 3  # shares of the names
CROWD = 64  # neighbourhoods of one anchor in a batch from which on one marker stands for all

SCHEMA = "bucket int, ids binary, keys binary, entries binary, kind int, marks binary"
TYPES = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("entries", pa.binary()), ("kind", pa.int32()), ("marks", pa.binary())])
MARK = np.dtype([("at", "<u4"), ("n", "<u4")])  # n window starts from `at`
REPEAT, OPEN = 1, 2


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values from each place on; shorter by width - 1."""
    have, m = 1, h
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - have : len(h) - have + 1]) if have < width else m


def _reaches(length: int) -> list[tuple[int, int]]:
    """(least, greatest) place of the anchor in the strings of each part."""
    places = length - SEED + 1
    cut = [places * k // PARTS for k in range(PARTS + 1)]
    return [(a, b - 1) for a, b in zip(cut, cut[1:])]


def _runs(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Entries of the anchors: name, name of the strings that have it, first start, number of starts, place of the anchor in the first string, document, and for each part a digest of what its strings share (0: it has none)."""
    spans = SpanHash(data)
    size = np.diff(starts) - 1
    valid = size >= length
    if not valid.any():
        return np.zeros(0, ENTRY)
    at = np.arange(len(data) - SEED + 1)
    h = mixed((spans.sums[SEED:] - spans.sums[:-SEED]) * spans.back[: len(data) - SEED + 1])
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    key = h >> bits << bits | at.astype(np.uint64)
    low = _least(key, length - SEED + 1)
    ok = np.zeros(len(low) + 1, np.int32)
    np.add.at(ok, starts[:-1][valid], 1)
    np.add.at(ok, np.minimum(starts[1:][valid] - length, len(low)), -1)
    p = np.flatnonzero(np.cumsum(ok)[:-1] > 0)
    anchor = (low[p] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1))))
    first, n = p[cut], np.diff(np.append(cut, len(p)))
    a = anchor[cut]
    off = a - first
    rest = mixed(spans.raw(first, first + n - 1 + length) ^ off.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    e = np.zeros(len(first), ENTRY)
    doc = np.searchsorted(starts, first, "right") - 1
    e["name"], e["rest"], e["at"], e["n"], e["off"], e["doc"] = h[a], rest, first - starts[doc], n, off, doc
    for k, (least, most) in enumerate(_reaches(length)):
        some = np.flatnonzero((off >= least) & (off - n + 1 <= most))
        e["part"][some, k] = spans.of(a[some] - least, a[some] + length - most) >> np.uint64(48) | np.uint64(1)
    return e


def _marks(kind: int, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray):
    """Rows (id, key, kind, marks): one per document."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    doc, at, n = doc[order], at[order], n[order]
    m = np.empty(len(doc), MARK)
    m["at"], m["n"] = at, n
    cut = np.append(np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))), len(doc))
    for a, b in zip(cut, cut[1:]):
        yield int(ids[doc[a]]), int(keys[doc[a]]), kind, m[a:b].tobytes()


def _mark_columns(rows: list[tuple]) -> dict:
    word = lambda x: x.to_bytes(8, "little", signed=True)
    return {"bucket": [r[0] & 0x7FFFFFFF for r in rows], "ids": [word(r[0]) for r in rows], "keys": [word(r[1]) for r in rows], "entries": [None] * len(rows), "kind": [r[2] for r in rows], "marks": [r[3] for r in rows]}


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by their place, so that those which say nothing lie together for Spark's compression."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _of_planes(data: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _has_part(e: np.ndarray, reaches: list[tuple[int, int]]) -> np.ndarray:
    """Which digests entries have: other ones are 0."""
    off, last = e["off"].astype(np.int64), e["off"].astype(np.int64) - e["n"] + 1
    return np.stack([(off >= least) & (last <= most) for least, most in reaches], 1)


def _packed_entries(e: np.ndarray, ids: np.ndarray, keys: np.ndarray, buckets: int, reaches: list[tuple[int, int]]):
    """One row per bucket, some MB of them at once, with the documents that its entries name in the order of their ids. What the bucket says of a name, and the digests that an entry can't have, are left out."""
    out: dict[str, list] = {n: [] for n in TYPES.names}
    place = np.lexsort((keys, ids))
    ids, keys = ids[place], keys[place]
    back = np.empty(len(place), np.int64)
    back[place] = np.arange(len(place))
    lone = e["doc"] == LONE
    doc = np.where(lone, len(ids), back[np.where(lone, 0, e["doc"])])
    own = e["name"] % np.uint64(buckets)
    order = np.argsort(own * np.uint64(len(ids) + 1) + doc.astype(np.uint64))
    e, own, doc, lone = e[order], own[order], doc[order], lone[order]
    name, has = e["name"] // np.uint64(buckets), _has_part(e, reaches)
    new_bucket = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    new_doc = (new_bucket | np.concatenate(([True], doc[1:] != doc[:-1])) if len(own) else new_bucket) & ~lone
    cut, size = np.append(np.flatnonzero(new_bucket), len(own)), 0
    for a, b in zip(cut, cut[1:]):
        x, docs = e[a:b], doc[a:b][new_doc[a:b]]
        told = np.where(lone[a:b], 2, new_doc[a:b]).astype(np.uint8)
        packed_ = b"".join((int(b - a).to_bytes(4, "little"), _planes(name[a:b]), x["rest"].tobytes(), _planes(x["at"]), x["n"].tobytes(), x["off"].tobytes(), told.tobytes(), x["part"][has[a:b]].tobytes()))
        for n, v in (("bucket", int(own[a])), ("ids", _planes(np.diff(ids[docs], prepend=0))), ("keys", keys[docs].tobytes()), ("entries", packed_), ("kind", None), ("marks", None)):
            out[n].append(v)
        size += len(packed_) + 16 * len(docs)
        if size >= BATCH_BYTES:
            yield out
            out, size = {n: [] for n in TYPES.names}, 0
    yield out


def _unpacked_entries(data: bytes, bucket: int, buckets: int, reaches: list[tuple[int, int]]) -> np.ndarray:
    """The entries of a row, with its documents numbered from 0."""
    m = int.from_bytes(data[:4], "little")
    x = np.frombuffer(data, np.uint8, offset=4)
    e = np.zeros(m, ENTRY)
    e["name"] = _of_planes(x[: 8 * m], "<u8") * np.uint64(buckets) + np.uint64(bucket)
    e["rest"] = x[8 * m : 16 * m].view("<u8")
    e["at"] = _of_planes(x[16 * m : 20 * m], "<u4")
    e["n"], e["off"], told = x[20 * m : 21 * m], x[21 * m : 22 * m], x[22 * m : 23 * m]
    e["doc"] = np.where(told == 2, LONE, (np.cumsum(told == 1) - 1).astype(np.uint32))
    e["part"][_has_part(e, reaches)] = x[23 * m :].view("<u2")
    return e


def _sorted_groups(e: np.ndarray, ids: np.ndarray):
    """Entries in order of name, rest and document id, and where names and pairs begin."""
    lone = e["doc"] == LONE
    doc = np.where(lone, np.int64(2**63 - 1), ids[np.where(lone, 0, e["doc"])] if len(ids) else 0)
    order = np.lexsort((doc, e["rest"], e["name"]))
    e, doc = e[order], doc[order]
    new_name = np.concatenate(([True], e["name"][1:] != e["name"][:-1]))
    new_pair = new_name | np.concatenate(([True], e["rest"][1:] != e["rest"][:-1]))
    return e, doc, new_name, new_pair


def _per_group(first: np.ndarray, values: np.ndarray, f) -> np.ndarray:
    """f.reduceat over groups, spread to their members."""
    at = np.flatnonzero(first)
    return np.repeat(f.reduceat(values, at), np.diff(np.append(at, len(first))))


def _ids_of(batch: pa.RecordBatch, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)


def _seed_rows(length: int, buckets: int):
    reaches = _reaches(length)

    def rows(batch: pa.RecordBatch):
        gathered: list[tuple] = []
        size = base = 0

        def dealt():
            return _packed_entries(*(np.concatenate(x) for x in zip(*gathered, strict=True)), buckets, reaches)

        for a, b in byte_slices(batch.column(2), BATCH_BYTES):
            ids, keys = _ids_of(batch, a, b)
            data, starts = packed(batch.column(2).slice(a, b - a))
            e = _runs(data, starts, length)
            if not len(e):
                continue
            e, own, new_name, new_pair = _sorted_groups(e, ids)
            repeat = own > _per_group(new_pair, own, np.minimum)
            crowd = (_per_group(new_name, new_pair.astype(np.int64), np.add) >= CROWD) & (_per_group(new_name, own, np.minimum) != _per_group(new_name, own, np.maximum))
            open_ = crowd & ~repeat
            marker = e[crowd & new_name].copy()
            marker["doc"], marker["rest"] = LONE, 0
            yield _mark_columns([*_marks(REPEAT, ids, keys, e["doc"][repeat], e["at"][repeat], e["n"][repeat]), *_marks(OPEN, ids, keys, e["doc"][open_], e["at"][open_], e["n"][open_])])
            kept = e[~repeat & ~open_]
            kept["doc"] += np.uint32(base)
            gathered.append((np.concatenate((kept, marker)), ids, keys))
            size, base = size + len(data), base + len(ids)
            if size >= GATHER_BYTES:
                yield from dealt()
                gathered, size, base = [], 0, 0
        if gathered:
            yield from dealt()

    return rows


def _gathered(pdf, buckets: int, reaches: list[tuple[int, int]]):
    """(entries with documents numbered over all rows, ids, keys)."""
    some = pdf[pdf["entries"].notna()]
    parts, ids, keys, base = [], [], [], 0
    for bucket, x, i, k in zip(some["bucket"], some["entries"], some["ids"], some["keys"]):
        e = _unpacked_entries(x, int(bucket), buckets, reaches)
        e["doc"][e["doc"] != LONE] += np.uint32(base)
        parts.append(e)
        ids.append(np.cumsum(_of_planes(np.frombuffer(i, np.uint8), "<i8")))
        keys.append(np.frombuffer(k, np.int64))
        base += len(ids[-1])
    if not parts:
        return np.zeros(0, ENTRY), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(ids), np.concatenate(keys)


def _answers(pdf, rows: list[tuple]):
    import pandas as pd

    own = pdf[pdf["marks"].notna()]
    word = lambda x: int.from_bytes(x, "little", signed=True)
    kept = [(word(i), word(k), int(t), m) for i, k, t, m in zip(own["ids"], own["keys"], own["kind"], own["marks"])]
    return pd.DataFrame([*kept, *rows], columns=["id", "key", "kind", "marks"]).astype({"id": "int64", "key": "int64", "kind": "int32"})


def _judge_seeds(length: int, buckets: int):
    reaches = _reaches(length)

    def judge(pdf):
        e, ids, keys = _gathered(pdf, buckets, reaches)
        if not len(e):
            return _answers(pdf, [])
        e, own, new_name, new_pair = _sorted_groups(e, ids)
        marker = e["doc"] == LONE
        repeat = (own > _per_group(new_pair, own, np.minimum)) & ~marker
        crowded = _per_group(new_name, marker, np.logical_or) & ~repeat & ~marker
        rows = [*_marks(REPEAT, ids, keys, e["doc"][repeat], e["at"][repeat], e["n"][repeat]), *_marks(OPEN, ids, keys, e["doc"][crowded], e["at"][crowded], e["n"][crowded])]
        group = np.cumsum(new_name).astype(np.uint64)
        off, n = e["off"].astype(np.int64), e["n"].astype(np.int64)
        for k, (least, most) in enumerate(reaches):
            digest = e["part"][:, k]
            order = np.argsort(group << np.uint64(16) | digest.astype(np.uint64), kind="stable")
            g, x, d, r = group[order], digest[order], own[order], e["rest"][order]
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])))
            shared = np.zeros(len(e), bool)
            shared[order] = (_per_group(new, d, np.minimum) != _per_group(new, d, np.maximum)) & (_per_group(new, r, np.minimum) != _per_group(new, r, np.maximum)) & (x != 0)
            shared &= ~repeat & ~marker & ~crowded
            a, b = np.maximum(0, off - most), np.minimum(n - 1, off - least)
            rows += _marks(OPEN, ids, keys, e["doc"][shared], (e["at"] + a)[shared], (b - a + 1)[shared])
        return _answers(pdf, rows)

    return judge


POSITIONS = "id bigint, key bigint, at int, h0 bigint, h1 bigint, h2 bigint, marks binary"
POSITION_TYPES = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("h0", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("marks", pa.binary())])


def _position_rows(length: int):
    """The undecided positions with the names at their offsets; those that a smaller document of the batch repeats as marks."""
    ends = (*OFFSETS[1:], length)

    def rows(batch: pa.RecordBatch):
        for a, b in byte_slices(batch.column(2), BATCH_BYTES // 2):
            ids, keys = _ids_of(batch, a, b)
            data, starts = packed(batch.column(2).slice(a, b - a))
            at, doc = [], []
            for i, marks in enumerate(batch.column(3).slice(a, b - a).to_pylist()):
                m = np.frombuffer(b"".join(marks), MARK)
                n = m["n"].astype(np.int64)
                own = np.unique(np.repeat(m["at"].astype(np.int64) - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()))
                at.append(own)
                doc.append(np.full(len(own), i))
            at, doc = np.concatenate(at), np.concatenate(doc)
            if not len(at):
                continue
            p, spans = starts[doc] + at, SpanHash(data)
            h = [spans.of(p + x, p + y) for x, y in zip(OFFSETS, ends)]
            order = np.lexsort((at, ids[doc], h[2], h[1], h[0]))
            at, doc, h = at[order], doc[order], [x[order] for x in h]
            own = ids[doc]
            new = np.concatenate(([True], (h[0][1:] != h[0][:-1]) | (h[1][1:] != h[1][:-1]) | (h[2][1:] != h[2][:-1])))
            repeat = own > _per_group(new, own, np.minimum)
            known = list(_marks(REPEAT, ids, keys, doc[repeat], at[repeat], np.ones(int(repeat.sum()), np.int64)))
            none = [None] * len(known)
            yield {"id": [r[0] for r in known], "key": [r[1] for r in known], "at": none, "h0": none, "h1": none, "h2": none, "marks": [r[3] for r in known]}
            # One position of the smallest document stands for all of the batch; it brings the others of this document that have the same string.
            first = np.flatnonzero(new)
            also: list[bytes | None] = [None] * len(first)
            again = np.flatnonzero(~new & ~repeat)
            group = np.cumsum(new)[again] - 1
            cut = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(again)) if len(again) else np.zeros(1, int)
            for x, y in zip(cut, cut[1:]):
                m = np.ones(y - x, MARK)
                m["at"] = at[again[x:y]]
                also[group[x]] = m.tobytes()
            yield {"id": own[first], "key": keys[doc[first]], "at": at[first].astype(np.int32), **{f"h{k}": x[first].view(np.int64) for k, x in enumerate(h)}, "marks": also}

    return rows


def _doubled(positions: DataFrame, rank: list[str], after: str) -> DataFrame:
    """One round: positions sorted by the pair (rank, name at the next offset), without those whose new rank is unique.

    A rank is named by the first position that has it (r_id, r_at), so ranks can't collide; lowest is the smallest document of it.
    """
    w = Window.partitionBy(*rank, after)
    ranked = positions.withColumn("first", F.min(F.struct("id", "at")).over(w)).withColumn("most", F.max("id").over(w)).where(F.col("first.id") < F.col("most"))
    kept = [c for c in positions.columns if c not in (*rank, after)]
    return ranked.select(*kept, F.col("first.id").alias("r_id"), F.col("first.at").alias("r_at"))


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells texts of one id apart: a hash of the text, or nothing where ids are unique."""
    twice = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64(text_col)


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables of window starts whose `length` bytes also start in a document of smaller id: (id, key, marks: packed runs) and (id, key, at, marks). key tells texts of one id apart."""
    if not OFFSETS[-1] < length < 256 + SEED:
        raise ValueError(f"length has to be over {OFFSETS[-1]} and under {256 + SEED}")
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (_key(docs, id_col, text_col) if key is None else key).alias("key"), F.col(text_col).cast("binary").alias("b")).where(F.octet_length("b") >= length)
    total = own.agg(F.sum(F.octet_length("b")).alias("n")).first().n or 0
    buckets = max(1, -(-int(total) // BUCKET_BYTES))
    answer = "id bigint, key bigint, kind int, marks binary"
    dealt = arrow_map(own, _seed_rows(length, buckets), SCHEMA, TYPES).withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    first = stored(dealt.groupBy("bucket").applyInPandas(_judge_seeds(length, buckets), answer))
    undecided = first.where(F.col("kind") == OPEN).groupBy("id", "key").agg(F.collect_list("marks").alias("open"))
    text = own.join(undecided, ["id", "key"]).select("id", "key", "b", "open")
    positions = stored(arrow_map(text, _position_rows(length), POSITIONS, POSITION_TYPES))
    turns, past = min(TURNS, buckets), []
    for k in range(turns):
        share = positions.where(F.col("at").isNotNull() & (F.pmod("h0", F.lit(turns)) == k))
        ranked = stored(_doubled(share, ["h0"], "h1"))
        past.append(stored(_doubled(ranked, ["r_id", "r_at"], "h2").where("id > r_id").select("id", "key", "at", "marks")))
        dropped(ranked)
    marks = stored(first.where(F.col("kind") == REPEAT).select("id", "key", "marks").union(positions.where("at is null").select("id", "key", "marks")))
    dropped(first, positions)
    return marks, functools.reduce(DataFrame.union, past)


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct(start, end)> (bytes), and with `keep_text` the kept bytes: one row per input row.

    A byte goes if a string of `length` bytes that covers it also starts in a document of a smaller
    id; strings are those of the input. A null text counts as empty. Texts shorter than `length`,
    and rows with a null id, lose nothing and take nothing from others. Rows of one id take
    nothing from each other, whether their texts are equal or not. Very long texts are taken whole, at about 100 bytes of memory
    a byte of text; no rows give no rows; other columns are ignored. Ids are whole numbers, or texts of digits; others are an error.
    """
    key = _key(docs, id_col, text_col)
    marks, singles = repeated_spans(docs, length, id_col, text_col, key)
    found = marks.select("id", "key", "marks", F.lit(None).cast("int").alias("at")).union(singles.select("id", "key", "marks", "at")).groupBy("id", "key").agg(F.collect_list("marks").alias("marks"), F.collect_list("at").alias("at"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("b"))
    types = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *[("kept", pa.binary())] * keep_text])

    def one(text: bytes, marks: list[bytes] | None, single: list[int] | None) -> tuple:
        m = np.frombuffer(b"".join(marks or []), MARK)
        if not len(m) and not single:
            return len(text), 0, 0, hashlib.sha256(text).hexdigest(), [], text
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, m["at"], 1)
        np.add.at(edge, m["at"].astype(np.int64) + m["n"] - 1 + length, -1)
        if single:
            np.add.at(edge, np.array(single), 1)
            np.add.at(edge, np.array(single) + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8))).reshape(-1, 2)
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return len(text), int(gone.sum()), len(turn), hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in turn], kept

    def rows(batch: pa.RecordBatch):
        for a, b in byte_slices(batch.column(1)):
            made = [one(*x) for x in zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield {id_col: batch.column(0).slice(a, b - a)} | {name: [x[k] for x in made] for k, name in enumerate(types.names[1:])}

    joined = own.join(found, ["id", "key"], "left").select("id", "b", "marks", "at")
    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>" + ", kept binary" * keep_text
    return arrow_map(joined, rows, schema, types)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


#: Over tables whose ids are unique.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
s AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) AS p FROM d WHERE n_bytes >= 50)),
f AS (SELECT s, min(doc_id) AS lowest FROM s GROUP BY s),
r AS (SELECT s.doc_id, p FROM s JOIN f USING (s) WHERE lowest < s.doc_id),
t AS (SELECT doc_id, p, sum(CASE WHEN p - last <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM r)),
u AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM t GROUP BY doc_id, run),
v AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
k AS (SELECT v.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept FROM v JOIN d USING (doc_id) GROUP BY v.doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
