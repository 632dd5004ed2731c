"""Corpus-wide operators against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fusionframe.llm import components, decontaminate, mixing, ngram_join, suffix_dedup

from .test_text_operators import AWKWARD, awkward, nothing  # noqa: F401


def brute_links(rows, n=5, threshold=0.8):
    """(class, links) by row position."""
    sets = []
    for _, x in rows:
        w = (x or "").split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = collections.defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low[find(i)], d)
    return [(d, low[find(i)], links[i]) for i, (d, _) in enumerate(rows)]


def near_copies(seed=2, groups=12, most=30):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(500)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.randint(1, most)):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append(" ".join(x))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small,block", [(32, 128), (2, 4)])
def test_ngram_join(spark, small, block):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_join(df, small=small, block=block).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute_links(rows))


def test_bands():
    for s, r in ((0.8, 0.9995), (0.5, 0.9), (1.0, 0.99)):
        bands, rows = ngram_join.choose_bands(s, r)
        assert 1 - (1 - s**rows) ** bands >= r


def test_ngram_join_awkward(spark, awkward, nothing):  # noqa: F811
    got = ngram_join.ngram_join(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert (by[5].n_links, by[5].n_copies, by[1].n_links, by[None].class_id) == (1, 1, 0, None)
    assert ngram_join.ngram_join(nothing).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_components_stars(spark):
    """Stars of low and of high ends, linked by single edges in both directions, and chance edges, against union by repeated minima."""
    rng = np.random.default_rng(5)
    edges = [(0, k) for k in range(1, 200)] + [(999, k) for k in range(300, 500)] + [(199, 450)] + [tuple(x) for x in rng.integers(1000, 1400, (300, 2)).tolist()]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        before = dict(label)
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def brute_repeats(rows, length=50):
    first = {}
    texts = [(i, (x or "").encode()) for i, x in rows]
    for i, x in texts:
        for p in range(len(x) - length + 1):
            g = x[p : p + length]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, x in texts:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if first[x[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(x)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(x), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("alphabet,seed,crowd", [("ab", 1, 2), ("abcdefghé", 2, 64), ("xyz", 3, 3)])
def test_suffix_dedup(spark, monkeypatch, alphabet, seed, crowd):
    rng = random.Random(seed)
    base = "".join(rng.choice(alphabet) for _ in range(3000))
    rows = []
    for i in range(90):
        x = ""
        for _ in range(rng.randint(0, 6)):
            a = rng.randrange(2900)
            x += base[a : a + rng.choice([20, 49, 50, 51, 60, 90, 300])] + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        rows.append((i // 2 if i > 80 else i, x + "z" * rng.choice([0, 0, 120])))  # some ids have two texts
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_suffix_dedup_awkward(spark, awkward, nothing):  # noqa: F811
    got = suffix_dedup.suffix_dedup(awkward, keep_text=True).collect()
    assert len(got) == len(AWKWARD) and all(r.n_removed == 0 for r in got)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_suffix_dedup_disk(spark, monkeypatch):
    """What is shuffled hardly grows with the number of buckets: rows span batches, ids of one text bring no hash of it, and packed entries are what they were. Positions are ranked in shares."""
    import pyarrow as pa

    rng = np.random.default_rng(14)
    texts = [rng.integers(97, 123, 3000, dtype=np.uint8).tobytes() for _ in range(2000)]
    ids = pa.array(np.arange(2000) * 3 - 2500)
    batch = pa.record_batch([ids, pa.array(np.zeros(2000, np.int64)), pa.array(texts)], names=["id", "key", "b"])
    size = {}
    for buckets in (50, 2000):
        rows = [r for x in suffix_dedup._seed_rows(50, buckets)(batch) for r in zip(*x.values(), strict=True) if r[3] is not None]
        assert len(rows) == buckets
        size[buckets] = sum(len(pa.compress(b"".join(r[1:4]), "lz4", asbytes=True)) for r in rows)
    n = size[50] / 26  # about 26 bytes an entry
    assert size[2000] < 1.15 * size[50] and 300_000 < n < 450_000
    pdf = pa.table({"bucket": [r[0] for r in rows], "ids": [r[1] for r in rows], "keys": [r[2] for r in rows], "entries": [r[3] for r in rows]}).to_pandas()
    e, own, _ = suffix_dedup._gathered(pdf, 2000, suffix_dedup._reaches(50))
    data, starts = suffix_dedup.packed(batch.column(2))
    want = suffix_dedup._runs(data, starts, 50)
    fields = lambda e, doc: sorted(zip(doc.tolist(), e["at"].tolist(), e["name"].tolist(), e["rest"].tolist(), e["n"].tolist(), e["off"].tolist(), e["part"].tolist()))
    assert fields(e, own[e["doc"]]) == fields(want, np.asarray(ids)[want["doc"]])

    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1000)
    made = []
    doubled = suffix_dedup._doubled
    monkeypatch.setattr(suffix_dedup, "_doubled", lambda *a: made.append(a) or doubled(*a))
    words = ["".join(rng.choice(list("abcd"), rng.integers(20, 90))) for _ in range(30)]
    rows = [(int(i), "".join(words[k] for k in rng.integers(0, 30, 6))) for i in rng.permutation(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)
    assert len(made) == 2 * suffix_dedup.TURNS
    marks, _ = suffix_dedup.repeated_spans(docs)
    assert {r.key for r in marks.select("key").distinct().collect()} == {0}


def brute_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment():
    rng = np.random.default_rng(4)
    a = [rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64) * np.uint64(4) for _ in range(60)]
    b = [rng.integers(0, 5, rng.integers(1, 20)).astype(np.uint64) * np.uint64(4) for _ in range(60)]
    assert decontaminate.smith_waterman(a, b)[0].tolist() == [brute_align(x, y) for x, y in zip(a, b)]


def test_leaks(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(30)).capitalize() + ".") for k in range(12)] + [(12, None), (13, ""), (14, "two words")]
    docs, planted = [], {}
    for i in range(60):
        x = [word() for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            k = rng.randrange(12)
            copy = items[k][1].split()
            for _ in range(3):
                copy[rng.randrange(30)] = word()
            if i % 2:
                del copy[10]
            at = rng.randint(0, len(x))
            x[at:at] = copy
            planted[i] = k
        docs.append((i, " ".join(x)))
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (8 << 20, 700):
        got = decontaminate.find_leaks(d, b, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == set(planted.items())
    for r in got:
        passage = dict(docs)[r.doc_id][r.start : r.end].lower().split()
        assert 25 <= len(passage) <= 31


def test_leaks_of_spaced_edits(spark):
    """Every pair that brute force scores at least the threshold is found, with that score, however the edits are spaced."""
    words = lambda n, name: [f"{name}{i}" for i in range(n)]
    items = [words(30, "a"), words(10, "b"), words(20, "c"), words(5, "d"), words(40, "e")]
    fifth = [f"x{i}" if i % 5 == 4 else w for i, w in enumerate(items[0])]
    two = [f"x{i}" if i in (2, 5) else w for i, w in enumerate(items[1])]
    inserted = [x for i, w in enumerate(items[2]) for x in ([w, f"x{i}"] if i % 2 else [w])]  # no three words in a row stay
    single = [x for i, w in enumerate(items[3]) for x in ([w, f"x{i}"] if i < 4 else [w])]
    early = [x for i, w in enumerate(items[4]) for x in ([w, "x"] if i < 30 else [w])]  # the hits at the end tell a late start
    rng = random.Random(12)
    copies = [fifth, two, inserted, single, early]
    for _ in range(60):
        k = rng.randrange(5)
        copy = list(items[k])
        for _ in range(rng.randint(0, len(copy) // 2)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 1)] = rng.choice(([], [f"y{rng.randrange(9)}"], [rng.choice(items[k])]))
        copies.append(copy)
    docs = [(i, ["start"] * rng.randint(0, 20) + c + ["end"] * rng.randint(0, 20)) for i, c in enumerate(copies)]
    code = {w: i for i, w in enumerate(sorted({w for x in [*items, *(c for _, c in docs)] for w in x}))}
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string")
    for threshold in (0.6, 0.9):
        scored = {(i, k): brute_align([code[w] for w in x], [code[w] for w in c]) / (2 * len(x)) for i, c in docs for k, x in enumerate(items)}
        want = {pair: s for pair, s in scored.items() if s >= threshold}
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(d, b, threshold=threshold).collect()}
        assert got == want
        assert threshold > 0.6 or {(i, i) for i in range(5)} <= set(want)


def test_leaks_awkward(spark, awkward, nothing):  # noqa: F811
    b = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x y"), (2, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(awkward, b).collect()) == [(5, 1), (5, 1)]
    assert decontaminate.find_leaks(nothing, b).count() == 0
    assert decontaminate.find_leaks(awkward, b.limit(0)).count() == 0


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(n), [float(p), float(1 - p)]) for i, (n, p) in enumerate(zip(rng.integers(1, 900, 400), rng.random(400)))]
    members = spark.createDataFrame(rows, "id long, n_tokens long, p array<double>")
    for target in ([0.5, 0.5], [0.8, 0.2], [0.2, 0.8]):
        got = {r.id: r.rate for r in mixing.fit_rates(members, target).collect()}
        n, p, r = np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), np.array([got[x[0]] for x in rows])
        assert r.min() >= 0 and np.allclose((n[:, None] * p * r[:, None]).sum(0) / n.sum(), target, atol=1e-5)


def test_rates_minimise_the_gaps(spark):
    """Targets that no rates meet: the loss is that of many plain projected steps, and it says that it isn't zero."""
    rng = np.random.default_rng(9)
    n, p = rng.integers(1, 900, 300), rng.choice([0.3, 0.6], 300)
    members = spark.createDataFrame([(i, int(a), [float(b), float(1 - b)]) for i, (a, b) in enumerate(zip(n, p))], "id long, n_tokens long, p array<double>")
    target, both = np.array([0.05, 0.95]), np.stack((p, 1 - p), 1)
    share = (n[:, None] * both).sum(0) / n.sum()
    gap = lambda r: (n[:, None] * both * r[:, None]).sum(0) / n.sum() - target
    r = np.ones(300)
    for _ in range(20_000):
        r = np.maximum(0, r - both @ (gap(r) / share))
    rows = mixing.fit_rates(members, list(target)).collect()
    got = np.zeros(300)
    got[[x.id for x in rows]] = [x.rate for x in rows]
    assert (gap(got) ** 2 / share).sum() == pytest.approx((gap(r) ** 2 / share).sum(), rel=1e-3)
    assert rows[0].residual == pytest.approx(abs(gap(got)).max(), abs=1e-9) and rows[0].residual > 0.01
    assert not mixing.fit_rates(members, [0.4, 0.6], steps=1).first().converged


def test_posteriors_sum_to_one(spark):
    model = mixing.Classifier(["a", "b", "c"], [0.1, 0.1, 0.1], {"x": [0.3, 0.0, -0.7], "y": [-4.0, 1.0, 2.0]})
    rows = spark.createDataFrame([(i, 3, marks) for i, marks in enumerate([["z"], ["x"], ["y"], ["x", "y"], ["x", "z"]])], "id long, n_tokens long, marks array<string>")
    got = {r.id: list(r.p) for r in model.members(rows).collect()}
    assert len(got) == 5
    for p in got.values():
        assert abs(sum(p) - 1) < 1e-9 and all(x == round(x, 6) and x >= 0 for x in p)
    assert got[0] == [0.333334, 0.333333, 0.333333]


def test_mixing_awkward(spark, awkward, nothing):  # noqa: F811
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mix_sources(awkward, labels).collect()
    assert len(got) == len(AWKWARD) and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in got)
    assert {r.rate for r in mixing.mix_sources(awkward, labels.limit(0)).collect()} == {1.0}
    assert mixing.mix_sources(nothing, labels).count() == 0


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, data))
        assert out.columns == docs.columns
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids and (name == "personal data") == (left == ids)
        docs, ids = out, left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in last.collect()} == ids and {"mix_rate", "mix_copies"} < set(last.columns)


#: Nulls, empty texts, repeated rows, one id with two texts, a near copy, and columns whose names the operators use.
ODD = [(None, None), (None, "some words of a row without an id"), (1, ""), (1, ""), (2, "hh " + " ".join(f"w{k}" for k in range(30))), (2, "oo " + " ".join(f"v{k}" for k in range(30))), (3, "oo " + " ".join(f"v{k}" for k in range(30)) + " x"), (4, "mail a@b.co now")]
CLASH = ("score", "predicted", "spans", "redacted", "rate", "n_tokens", "row_key", "class_id", "p", "text_hash", "mix")


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_awkward(spark, data, stage):
    own = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    odd = own.withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit(""))) for c in CLASH})
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, odd, data)
    assert out.columns[: len(odd.columns)] == odd.columns
    rows = out.collect()
    want = [x for x in ODD if not (name == "near duplicates" and x[0] == 3)]
    key = lambda x: (x[0] or 0, x[1] or "")
    if name == "personal data":
        assert sorted(((r.doc_id, r.score[5:]) for r in rows), key=key) == sorted(((i, t or "") for i, t in want), key=key)
        assert [r.text for r in rows if r.doc_id == 4] == ["mail <EMAIL> now"]
    else:
        assert sorted(((r.doc_id, r.text) for r in rows), key=key) == sorted(want, key=key)
    assert all(r[c] == c + (x or "") for r in rows for c in CLASH for x in [r.score[5:]])
    assert f(spark, odd.limit(0), data).count() == 0
