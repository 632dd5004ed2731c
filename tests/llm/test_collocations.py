"""Collocations against plain counting of all phrases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fusionframe.llm import collocations

from .test_text_operators import AWKWARD, awkward, nothing  # noqa: F401


def brute(rows, max_n, least, percent, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, max_n + 1) for i in range(len(w) - m + 1))
    cands = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = collections.defaultdict(list)
    for (lang, *w), a in cands.items():
        inside = any(x[0] == lang and len(x) > len(w) + 1 and 100 * b >= percent * a and any(list(x[i : i + len(w)]) == w for i in range(1, len(x))) for x, b in cands.items())
        if not inside:
            s, k = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-s, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def texts(seed, docs=60, langs=("en", None, "d\\n\ne", "")):
    rng = random.Random(seed)
    vocab = ["the", "The", "a", "of", "é", "ÀB", "x\x01y", "\x00", "b\\n", "c|d", "|", "word", " ", "\x1c"]
    rows = []
    for _ in range(docs):
        x = ""
        for _ in range(rng.choice([0, 3, 60, 400])):
            x += rng.choice(vocab[: rng.choice([3, 14])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!?", ", ", " .", "\r\n"])
        rows.append((rng.choice(langs), x))
    return [*rows, ("en", None), ("en", ""), rows[0], rows[0]]


@pytest.mark.parametrize("seed,max_n,least,hot,batch,top", [(1, 3, 10, 1024, 10_000, 2000), (2, 3, 4, 64, 7, 11), (3, 4, 3, 8, 3, 2000), (4, 2, 10, 1, 1, 5)])
def test_collocations(spark, monkeypatch, seed, max_n, least, hot, batch, top):
    monkeypatch.setattr(collocations, "HOT", hot)
    rows = texts(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = collocations.collocations(df, max_n, least, top=top).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = brute(rows, max_n, least, 50, top)
    assert sorted(map(tuple, got)) == want and want


def test_stack_across_batches():
    """The same rows cut into batches anywhere give the same counts."""
    rng = random.Random(3)
    rows = sorted({"".join(w + "\n" for w in (rng.choice("abc"), "en", *(rng.choice(["a", "b", "ab"]) for _ in range(rng.randint(1, 3))))) for _ in range(90)}, reverse=True)
    counts = [rng.randint(1, 5) for _ in rows]
    want = collections.Counter()
    for r, c in zip(rows, counts):
        w = r.split("\n")[:-1]
        want.update({"\n".join(w[: d + 1]): c for d in range(2, len(w))})
    for step in (1, 2, 5, 1000):
        stack, got = collocations.Stack(4, 6), []
        for a in range(0, len(rows), step):
            got += stack.add(pa.array(rows[a : a + step]), np.array(counts[a : a + step]), np.zeros(len(rows[a : a + step]), bool)).to_pylist()
        got += stack.end().to_pylist()
        assert len(got) == len({r["phrase"] for r in got}) and {r["phrase"]: r["a"] for r in got} == {p: c for p, c in want.items() if c >= 6}


def test_scores_are_exact(spark):
    big = [(a, left, right, 10**6 * a * a // (left * right)) for a, left, right in [(10**14 + 1, 10**14 + 7, 10**14 + 9), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (3, 10, 9), (10**9, 10**9 + 1, 10**9)]]
    df = spark.createDataFrame(big, "a long, l long, r long, want long")
    assert all(r.got == r.want for r in df.withColumn("got", collocations._score("a", "l", "r")).collect())


def test_collocations_awkward(spark, awkward, nothing):  # noqa: F811
    from pyspark.sql import functions as F

    got = collocations.collocations(awkward.withColumn("lang", F.lit(None).cast("string")), min_count=2).collect()
    assert [(r.lang, r.phrase, r.a, r.l, r.r, r.score) for r in got] == [("und", "a b c", 2, 2, 2, 1_000_000)]
    assert len(AWKWARD) and collocations.collocations(nothing.withColumn("lang", F.lit("x"))).count() == 0
