"""The license scan against a plain scan of all rules without gates."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fusionframe.llm import license_scan
from fusionframe.llm.license_scan import RULES

from .test_text_operators import AWKWARD, awkward, nothing  # noqa: F401


def brute(text, rules=RULES):
    """(n_words, detections) with the matches looked for word by word."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for k, r in enumerate(rules):
        pattern, at = re.compile("".join(" " + w + " " if w[0] not in "~*" else f"(?: {w[1:]} )?" if w[0] == "~" else f"(?: [^ ]+ ){{0,{w[1:]}}}" for w in r.words.split(" "))), 0
        while at < len(words):
            m = pattern.match("".join(f" {w} " for w in words[at : at + 60]))
            if m:
                size = m[0].count(" ") // 2
                found.append((at, at + size, r.label, k, r.priority, r.base))
                at += size
            else:
                at += 1
    keeps = lambda a: not any(b[0] <= a[0] and b[1] >= a[1] and (b[4] > a[4] or b[4] == a[4] and (b[1] - b[0] > a[1] - a[0] or b[3] < a[3])) for b in found)
    return len(words), sorted(((*a, keeps(a)) for a in found), key=lambda a: (a[0], -a[1], -a[4], a[3]))


def sample(rng, words):
    """A text that the pattern fits: one choice for each alternative."""
    out = []
    for w in words.split(" "):
        if w.startswith("*"):
            out += ["filler"] * rng.randint(0, int(w[1:]))
            continue
        if w.startswith("~"):
            if rng.random() < 0.5:
                continue
            w = w[1:]
        w = re.sub(r"\[a-z0-9\]\+|\[a-z\]\*", "ab", w)
        w = re.sub(r"\[0-9\]", "7", w)
        w = re.sub(r"\[(\w+)\]", lambda m: rng.choice(m[1]), w)
        w = re.sub(r"\(([^)]*)\)", lambda m: rng.choice(m[1].split("|")), w)
        w = re.sub(r"(\w)\?", lambda m: rng.choice(["", m[1]]), w)
        out.append(w)
    return out


def test_rules():
    rng = random.Random(1)
    assert len(RULES) > 200
    for r in RULES:
        for _ in range(20):
            words = sample(rng, r.words)
            assert re.fullmatch(r.pattern, "".join(f" {w} " for w in words)), r
            assert any(w.startswith(r.gate) for w in words), r  # the gate holds in whatever fits


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += sample(rng, rng.choice(RULES).words) + ["word"] * rng.randint(0, 3)
            if rng.random() < 0.3:
                words = words[:-1]
        x = "".join(rng.choice([w, w.upper(), w.capitalize()]) + rng.choice([" ", " ", "-", ".\n", "  ", "/"]) for w in words)
        rows.append((i, rng.choice(["", "É ", "...", "x "]) + x))
    return [*rows, (900, "under the MIT license under the mit license CC BY-NC cc by nc"), (901, "licensİ Kelvin under the mıt license"), (902, "MIT")]


def test_license_scan(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("rule", F.lit("x")).repartition(3)
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    for i, x in texts:
        n, want = brute(x)
        assert got[i].n_words == n and [tuple(d) for d in got[i].detections] == want, x
    assert any(not d[-1] for i, x in texts for d in brute(x)[1])


def test_license_scan_is_linear(spark):
    """A long text of nothing but notices."""
    def took(n):
        df = spark.createDataFrame([(1, "Released under the MIT License. CC BY-NC 4.0, all rights reserved. " * n)], "doc_id long, text string")
        began = time.time()
        d = license_scan.license_scan(df).select(F.size("detections").alias("n"), F.element_at("detections", -1).alias("last")).first()
        assert d.n >= 4 * n and d.last.end == 13 * n
        return time.time() - began

    took(100)
    assert took(16_000) < 25


def test_license_scan_awkward(spark, awkward, nothing):  # noqa: F811
    got = license_scan.license_scan(awkward).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.detections)) for r in got) == sorted((i or 0, brute(x)[0], 0) for i, x in AWKWARD)
    assert license_scan.license_scan(nothing).count() == 0
