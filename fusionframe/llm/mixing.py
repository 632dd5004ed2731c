"""Mixing sources to target weights with soft memberships, in DataFrame functions only.

Domains are the label combinations of a labelled table. A naive Bayes classifier over the
presence of the most telling words gives every document posterior domain probabilities. Document
rates r >= 0 then minimise the squared distance between expected domain token totals and their
targets, each domain's gap weighted by one over its share, by projected gradient steps from r = 1. Steps are measured by tokens, so documents of equal
posterior get equal rates and a step of 1 can't overshoot; every step is taken from a point that keeps some of the last
movement, unless this went uphill.

A gradient is a weighted sum of posteriors, so a step is known by one number a domain, which is all the driver keeps. Posteriors
have six decimals, and the steps are taken on the table of distinct posteriors and their tokens, much smaller than the documents.
Its rates are stored every `KEPT` steps; in between each posterior folds the list of steps, projecting after each. In the
end every document folds all steps over its own posterior, so no join on a frequent posterior is needed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, table

#: Production targets: shares of the tokens by quality and toxicity label.
TARGETS = {"q0t0": 0.06, "q0t1": 0.005, "q1t0": 0.92, "q1t1": 0.015}


def _words(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > 0, F.split(F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r]", " ")), " +")).otherwise(F.array().cast("array<string>"))


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens, marks: the distinct words, and marks of the share of distinct words and of the length."""
    d = docs.select(F.col(id_col).alias("id"), _words(F.coalesce(text_col, F.lit(""))).alias("w"))
    d = d.select("id", F.size("w").cast("long").alias("n_tokens"), F.array_distinct("w").alias("u"))
    share = F.floor(10 * F.size("u") / F.greatest("n_tokens", F.lit(1))).cast("string")
    return d.select("id", "n_tokens", F.concat("u", F.array(F.concat(F.lit("\x01share "), share), F.concat(F.lit("\x01length "), F.floor(F.log2(F.col("n_tokens") + 1)).cast("string")))).alias("marks"))


def _labelled(labels: DataFrame, id_col: str, sample_rows: int) -> DataFrame:
    """k, domain: at most sample_rows ids, the smallest hashes first; null labels count as 0, null ids are left out, of repeated ids the largest labels."""
    flag = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) != 0).cast("int"))
    one = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(flag("quality").alias("q"), flag("toxic").alias("t"))
    return one.orderBy(F.xxhash64("k"), "k").limit(sample_rows).select("k", F.concat(F.lit("q"), F.col("q").cast("string"), F.lit("t"), F.col("t").cast("string")).alias("domain"))


class Classifier:
    """domains; by domain, the log odds of a text without any telling word, and what each such word adds."""

    def __init__(self, domains: list[str], priors: list[float], weights: dict[str, list[float]]):
        self.domains, self.priors, self.weights = domains, priors, weights

    def members(self, features: DataFrame) -> DataFrame:
        """id, n_tokens, p array<double> in the order of the domains, for rows of (id, n_tokens, marks).

        Posteriors are rounded to six decimals; the likeliest domain (the first of several) takes what is left to 1. The word table has at most `vocabulary` rows, so it is broadcast; the sums of a document
        are complete before the shuffle, which moves one row per document.
        """
        k = len(self.domains)
        if k == 1:
            return features.select("id", "n_tokens", F.array(F.lit(1.0)).alias("p"))
        known = features.sparkSession.createDataFrame([(w, *x) for w, x in self.weights.items()], "w string, " + ", ".join(f"l{i} double" for i in range(k)))
        numbered = features.withColumn("row", F.monotonically_increasing_id())
        marks = numbered.select("row", "id", "n_tokens", F.explode("marks").alias("w")).join(F.broadcast(known), "w", "left")
        sums = marks.groupBy("row", "id", "n_tokens").agg(*[F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"l{i}") for i in range(k)])
        score = [F.col(f"l{i}") + F.lit(float(self.priors[i])) for i in range(k)]
        top = F.greatest(*score)
        raw = [F.exp(x - top) for x in score]
        total = reduce(lambda x, y: x + y, raw)
        q = [F.col(f"q{i}") for i in range(k)]
        rounded = sums.select("id", "n_tokens", *[F.round(raw[i] / total, 6).alias(f"q{i}") for i in range(k)])
        most, rest = F.array_position(F.array(*q), F.greatest(*q)), 1 - reduce(lambda x, y: x + y, q)
        return rounded.select("id", "n_tokens", F.array(*[F.round(q[i] + F.when(most == i + 1, rest).otherwise(0.0), 6) for i in range(k)]).alias("p"))


def fit_domains(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, vocabulary: int = 1024, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", doc_label_id: str | None = None) -> Classifier:
    """Naive Bayes on a bounded labelled sample; the `vocabulary` words with the largest chi-square over the domains. Ids of labels are those of doc_label_id in docs (label_id if None)."""
    sample = stored(_labelled(labels, label_id, sample_rows))
    # Written first: else the words of all documents are split before the join drops them.
    mine = stored(docs.select(F.col(doc_label_id or label_id).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(sample), "k").select("k", "domain", "text"))
    sizes = {r.domain: r.n for r in mine.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes)
    if not domains:
        return Classifier(["all"], [0.0], {})
    total = sum(sizes.values())
    priors = [math.log(sizes[d] / total) for d in domains]
    if len(domains) == 1:
        return Classifier(domains, priors, {})
    seen = _features(mine.withColumn("id", F.struct("k", "domain")), "id", "text").select(F.col("id.domain").alias("domain"), F.explode("marks").alias("w"))
    per = seen.groupBy("w").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(d) for d in domains], F.count("*").alias("n")).where("n >= 3")
    chi = reduce(lambda a, b: a + b, [(F.col(d) - F.col("n") * (sizes[d] / total)) ** 2 / (F.col("n") * (sizes[d] / total)) for d in domains])
    best = per.orderBy(F.round(chi, 6).desc(), "w").limit(vocabulary).collect()
    chance = lambda r, d: (r[d] + 2 * r.n / total) / (sizes[d] + 2.0)  # noqa: E731  drawn to the share over all domains
    weights = {r.w: [math.log(chance(r, d) / (1 - chance(r, d) + 1e-9)) for d in domains] for r in best}
    absent = [sum(math.log(1 - chance(r, d) + 1e-9) for r in best) for d in domains]
    return Classifier(domains, [p + a for p, a in zip(priors, absent, strict=True)], weights)


KEPT = 6


def _folded(p: list[Column], steps: list[tuple[float, list[float]]], now: Column | None = None, last: Column | None = None) -> tuple[Column, Column]:
    """(rate after the last step, rate before it) of a posterior p that has the rates now and last, the columns r and l by default; a step is (share of the last movement that is kept, what each domain takes away)."""
    now, last = F.col("r") if now is None else now, F.col("l") if last is None else last
    if not steps:
        return now, last
    listed = F.array(*[F.struct(F.lit(float(keep)).alias("keep"), *[F.lit(float(x)).alias(f"g{i}") for i, x in enumerate(gap)]) for keep, gap in steps])
    start = F.struct(last.alias("last"), now.alias("now"))

    def step(acc: Column, s: Column) -> Column:
        taken = reduce(lambda a, b: a + b, [p[i] * s[f"g{i}"] for i in range(len(p))])
        return F.struct(acc["now"].alias("last"), F.greatest(F.lit(0.0), acc["now"] + s["keep"] * (acc["now"] - acc["last"]) - taken).alias("now"))

    end = F.aggregate(listed, start, step)
    return end["now"], end["last"]


def fit_rates(members: DataFrame, targets: list[float], steps: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """members (id, n_tokens, p array) with rate, residual and converged; targets are shares of all tokens, one a domain.

    residual is the largest distance of a domain's expected share from its target. Steps end when it is
    under `tolerance`, or when a step changes no domain's share by a tenth of that (targets that no rates meet); converged
    is false where `steps` ran out before.
    """
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    out = lambda rate, residual, done: members.select("*", rate.alias("rate"), F.lit(residual).alias("residual"), F.lit(done).alias("converged"))
    state = stored(members.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("m")).where("m > 0").select("p", "m", F.lit(1.0).alias("r"), F.lit(1.0).alias("l")))
    first = state.agg(F.sum("m").alias("n"), *[F.sum(F.col("m") * p[i]).alias(f"d{i}") for i in range(k)]).first()
    if not first.n:
        dropped(state)
        return out(F.lit(1.0), 0.0, True)
    share = [first[f"d{i}"] / first.n for i in range(k)]
    taken: list[tuple[float, list[float]]] = []
    at, ahead, pace, done, kept = share, share, 1.0, False, 0
    # ahead: the shares of the point that the next step starts from; the loss is half the sum of gap squared over share
    loss = lambda x: sum((a - t) ** 2 / s for a, t, s in zip(x, targets, share, strict=True) if s > 0)
    gap = lambda x: max(abs(a - t) for a, t in zip(x, targets, strict=True))
    last_loss, keep = loss(at), 0.0
    best = (last_loss, gap(at), 0)  # loss, residual and number of steps
    for _ in range(steps):
        if gap(at) < tolerance:
            done = True
            break
        taken.append((keep, [(a - t) / s if s > 0 else 0.0 for a, t, s in zip(ahead, targets, share, strict=True)]))
        now, last = _folded(p, taken[kept:])
        pace, before = (1 + math.sqrt(1 + 4 * pace * pace)) / 2, pace
        coming = (before - 1) / pace
        if len(taken) - kept == KEPT:
            older, state = state, stored(state.select("p", "m", now.alias("r"), last.alias("l")))
            dropped(older)
            kept, now, last = len(taken), F.col("r"), F.col("l")
        both = state.select("p", "m", now.alias("r"), last.alias("l"))
        sums = both.agg(*[F.sum(F.col("m") * p[i] * F.col("r")).alias(f"a{i}") for i in range(k)], *[F.sum(F.col("m") * p[i] * F.col("l")).alias(f"l{i}") for i in range(k)]).first()
        new, old = [sums[f"a{i}"] / first.n for i in range(k)], [sums[f"l{i}"] / first.n for i in range(k)]
        moved = max(abs(a - b) for a, b in zip(new, old, strict=True))
        if loss(new) > last_loss:  # uphill: the next step keeps nothing
            pace, coming = 1.0, 0.0
        at, last_loss, keep = new, loss(new), coming
        ahead = [a + keep * (a - b) for a, b in zip(new, old, strict=True)]
        best = min(best, (last_loss, gap(at), len(taken)))
        if moved < tolerance / 10:
            done = True
            break
    dropped(state)
    return out(_folded(p, taken[: best[2]], F.lit(1.0), F.lit(1.0))[0], best[1], done or best[1] < tolerance)


def mix_sources(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, vocabulary: int = 1024, label_id: str = "doc_id", doc_label_id: str | None = None, tolerance: float = 1e-4) -> DataFrame:
    """id, n_tokens long, posterior array<double> (domains in name order), rate, residual double, converged boolean: one row per document.

    residual and converged are those of `fit_rates`, the same in every row; by default a ten-thousandth of all tokens is near enough. Rates times tokens times posteriors sum to the targets (shares of all tokens, made to sum to
    1 over the domains that the labelled rows have; equal shares if none is named). Tokens are words
    between white space. A null or empty text has no tokens and gets the rate of its posterior;
    without labelled rows there is one domain and every rate is 1. Repeated rows are documents of
    their own; a null id stays null; very long texts are taken whole; other columns are ignored.
    """
    model = fit_domains(docs, labels, sample_rows, vocabulary, id_col, text_col, label_id, doc_label_id)
    wanted = [(targets or TARGETS).get(d, 0.0) for d in model.domains]
    wanted = [x / sum(wanted) for x in wanted] if sum(wanted) > 0 else [1 / len(wanted)] * len(wanted)
    members = stored(model.members(_features(docs, id_col, text_col)))
    return fit_rates(members, wanted, tolerance=tolerance).select(F.col("id").alias(id_col), "n_tokens", F.col("p").alias("posterior"), "rate", "residual", "converged")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", F.transform("posterior", lambda x: F.round(x, 6)).alias("posterior"), F.round("rate", 6).alias("rate"), F.round("residual", 6).alias("residual"), "converged")
