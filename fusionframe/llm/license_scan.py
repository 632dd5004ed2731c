"""License scan: ordered signature rules over words, gated by keywords, in DataFrame functions only.

A text becomes its words, each between two spaces of its own, so that a rule is one regular expression
over words, whole words only, and places are counted in words. A rule is tried only where its
gate, the beginning of a word that each of its matches holds, is in the text. The detections of a text are
then resolved in one pass in order of their starts: one that lies within another of a higher priority, or of
the same priority (of equal intervals the earlier rule stays), is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_rules import BASE, SIGNATURES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONFIDENCE = {1: 0.4, 2: 0.7, 3: 1.0}  # by priority


@dataclass(frozen=True)
class Rule:
    label: str
    gate: str
    priority: int
    words: str
    base: bool = False

    @property
    def pattern(self) -> str:
        """The expression over a text in which each word stands between two spaces."""
        out = ""
        for word in self.words.split(" "):
            if m := re.fullmatch(r"\*(\d+)", word):
                out += f"(?: [^ ]+ ){{0,{m[1]}}}"
            elif word.startswith("~"):
                out += f"(?: {word[1:]} )?"
            else:
                out += f" {word} "
        return out


def rules_of(lines: str, base: bool = False) -> list[Rule]:
    return [Rule(label, gate, int(priority), words, base) for label, gate, priority, words in (x.split(" ", 3) for x in lines.strip().splitlines())]


RULES = rules_of(BASE, True) + rules_of(SIGNATURES)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _column(values: list) -> Column:
    """An array of strings out of one literal, which is split once while the query is planned."""
    return F.split(F.lit("\n".join(map(str, values))), "\n")


def _count_words(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def spaced_words(text: Column) -> Column:
    """The words (ASCII letters and digits and all characters beyond ASCII), each between two spaces."""
    parted = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "  "))
    return _let(parted, lambda x: F.when(x == "", "").otherwise(F.concat(F.lit(" "), x, F.lit(" "))))


def _hits(spaced: Column, rules: list[Rule]) -> Column:
    """array<struct(rule, hits: array<struct(k, gap, size)>)>: for each rule, the words between its matches and in them."""
    gates = _column(sorted({r.gate for r in rules}))
    gate_of, pattern_of = _column([r.gate for r in rules]), _column([r.pattern for r in rules])

    def found(text: Column, pattern: Column) -> Column:
        sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), _count_words)
        gaps = F.transform(F.split(text, pattern, -1), _count_words)
        return _let(gaps, lambda g: F.transform(sizes, lambda size, k: F.struct(k.alias("k"), F.get(g, k).alias("gap"), size.alias("size"))))

    def tried(gates_met: Column) -> Column:
        chosen = F.filter(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda r: F.array_contains(gates_met, F.get(gate_of, r)))
        return _let(F.translate(spaced, UPPER, LOWER), lambda text: F.transform(chosen, lambda r: F.struct(r.alias("rule"), found(text, F.get(pattern_of, r)).alias("hits"))))

    opened = _let(F.lower(spaced), lambda low: F.filter(gates, lambda g: F.contains(low, F.concat(F.lit(" "), g))))
    return _let(opened, lambda g: F.when(F.size(g) > 0, tried(g)))


def license_scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, detections: array<struct(start, end, label, rule, priority, base, kept)>, one row per input row.

    Starts and ends count words from 0, ends exclusive; detections go by start, then the longer, then the
    higher priority, then the earlier rule. `kept` is false for suppressed ones.
    Null and empty texts have no words and no detections; very long texts are taken whole; repeated rows are scanned
    again; a null id stays null; no rows give no rows; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    own = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), spaced_words(F.col(text_col)).alias("spaced"))
    own = own.select("id", "row", _count_words(F.col("spaced")).alias("n_words"), F.filter(_hits(F.col("spaced"), rules), lambda r: F.size(r["hits"]) > 0).alias("found"))
    # Only numbers go on from here: a row for each detection, and one for each text without any.
    rows = own.select("id", "row", "n_words", F.explode_outer("found").alias("f")).select("id", "row", "n_words", F.col("f.rule").alias("rule"), F.explode_outer("f.hits").alias("h"))
    rows = rows.select("id", "row", "n_words", "rule", "h.k", "h.gap", "h.size").repartition("row")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    facts = [F.get(_column([getattr(r, name) for r in rules]), "rule").cast(kind).alias(name) for name, kind in (("label", "string"), ("priority", "int"), ("base", "boolean"))]
    rows = rows.withColumn("end", upto).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.select("id", "row", "n_words", "rule", "start", "end", *facts)
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in rules})
    for p in levels:
        rows = rows.withColumn(f"reach{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before))
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"reach{p}")) for p in levels])
    kept = F.coalesce(reach < F.col("end"), F.lit(True))
    hit = F.when(F.col("rule").isNotNull(), F.struct("start", (-F.col("end")).alias("back"), (-F.col("priority")).alias("low"), "rule", "label", "base", kept.alias("kept")))
    out = rows.withColumn("hit", hit).groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.sort_array(F.collect_list("hit")).alias("d"))
    full = F.transform("d", lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["label"].alias("label"), x["rule"].alias("rule"), (-x["low"]).alias("priority"), x["base"].alias("base"), x["kept"].alias("kept")))
    return out.select(F.col("id").alias(id_col), "n_words", full.alias("detections"))


def _labels(hits: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda x: x["base"])
    own = F.filter("detections", lambda x: x["base"] | x["kept"])
    score = F.array_max(F.transform(own, lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in CONFIDENCE.items() for y in kv]), x["priority"])))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"), F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(own).alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"),
    )


def _sql(rules: list[Rule]) -> str:
    """The scan in SQL, each rule over all texts, without gates."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    tries = "\n  UNION ALL ".join(
        f"SELECT row, {k} AS rule, {quoted(r.label)} AS label, {r.priority} AS priority, {r.base} AS base, string_split_regex(x, {quoted(r.pattern)}) AS gaps, regexp_extract_all(x, {quoted(r.pattern)}) AS found FROM t WHERE regexp_matches(x, {quoted(r.pattern)})" for k, r in enumerate(rules)
    )
    case = " ".join(f"WHEN {p} THEN {c}::DOUBLE" for p, c in CONFIDENCE.items())
    return rf"""
WITH p AS (
  SELECT doc_id, row_number() OVER () AS row, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') AS y FROM documents),
t AS MATERIALIZED (SELECT doc_id, row, CASE WHEN y = '' THEN '' ELSE ' ' || y || ' ' END AS x FROM p),
h AS MATERIALIZED ({tries}),
u AS (SELECT row, rule, label, priority, base, unnest(range(1, len(found) + 1)) AS k, gaps, found FROM h),
s AS (
  SELECT row, rule, label, priority, base, k,
    (length(gaps[k]) - length(replace(gaps[k], ' ', ''))) // 2 AS gap, (length(found[k]) - length(replace(found[k], ' ', ''))) // 2 AS size FROM u),
d AS (SELECT *, sum(gap + size) OVER (PARTITION BY row, rule ORDER BY k)::BIGINT AS e FROM s),
z AS (SELECT *, e - size AS b FROM d),
k AS (
  SELECT z.*, NOT EXISTS (
    SELECT 1 FROM z o WHERE o.row = z.row AND o.b <= z.b AND o.e >= z.e AND (o.priority > z.priority OR o.priority = z.priority AND (o.e - o.b > z.e - z.b OR o.rule < z.rule))) AS kept FROM z),
g AS (
  SELECT row, count(*) FILTER (WHERE base) AS n_base, min(b) FILTER (WHERE base) AS first_word, max(b) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base OR kept) AS labels,
    max(CASE priority {case} END) FILTER (WHERE base OR kept) AS score FROM k GROUP BY row)
SELECT doc_id, ((length(x) - length(replace(x, ' ', ''))) // 2)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM t LEFT JOIN g ON g.row = t.row
"""


OP11_SQL = _sql(RULES)
