r"""Quality rules as a short-circuit cascade.

Each rule is a boolean column over per-document measures. ``plan_cascade`` runs every rule over a
random sample of all rows, takes the seconds it costs beyond those of an empty job and the share it
rejects, and orders the rules by rejection per cost. ``cascade`` turns that order into nested CASE branches: a rule's measures are
computed only for documents that all rules before it have passed. A document is kept when it passes
every rule, so the order, and with it the sample, changes the cost and never the verdict. ``judge`` returns
some measures for every document, so there only the rules that don't build on these are skipped.

Words are runs of ``[^\x20\x09-\x0D]``. All of it is Spark expressions over one row: no shuffle, no
Python. Repeated 3-word windows are found by packing 44 bits of each window's hash and its position
into a long, sorting, and comparing neighbours; where neighbours agree in the hash but not in the
words, or a text has over a million words, the windows themselves are sorted instead, so the count is
exact.

Defined cases: a null or blank text has no words, fails ``few_words`` and isn't kept. A null or
repeated doc_id, repeated rows and extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import string
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, documents, fresh, quoted, text_or_empty

#: Rows that the sample for cost and selectivity is expected to hold.
SAMPLE_ROWS = 2000
RUNS, LEAST_SECONDS = 3, 1e-4


def one_spaced(text: str) -> str:
    """SQL: the words of ``text`` with one space between them."""
    for space in ("\\n", "\\t", "\\r", "\\u000B", "\\u000C"):
        text = f"replace({text}, '{space}', ' ')"
    return f"trim({text})"


_BITS = 20  # of a packed window's position
_PLACES = (1 << _BITS) - 1


def repeated_words(windows: str) -> str:
    """SQL: how many word positions lie in windows that occur at least twice."""
    packed = f"sort_array(transform({windows}, (x, i) -> (xxhash64(x) & {~_PLACES}L) | bigint(i)))"
    like_last = f"shiftright(k, {_BITS}) = shiftright(get(s, i - 1), {_BITS})"
    like_next = f"shiftright(k, {_BITS}) = shiftright(get(s, i + 1), {_BITS})"
    window_at = lambda k: f"get({windows}, int({k} & {_PLACES}L))"
    differ = f"exists(transform(s, (k, i) -> {like_last} AND {window_at('k')} != {window_at('get(s, i - 1)')}), x -> x)"
    by_hash = f"transform(filter(s, (k, i) -> {like_last} OR {like_next}), k -> k & {_PLACES}L)"
    sorted_windows = f"sort_array(transform({windows}, (x, i) -> named_struct('w', x, 'p', bigint(i))))"
    by_words = "transform(filter(t, (e, i) -> e.w = get(t, i - 1).w OR e.w = get(t, i + 1).w), e -> e.p)"
    exact = f"get(transform(array({sorted_windows}), t -> {by_words}), 0)"
    quick = f"get(transform(array({packed}), s -> CASE WHEN {differ} THEN {exact} ELSE {by_hash} END), 0)"
    places = f"sort_array(CASE WHEN size({windows}) > {_PLACES} THEN {exact} ELSE {quick} END)"
    # A window covers three positions, fewer where the next repeated one starts sooner.
    covers = "transform(q, (p, i) -> least(3L, coalesce(get(q, i + 1) - p, 3L)))"
    covered = f"get(transform(array({places}), q -> aggregate({covers}, 0L, (a, b) -> a + b)), 0)"
    return f"CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE {covered} END"


#: SQL of each measure; {braces} name the measures it builds on, {text} the text, never null.
MEASURES = {
    "spaced": one_spaced("{text}"),
    "norm": "CASE WHEN contains({spaced}, '  ') THEN regexp_replace({spaced}, ' +', ' ') ELSE {spaced} END",
    "word_chars": "bigint(length(replace({norm}, ' ', '')))",
    "n_words": "CASE WHEN {norm} = '' THEN 0L ELSE length({norm}) - {word_chars} + 1 END",
    "n_symbols": "bigint(regexp_count({text}, '[#*$%&|<>]'))",
    "lines": r"filter(split({text}, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')",
    "n_lines": "bigint(size({lines}))",
    "n_dup_lines": "{n_lines} - size(array_distinct({lines}))",
    # 3-word windows in order; none for fewer than three words.
    "windows": "regexp_extract_all({norm}, '(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++', 1)",
    "n_repeat_words": repeated_words("{windows}"),
    "n_capitals": r"bigint(regexp_count({text}, '\\p{{Lu}}'))",
    "n_shouts": "bigint(regexp_count({text}, '!!'))",
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the measures that its {braces} name."""

    name: str
    rejects: str


#: A document is kept when none of them rejects it.
RULES = (
    Rule("few_words", "{n_words} < 50"),
    Rule("repeated_words", "100 * {n_repeat_words} > 50 * {n_words}"),
    Rule("symbols", "10 * {n_symbols} > 4 * {n_words}"),
    Rule("repeated_lines", "{n_lines} >= 5 AND 2 * {n_dup_lines} > {n_lines}"),
    Rule("word_length", "{n_words} >= 1 AND ({word_chars} < 2 * {n_words} OR {word_chars} > 20 * {n_words})"),
    Rule("capitals", "2 * {n_capitals} > {word_chars}"),
    Rule("shouting", "10 * {n_shouts} > 4 * {n_words}"),
)
BASE = ("few_words", "repeated_words")


def _needed(sql: list[str]) -> list[str]:
    """The measures that these expressions build on, in an order in which they can be computed."""
    fields = lambda s: {f for _, f, _, _ in string.Formatter().parse(s) if f} - {"text"}
    need = set().union(*map(fields, sql))
    for name in reversed(MEASURES):
        if name in need:
            need |= fields(MEASURES[name])
    return [name for name in MEASURES if name in need]


class Judged:
    """A table with working columns for its text's measures, added as they are asked for."""

    def __init__(self, df: DataFrame, text: str):
        self.columns = df.columns
        self.names = dict(zip(["text", *MEASURES, "verdict"], fresh(df, "text", *MEASURES, "verdict"), strict=True))
        self.df = df.withColumn(self.names["text"], text_or_empty(text))
        self.done: set[str] = set()

    def sql(self, template: str) -> str:
        return template.format(**{k: f"`{v}`" for k, v in self.names.items()})

    def measure(self, names: list[str], when: str | None = None) -> None:
        for name in names:
            if name not in self.done:
                sql = MEASURES[name] if when is None else f"CASE WHEN {when} THEN {MEASURES[name]} END"
                self.df = self.df.withColumn(self.names[name], F.expr(self.sql(sql)))
                self.done.add(name)

    def cascade(self, rules: list[Rule]) -> Column:
        """The first rule that rejects the row, null if none does. What only later rules need is not computed."""
        verdict = self.names["verdict"]
        self.df = self.df.withColumn(verdict, F.lit(None).cast("string"))
        for rule in rules:
            self.measure(_needed([rule.rejects]), when="{verdict} IS NULL")
            self.df = self.df.withColumn(
                verdict, F.expr(self.sql(f"CASE WHEN {{verdict}} IS NOT NULL THEN {{verdict}} WHEN {rule.rejects} THEN '{rule.name}' END"))
            )
        return F.col(verdict)


def plan_cascade(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """``(rule, share rejected, seconds)``, by rejection per second, best first.

    The sample is drawn from all rows and is expected to hold ``sample_rows`` of them. Each rule runs
    alone over the stored sample, ``RUNS`` times, and so does a rule that never rejects; the least time counts,
    less that of the empty rule, which is what running a job costs, but at least ``LEAST_SECONDS``.
    """
    share = min(1.0, sample_rows / max(1, df.count()))
    sample = cut(df.select(text_or_empty(text).alias("text")).sample(fraction=share, seed=seed))

    def run(rejects: str) -> tuple[float, float]:
        judged = Judged(sample, "text")
        judged.measure(_needed([rejects]))
        counts = judged.df.agg(F.count("*").alias("n"), F.count_if(F.expr(judged.sql(rejects))).alias("bad"))
        took = []
        for _ in range(RUNS):
            began = time.monotonic()
            row = counts.collect()[0]
            took.append(time.monotonic() - began)
        return row["bad"] / max(1, row["n"]), min(took)

    _, empty = run("length({text}) < 0")
    out = []
    for rule in rules:
        rejected, took = run(rule.rejects)
        out.append((rule, rejected, max(LEAST_SECONDS, took - empty)))
    return sorted(out, key=lambda x: (-x[1] / x[2], x[0].name))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with its columns."""
    order = [rule for rule, _, _ in plan_cascade(df, text, rules)]
    judged = Judged(df, text)
    rejected_by = judged.cascade(order)
    # The row number keeps the filter above the measures: pushed below, it would repeat them once for each mention.
    barrier = fresh(judged.df, "barrier")[0]
    judged_rows = judged.df.withColumn(barrier, F.monotonically_increasing_id())
    return judged_rows.where(rejected_by.isNull() & (F.col(barrier) >= 0)).select(*[quoted(c) for c in df.columns])


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``df`` with the base measures, ``base_failed`` and ``kept``.

    The base measures are asked for here, so they are computed for every row; those of the other
    rules only as the cascade needs them.
    """
    order = [rule for rule, _, _ in plan_cascade(df, text, rules)]
    base = [rule.rejects for rule in RULES if rule.name in BASE]
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = Judged(df, text)
    judged.measure(_needed([*base, *(f"{{{name}}}" for name in shown)]))
    failed = F.expr(judged.sql(" OR ".join(f"({sql})" for sql in base)))
    rejected_by = judged.cascade(order)
    plain = [c for c in df.columns if c not in {*shown, "base_failed", "kept"}]
    return judged.df.select(
        *[quoted(c) for c in plain], *[F.col(judged.names[name]).alias(name) for name in shown],
        failed.alias("base_failed"), (rejected_by.isNull() & ~failed).alias("kept"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, range(1, len(words) - 1) AS r(i)),
often AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(regexp_extract_all(t, '\p{Lu}')) AS capitals, len(regexp_extract_all(t, '!!')) AS shouts
  FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 4 * n_words OR (n_lines >= 5 AND 2 * n_dup_lines > n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * capitals > word_chars OR 10 * shouts > 4 * n_words) AS kept
FROM b
"""
