r"""Secret scans: three fixed patterns, and a randomness test battery for what they don't name.

Base kinds, leftmost and without overlap within a kind: ``assign`` (a credential word, a separator, a
value of 6 or more characters), ``access`` (``AKIA`` and capitals or digits, 20 or more) and ``hex``
(24 or more of ``0-9a-f``). The span of ``assign`` is the whole match.

The method adds spans of kind ``random``. Candidates are runs of 20 or more base64 or base64url
characters. Each is read in its inferred encoding (hex, letters of one case, base32, base36, alphanumeric,
base64) and tested
  - for uniform use of the alphabet, by chi-squared,
  - for runs below and above the alphabet's middle, by Wald and Wolfowitz,
  - for serial correlation of neighbouring symbols.
The least of the three p-values, corrected for their number by Sidak's rule, is the candidate's p-value under
the hypothesis of a random token. Over the whole corpus the candidates of each length band are held to a
false-discovery rate of ``RANDOM_FDR`` by Benjamini and Hochberg's rule: those found not to be random are out.
So the level adapts to how much ordinary text a band holds, and few random tokens are called ordinary.

Short candidates of ordinary text can pass such tests for want of symbols. So those that remain are also held
against the hypothesis of ordinary text, in which neighbours seldom change between lower case, upper case and
digits: at most with probability ``CHANGES``. This p-value is Chernoff's bound on that many changes, which is
never too small. Candidates with letters of one case only, in which such changes are few even at random, have
another: the likelihood of ordinary text, whose letters follow one another as in ``PAIRS``, over that of
uniform use of the encoding's alphabet and over the number of ``ALPHABETS``; by Markov's inequality this is
never too small either. Candidates that the battery has put out have p = 1 here and still count, since leaving
them out would make the others' p-values too small. Again by length band, ordinary text among what is reported
is held to a rate of ``FDR``: short candidates, of which ordinary text has many, need stronger evidence than
long ones. Both rules run on grids of the p-values, so only counts by band and grid steps reach the driver: at
most ``len(BANDS) * (RANDOM_STEPS + 1) * (STEPS + 1)`` rows.

Candidates are cut at base spans, which stay; each remaining piece of 20 or more characters is a candidate.

All of it is Spark expressions; positions are code points, end exclusive, and come from the lengths of
matches and of the pieces between them.

Defined cases: a null text counts as empty and has no spans. Texts of any length are scanned whole; a text
with very many matches costs little more than in proportion. Null or repeated doc_ids and repeated rows keep
their own results, which are equal for equal texts. Spans of one start are ordered by kind. ``scan`` replaces
columns named like its results; other columns keep their names and values. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, documents, fresh, quoted, text_or_empty

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
RANDOM_FDR = 0.01
CHANGES = 0.15
ALPHABETS = 8  # of one case: hex, letters, base32 and base36, lower or upper
FDR = 0.01
BANDS = (20, 28, 40, 64, 128)  # least lengths
STEPS, STEP = 160, 0.25  # of -log10 p
RANDOM_STEPS = 24
PIECE = 256  # matches whose places are summed at once

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed values: -10 ln of the probability of a to z, rounded down, first for any place, then after each of a to z. Counted,
#: with smoothing, in the sources of Python's library and common licences.
PAIRS = """
27 39 32 32 22 34 38 34 25 51 46 30 35 27 26 35 53 26 26 24 35 44 42 47 40 52
45 33 30 33 40 46 36 48 31 53 44 23 29 18 44 36 53 19 27 20 38 41 47 48 40 53
28 48 40 44 19 48 46 47 22 30 52 20 46 44 28 44 53 31 31 39 19 52 52 51 25 51
26 50 40 46 18 47 50 26 31 53 32 26 45 44 14 45 53 35 40 22 32 50 50 53 48 53
23 45 43 35 11 45 47 46 15 51 50 39 45 42 25 47 53 36 34 39 30 44 49 51 45 53
32 43 30 24 32 34 42 48 40 53 50 26 35 20 41 37 45 18 22 27 48 40 46 32 44 53
29 50 45 42 30 31 49 49 15 54 53 34 47 43 15 45 53 22 37 21 31 52 51 53 37 54
34 49 40 47 15 47 44 18 27 54 53 32 38 26 33 31 54 25 26 39 32 48 50 53 49 50
20 50 47 47 09 49 50 48 22 54 52 45 47 42 23 49 54 39 43 23 43 52 51 53 49 54
33 33 25 37 32 30 32 49 43 53 50 29 32 17 24 42 53 37 21 23 48 39 52 48 51 46
22 46 36 35 10 45 47 48 31 49 43 45 47 41 20 34 48 39 35 41 24 52 49 53 49 53
23 50 41 40 11 46 42 40 22 52 48 30 46 31 32 42 52 38 25 36 35 50 32 52 47 49
24 48 45 35 17 24 45 48 15 54 51 25 48 43 26 45 54 43 30 33 30 48 50 52 36 52
17 36 46 41 13 48 50 49 24 54 51 41 34 43 22 23 54 43 29 40 35 52 51 52 48 54
28 49 28 20 23 40 24 48 32 53 45 41 48 39 23 45 53 44 22 19 35 44 51 53 34 53
42 39 34 29 40 24 43 48 41 52 47 35 30 17 39 28 54 17 32 27 28 37 38 51 50 52
22 50 43 43 19 47 49 42 31 54 50 23 47 43 24 32 53 20 36 27 28 48 49 53 23 54
44 50 47 44 41 48 50 49 42 52 53 36 49 40 41 47 52 36 39 40 03 50 51 53 51 54
24 48 35 40 15 44 34 48 20 53 41 43 32 31 24 40 54 31 29 29 39 43 45 53 35 53
35 50 36 44 12 46 46 32 24 53 46 41 45 43 24 34 52 39 25 18 31 50 49 52 39 53
26 49 43 44 20 45 50 14 20 53 50 42 46 41 26 43 54 26 31 35 33 52 35 52 33 52
38 30 34 32 27 41 43 49 35 52 50 25 29 22 43 32 54 20 22 18 48 52 51 46 51 51
17 50 45 47 07 48 48 48 19 54 52 47 43 43 37 48 54 43 44 43 49 52 50 51 50 53
13 50 46 43 26 47 50 25 13 54 53 38 49 35 26 48 53 28 38 43 49 52 36 52 50 54
29 45 17 43 24 41 50 45 27 54 53 40 42 45 41 20 54 43 39 13 47 51 51 41 43 49
36 46 42 44 30 45 45 47 33 54 51 41 38 35 19 21 54 13 23 24 45 50 42 53 49 50
23 46 46 47 08 46 50 39 19 53 49 32 36 40 31 48 54 42 40 41 42 52 48 52 43 34
"""
#: (pattern of the whole candidate, alphabet); the first that fits counts.
ENCODINGS = (
    ("[0-9a-f]+", _DIGITS + "abcdef"),
    ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("[a-z]+", _LOWER),
    ("[A-Z]+", _UPPER),
    ("[A-Z2-7]+", _UPPER + "234567"),
    ("[0-9a-z]+", _DIGITS + _LOWER),
    ("[0-9A-Z]+", _DIGITS + _UPPER),
    ("[0-9A-Za-z]+", _DIGITS + _UPPER + _LOWER),
    ("[0-9A-Za-z+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
)


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def matches(text: str, pattern: str, group: int | None = None) -> str:
    """SQL: array of (s, e, w) of the pattern's matches: code points, and the text of ``group``.

    Each match begins where the piece before it ends. Places are summed in pieces of ``PIECE`` matches, then over the pieces.
    """
    whole, between = f"regexp_extract_all({text}, {_quote(pattern)}, 0)", f"split({text}, {_quote(pattern)}, -1)"
    word = f"regexp_extract(w, {_quote(pattern)}, {group})" if group else "w"
    sums = lambda items, step: f"aggregate({items}, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, i) -> named_struct('at', a.at + {step}, 'out', array_append(a.out, a.at + {step})))"
    pieces = f"transform(sequence(0, int((size(m) - 1) / {PIECE})), k -> {sums(f'slice(n, k * {PIECE} + 1, {PIECE})', 'i')})"
    starts = f"concat(array(0), {sums('p', 'i.at')}.out)"
    ends = _let("p", pieces, _let("q", starts, "flatten(transform(p, (x, k) -> transform(x.out, e -> e + get(q, k))))"))
    lengths = "transform(m, (w, i) -> length(get(b, i)) + length(w))"
    built = _let("m", whole, _let("b", between, _let("n", lengths, _let("x", ends, f"transform(m, (w, i) -> named_struct('s', get(x, i) - length(w), 'e', get(x, i), 'w', {word}))"))))
    return f"CASE WHEN {text} RLIKE {_quote(pattern)} THEN {built} ELSE cast(array() as array<struct<s:int,e:int,w:string>>) END"


def _tail(z: str) -> str:
    """SQL: the normal distribution's upper tail, for z of 0 or more (Abramowitz and Stegun 7.1.26)."""
    t = f"(1 / (1 + 0.3275911D * ({z}) / {math.sqrt(2)!r}D))"
    # The approximation's coefficients.
    poly = f"({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))))"
    return f"(0.5D * {poly} * exp(-({z}) * ({z}) / 2))"


def battery(token: str) -> str:
    """SQL: the p-value of a random token in the inferred encoding, over all three tests; 0 where no encoding fits."""

    def tests(alphabet: str) -> str:
        k = len(alphabet)
        n = "double(length(w))"
        squares = "aggregate(array_distinct(split(w, '')), 0D, (a, c) -> a + pow(length(w) - length(replace(w, c, '')), 2))"
        chi = f"(({k}D / {n} * {squares} - {n}) - {k - 1}D) / sqrt({2 * (k - 1)}D * (1 - 1 / {n}))"
        uniform = _let("z", chi, f"CASE WHEN z <= 0 THEN 1D ELSE {_tail('z')} END")
        bits = f"translate(w, '{alphabet}', '{'0' * (k // 2) + '1' * (k - k // 2)}')"
        distance = f"abs(regexp_count(bits, '(?<=0)1|(?<=1)0') - both / {n}) / sqrt(both * (both - {n}) / ({n} * {n} * ({n} - 1)))"
        halves = f"CASE WHEN both <= {n} THEN 0D ELSE {_let('z', distance, f'2 * {_tail("z")}')} END"
        runs = _let("bits", bits, _let("ones", "double(length(replace(bits, '0', '')))", _let("both", f"2 * ones * ({n} - ones)", halves)))
        middle, variance = (k - 1) / 2, (k * k - 1) / 12
        values = f"transform(split(w, ''), c -> locate(c, '{alphabet}') - {middle + 1!r}D)"
        serial = _let("v", values, _let("z", f"abs(aggregate(transform(v, (x, i) -> x * coalesce(get(v, i + 1), 0D)), 0D, (a, x) -> a + x)) / ({variance!r}D * sqrt({n} - 1))", f"2 * {_tail('z')}"))
        return f"1 - pow(1 - least(1D, {uniform}, {runs}, {serial}), 3)"

    branches = " ".join(f"WHEN w RLIKE '^{p}$' THEN {tests(a)}" for p, a in ENCODINGS)
    return _let("w", f"translate({token}, '-_', '+/')", f"CASE {branches} ELSE 0D END")


def _costs() -> list[int]:
    """-100 ln of a symbol's probability in ordinary text at 37 * (place of the symbol before, 0 for none) + its place in letters and digits, from 1."""
    pairs = [[int(x) for x in line.split()] for line in PAIRS.split("\n") if line]

    def cost(before: int, i: int) -> int:
        digit, was_digit = i > 26, before > 26
        kind = 0.5 if not before else CHANGES if digit != was_digit else 1 - CHANGES
        return int(-100 * math.log(kind) + (100 * math.log(10) if digit else 10 * pairs[0 if was_digit else before][i - 1]))

    return [cost(before, i) if i else 0 for before in range(37) for i in range(37)]


def unlikely_text(token: str) -> str:
    """SQL: -log10 of the p-value of ordinary text."""
    kinds = f"translate({token}, '{_DIGITS}{_LOWER}{_UPPER}+/_-', '{'0' * 10 + 'a' * 26 + 'A' * 26}')"
    changes = "double(regexp_count(k, '(?<=0)[aA]|(?<=a)[0A]|(?<=A)[0a]'))"
    bound = f"(CASE WHEN f >= 1 THEN -ln({CHANGES}D) ELSE f * ln(f / {CHANGES}D) + (1 - f) * ln((1 - f) / {1 - CHANGES!r}D) END)"
    mixed = _let("k", kinds, f"CASE WHEN length(k) < 2 THEN 0D ELSE {_let('f', f'{changes} / (length(k) - 1)', f'CASE WHEN f <= {CHANGES}D THEN 0D ELSE (length(k) - 1) * {bound} / ln(10D) END')} END")
    places = f"transform(split(lower({token}), ''), c -> locate(c, '{_LOWER + _DIGITS}'))"
    table = "array(" + ",".join(map(str, _costs())) + ")"
    cost = _let("v", places, f"aggregate(transform(v, (x, i) -> get({table}, 37 * coalesce(get(v, i - 1), 0) + x)), 0, (a, x) -> a + x)")
    sizes = (("[0-9a-f]+", 16), ("[0-9A-F]+", 16), ("[a-z]+", 26), ("[A-Z]+", 26), ("[A-Z2-7]+", 32))
    size = "CASE " + " ".join(f"WHEN {token} RLIKE '^{p}$' THEN {k}" for p, k in sizes) + " ELSE 36 END"
    one_case = f"greatest(0D, ({cost} / 100D - length({token}) * ln({size}) - {math.log(ALPHABETS)!r}D) / ln(10D))"
    return f"CASE WHEN {token} RLIKE '^[0-9a-z]+$|^[0-9A-Z]+$' THEN {one_case} ELSE {mixed} END"


def _band(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} >= {b} THEN {b}" for b in reversed(BANDS)) + " END"


def _step(evidence: str, most: int) -> str:
    return f"least({most}, int(floor({evidence} / {STEP})))"


def _pieces(found: str, base: str) -> str:
    """SQL: array of (s, e, w): what base spans leave of the matches in pieces of ``BANDS[0]`` or more characters."""
    gap = "named_struct('at', greatest(a.at, b.e), 'out', IF(b.s > a.at, array_append(a.out, named_struct('s', a.at, 'e', b.s)), a.out))"
    over = f"filter({base}, b -> b.s < x.e AND x.s < b.e)"
    gaps = f"aggregate({over}, named_struct('at', x.s, 'out', cast(array() as array<struct<s:int,e:int>>)), (a, b) -> {gap}, a -> array_append(a.out, named_struct('s', a.at, 'e', x.e)))"
    cut_up = f"transform(filter({gaps}, g -> g.e - g.s >= {BANDS[0]}), g -> named_struct('s', g.s, 'e', g.e, 'w', substring(x.w, g.s - x.s + 1, g.e - g.s)))"
    return f"flatten(transform({found}, x -> {cut_up}))"


def _scanned(df: DataFrame, text: str, base: str, candidates: str) -> DataFrame:
    """``df`` with arrays of base spans (s, e, k) and of candidates (s, e, band, plain, step): grid steps of -log10 p of a random token and of ordinary text."""
    t = fresh(df, "scan")[0]
    df = df.withColumn(t, text_or_empty(text))
    spans = lambda kind, found: f"transform({found}, x -> named_struct('s', x.s, 'k', {kind}, 'e', x.e))"
    assign = spans(0, f"filter({matches(t, ASSIGN, 2)}, x -> length(x.w) >= 6)")
    df = df.withColumn(base, F.expr(f"array_sort(concat({assign}, {spans(1, matches(t, ACCESS))}, {spans(2, matches(t, HEX))}))"))
    shape = f"named_struct('s', x.s, 'e', x.e, 'band', {_band('length(x.w)')}, 'plain', {_step(f"-log10(greatest(1e-9D, {battery('x.w')}))", RANDOM_STEPS)}, 'step', {_step(unlikely_text('x.w'), STEPS)})"
    return df.withColumn(candidates, F.expr(f"transform({_pieces(matches(t, CANDIDATE), _sql(base))}, x -> {shape})")).drop(t)


def _least_step(counts: Mapping[int, int], steps: int, rate: float) -> int | None:
    """The least step of -log10 p from which on all are found, at this false-discovery rate (Benjamini and Hochberg); None if none are."""
    total, reached, out = sum(counts.values()), 0, None
    for step in range(steps, 0, -1):
        reached += counts.get(step, 0)
        if reached and total * 10 ** (-step * STEP) <= rate * reached:
            out = step
    return out


def _limits(df: DataFrame, candidates: str) -> dict[int, tuple[int, int]]:
    """(step from which on candidates are not random, least step at which they are not ordinary text) of each band; bands that report none are left out."""
    rows = df.select(F.explode(quoted(candidates)).alias("c")).groupBy("c.band", "c.plain", "c.step").count().collect()
    out = {}
    for band in {r["band"] for r in rows}:
        mine, by_plain, by_step = [r for r in rows if r["band"] == band], Counter(), Counter()
        for r in mine:
            by_plain[r["plain"]] += r["count"]
        plain = _least_step(by_plain, RANDOM_STEPS, RANDOM_FDR) or RANDOM_STEPS + 1
        for r in mine:
            by_step[r["step"] if r["plain"] < plain else 0] += r["count"]
        if (step := _least_step(by_step, STEPS, FDR)) is not None:
            out[band] = plain, step
    return out


def _all_spans(base: str, candidates: str, limits: dict[int, tuple[int, int]]) -> str:
    if not limits:
        return base
    reached = "CASE c.band " + " ".join(f"WHEN {b} THEN c.plain < {p} AND c.step >= {s}" for b, (p, s) in limits.items()) + " ELSE false END"
    added = f"transform(filter({candidates}, c -> {reached}), c -> named_struct('s', c.s, 'k', 3, 'e', c.e))"
    return f"array_sort(concat({base}, {added}))"


def scan(df: DataFrame, text: str = "text", spans: str = "spans", base: str = "base_spans") -> DataFrame:
    """``df`` without ``text``, with arrays of (s: start, k: index into KINDS, e: end) by start, then kind.

    The scan of the texts happens once; its small results are checkpointed for the corpus counts and the
    answer.
    """
    plain = [c for c in df.columns if c not in (text, spans, base)]
    found = fresh(df, "found")[0]
    slim = cut(_scanned(df, text, base, found).select(*[quoted(c) for c in plain], base, found))
    return slim.withColumn(spans, F.expr(_all_spans(base, found, _limits(slim, found)))).drop(found)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark``; texts without one are untouched.

    The scan happens once: rows and what it found are checkpointed for the corpus counts and the answer.
    """
    base, found, spans, t = fresh(df, "base", "found", "spans", "whole")
    scanned = cut(_scanned(df, text, base, found))
    limits = _limits(scanned, found)
    step = (  # spans overlap or touch: only what lies beyond the last end is copied or marked
        f"named_struct('at', greatest(a.at, x.e), 'out', CASE WHEN x.s >= a.at THEN array_append(a.out, concat(substring(`{t}`, a.at + 1, x.s - a.at), '{mark}')) ELSE a.out END)"
    )
    rebuilt = f"aggregate({spans}, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> {step}, a -> concat(array_join(a.out, ''), substring(`{t}`, a.at + 1)))"
    out = scanned.withColumn(t, text_or_empty(text)).withColumn(spans, F.expr(_all_spans(base, found, limits)))
    clean = F.expr(f"CASE WHEN size({spans}) = 0 THEN {_sql(text)} ELSE {rebuilt} END")
    return out.select(*[clean.alias(c) if c == text else quoted(c) for c in df.columns])


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def joined(spans: str) -> str:
    """SQL: kind:start:end of the spans, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({kinds}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.expr(f"bigint(size(filter(base_spans, x -> x.k = {k})))")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(joined("base_spans")), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"),
    )
