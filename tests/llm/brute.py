"""Plain Python versions of the operators, written for clarity and compared on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

from tessera.llm import secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- quality rules


def measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


def base_failed(m):
    return m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]


def kept(text):
    m, text = measures(text), text or ""
    n = m["n_words"]
    return not (
        base_failed(m) or 10 * m["n_symbols"] > 4 * n or (m["n_lines"] >= 5 and 2 * m["n_dup_lines"] > m["n_lines"])
        or m["word_chars"] < 2 * n or m["word_chars"] > 20 * n or 2 * sum(c.isupper() for c in text) > m["word_chars"] or 10 * text.count("!!") > 4 * n
    )


# -- exact dedup


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact_groups(rows):
    """rows: (doc_id, text) -> digest -> indexes, the one that stays first."""
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[hashlib.sha256(normalised(text).encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    return {d: [x[3] for x in sorted(g)] for d, g in groups.items()}


# -- SimHash


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, threshold=4):
    """The smallest id that each fingerprint reaches."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(prints))]


# -- secrets

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


_D, _L, _U = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def not_random(token):
    """The p-value of a random token over the three tests."""
    token = token.replace("-", "+").replace("_", "/")
    for alphabet in (_D + "abcdef", _D + "ABCDEF", _L, _U, _U + "234567", _D + _L, _D + _U, _D + _U + _L, _U + _L + _D + "+/"):
        if all(c in alphabet for c in token):
            break
    k, n, values = len(alphabet), len(token), [alphabet.index(c) for c in token]
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = (k / n * sum(c * c for c in Counter(values).values()) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))
    high = [v >= k // 2 for v in values]
    both = 2 * sum(high) * (n - sum(high))
    if both <= n:
        return 0.0
    changes = sum(a != b for a, b in zip(high, high[1:]))
    runs = abs(changes - both / n) / math.sqrt(both * (both - n) / (n * n * (n - 1)))
    middle = (k - 1) / 2
    serial = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:])) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    return 1 - (1 - min(1.0, tail(chi) if chi > 0 else 1.0, 2 * tail(runs), 2 * tail(abs(serial)))) ** 3


def evidence(token, rate=0.15):
    """-log10 p of ordinary text."""
    if re.fullmatch("[0-9a-z]+|[0-9A-Z]+", token):
        pairs = [list(map(int, line.split())) for line in secrets.PAIRS.strip().split("\n")]
        size = next(k for p, k in (("[0-9a-f]+", 16), ("[0-9A-F]+", 16), ("[a-z]+", 26), ("[A-Z]+", 26), ("[A-Z2-7]+", 32), (".+", 36)) if re.fullmatch(p, token))
        cost, before = 0, None
        for c in token.lower():
            kind = 0.5 if before is None else rate if (c in _D) != (before in _D) else 1 - rate
            letters = pairs[0 if before is None or before in _D else _L.index(before) + 1]
            cost += int(-100 * math.log(kind) + (100 * math.log(10) if c in _D else 10 * letters[_L.index(c)]))
            before = c
        return max(0, (cost / 100 - len(token) * math.log(size) - math.log(8)) / math.log(10))
    kinds = ["0" if c in _D else "a" if c in _L else "A" for c in token if c in _D + _L + _U]
    if len(kinds) < 2:
        return 0
    n = len(kinds) - 1
    f = sum(a != b for a, b in zip(kinds, kinds[1:])) / n
    if f <= rate:
        return 0
    bound = -math.log(rate) if f >= 1 else f * math.log(f / rate) + (1 - f) * math.log((1 - f) / (1 - rate))
    return n * bound / math.log(10)


def least_step(steps, most, rate):
    fit = [s for s in range(1, most + 1) if (r := sum(x >= s for x in steps)) and len(steps) * 10 ** (-s * 0.25) <= rate * r]
    return min(fit) if fit else None


def pieces(text):
    """(start, end) of the candidates that base spans leave."""
    covered = {i for s, _, e in base_spans(text) for i in range(s, e)}
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        start = m.start()
        for i in range(m.start(), m.end() + 1):
            if i == m.end() or i in covered:
                if i - start >= 20:
                    yield start, i
                start = i + 1


def all_spans(texts, fdr=0.01, random_fdr=0.01):
    """The spans of each text, random ones by the false-discovery rates over all texts."""
    found, bands = [], defaultdict(list)
    for t in texts:
        mine = []
        for s, e in pieces(t or ""):
            word = t[s:e]
            plain = min(24, math.floor(-math.log10(max(1e-9, not_random(word))) / 0.25))
            mine.append((s, e, max(b for b in (20, 28, 40, 64, 128) if e - s >= b), plain, min(160, math.floor(evidence(word) / 0.25))))
            bands[mine[-1][2]].append(mine[-1][3:])
        found.append(mine)
    limits = {}
    for band, steps in bands.items():
        plain = least_step([p for p, _ in steps], 24, random_fdr) or 25
        limits[band] = plain, least_step([s if p < plain else 0 for p, s in steps], 160, fdr) or 161
    more = [[(s, 3, e) for s, e, band, plain, step in mine if plain < limits[band][0] and step >= limits[band][1]] for mine in found]
    return [sorted(base_spans(t) + m) for t, m in zip(texts, more)]


def joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text, spans, mark="[SECRET]"):
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


# -- packing


def least_padded(ends, counts, buckets):
    """The least padded total, by recursion over the last bucket's first bin."""
    best, upto = {0: 0}, [sum(counts[:i]) for i in range(len(counts) + 1)]
    for _ in range(buckets):
        new = dict(best)
        for j in range(1, len(ends) + 1):
            options = [best[i] + (upto[j] - upto[i]) * ends[j - 1] for i in range(j) if i in best]
            if options:
                new[j] = min([*options, *([best[j]] if j in best else [])])
        best = new
    return best[len(ends)]


def cosine(a, b, shingle=5):
    """Of the counts of the texts' word shingles; texts of fewer words have one."""

    def counts(text):
        words = [w.lower() for w in WORD.findall(text or "")]
        k = min(shingle, len(words))
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()

    one, two = counts(a), counts(b)
    both = sum(n * two[s] for s, n in one.items())
    return both / math.sqrt(sum(n * n for n in one.values()) * sum(n * n for n in two.values())) if both else float(not one and not two)


# -- chat


def conversations(rows, hmm, features):
    """(conversation, turn) -> (lines, roles, rendered) of (conversation, turn, text) rows with one row a turn: Viterbi over whole conversations."""
    names, out, whole = ("system", "user", "assistant"), {}, defaultdict(list)
    for conv, turn, text in sorted(rows):
        whole[conv].append((turn, text or ""))
    marker = re.compile(r"\s*(?:\*\*)?(?:instructions|system|sys|customer|human|user|q|me|assistant|agent|bot|ai|a)(?:\*\*)?\s*:\s*", re.IGNORECASE)
    for conv, turns in whole.items():
        lines = [(k, line, f) for k, (_, text) in enumerate(turns) for line, f in zip(text.split("\n"), features(text, True), strict=True)]
        shown = [[sum(float(table[s][v]) for table, v in zip(hmm.shows, f, strict=True)) for s in range(6)] for _, _, f in lines]
        best, back = [float(hmm.start[s]) + shown[0][s] for s in range(6)], []
        for row in shown[1:]:
            totals = [[best[a] + float(hmm.moves[a][b]) for a in range(6)] for b in range(6)]
            back.append([t.index(max(t)) for t in totals])
            best = [max(t) + row[b] for b, t in enumerate(totals)]
        path = [best.index(max(best))]
        for choice in reversed(back):
            path.append(choice[path[-1]])
        path.reverse()
        for k, (turn, _) in enumerate(turns):
            mine = [i for i, (j, _, _) in enumerate(lines) if j == k]
            text, roles = "", []
            for i in mine:
                line, state = lines[i][1], path[i]
                if state % 2 == 0 or i == 0:
                    text += ("<|end|>\n" if i != mine[0] else "") + f"<|{names[state // 2]}|>\n"
                    roles.append(names[state // 2])
                    found = marker.match(line)
                    line = line[found.end() :] if found else line
                elif not roles:
                    roles.append(names[state // 2])
                text += line + "\n"
            after = mine[-1] + 1
            if after == len(lines) or path[after] % 2 == 0:
                text += "<|end|>\n"
            out[conv, turn] = (len(mine), ",".join(roles), text)
    return out
