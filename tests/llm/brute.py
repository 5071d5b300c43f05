"""Plain, quadratic versions of the operators, written apart from them; only for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

SPACE = " \t\n\x0b\x0c\r"


class Sets:
    """Union-find whose roots are the least members."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def fingerprint(text):
    w = words(lower_ascii(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    return majority([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams])


def near_groups(rows):
    """doc_id -> component of (doc_id, text) rows with integer ids."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    sets = Sets()
    for i, _ in prints:
        sets.root(i)
    for (a, x), (b, y) in combinations(prints, 2):
        if (x ^ y).bit_count() <= 3:
            sets.join(a, b)
    return {i: (f"{f:016x}", sets.root(i)) for i, f in prints}


def five_word_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies(rows):
    """doc_id -> least doc_id of its group: fingerprints within three bits, or a Jaccard similarity of 0.8 or more."""
    own = [(i, fingerprint(t), five_word_shingles(t)) for i, t in rows]
    sets = Sets()
    for i, *_ in own:
        sets.root(i)
    for (a, x, s), (b, y, t) in combinations(own, 2):
        if (x ^ y).bit_count() <= 3 or s & t and 5 * len(s & t) >= 4 * len(s | t):
            sets.join(a, b)
    return {i: sets.root(i) for i, *_ in own}


def measures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "n_lines": len(lines),
    }


def quality(rows):
    """Verdicts of (doc_id, text, lang, source) rows, in their order: (measures, base_failed, kept)."""
    rules = {"word_length": ("word_chars", 100, "n_words", 60), "symbols": ("n_symbols", 1000, "n_words", 100), "dup_lines": ("n_dup_lines", 1000, "n_lines", 350), "repeats": ("n_repeat_words", 1000, "n_words", 250)}
    judged, groups = [], defaultdict(list)
    for _, text, lang, source in rows:
        m = measures(text)
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        b = {k: m[n] * f // m[d] if m[d] else 0 for k, (n, f, d, _) in rules.items()}
        judged.append((m, failed, b, lang or "", source or ""))
        if not failed:
            for key in ((lang or "", source or ""), (lang or "",), ()):
                groups[key].append(b)

    def fence(key, k):
        v = sorted(b[k] for b in groups[key])
        q1, q3 = (min(x for i, x in enumerate(v) if 4 * (i + 1) >= n * len(v)) for n in (1, 3))
        margin = 3 * (q3 - q1) + rules[k][3]
        return q1 - margin, q3 + margin

    out, known = [], {}
    for m, failed, b, lang, source in judged:
        kept = not failed
        if kept:
            key = next(key for key in ((lang, source), (lang,), ()) if len(groups[key]) >= 50 or not key)
            for k in rules:
                lo, hi = known.setdefault((key, k), fence(key, k))
                kept = kept and lo <= b[k] <= hi
        out.append((m, failed, kept))
    return out


def normal(line):
    low = re.sub("[0-9]", "0", line.lower())
    bare = line.strip(" \t\x0b\x0c\r")
    return [w for w in re.split(r"[ -/:-@\[-`{-~\t\x0b-\r]+", low) if w] or ([bare] if bare else [])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar_lines(a, b):
    """Edit similarity of 0.8 of two normalised lines: by words for every four letters, by characters where neither has over eight words."""
    x, y = a.split(" "), b.split(" ")
    units = lambda w: [u for u in w for _ in range(-(-len(u) // 4))]
    x, y = (a, b) if max(len(x), len(y)) <= 8 else (units(x), units(y))
    most = int(max(len(x), len(y)) * 0.2 + 1e-9)
    if abs(len(x) - len(y)) > most or max(sum((Counter(x) - Counter(y)).values()), sum((Counter(y) - Counter(x)).values())) > most:
        return False  # each edit mends one surplus at most
    return edit_distance(x, y) <= most


def line_dedup(rows):
    """The text of each (doc_id, text) row without repeated lines, and how many lines went; ids are distinct.

    Lines are linked by edit similarity alone, however they are found.
    """
    places = defaultdict(list)
    for doc, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if w := normal(line):
                places[" ".join(w)].append((doc, pos))
    sets = Sets()
    for a, b in combinations(places, 2):
        if similar_lines(a, b):
            sets.join(a, b)
    groups = defaultdict(list)
    for x, p in places.items():
        groups[sets.root(x)] += p
    gone = {p for ps in groups.values() for p in sorted(ps)[1:]}
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for k, x in enumerate(lines) if (doc, k) not in gone]
        out[doc] = (text if len(left) == len(lines) else "\n".join(left), len(lines) if text is not None else 0, len(lines) - len(left))
    return out


def contained(docs, items):
    """(doc_id, item_id, n_shingles, n_shared) of every item that a document contains."""
    split = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    least = {}
    for i, t in items:
        if t is not None:
            least[t] = min(i, least.get(t, i))
    out = []
    for doc, text in docs:
        w = split(text)
        for t, item in least.items():
            v = split(t)
            n = min(5, len(v))
            if n:
                wanted = grams(v, n)
                shared = len(wanted & grams(w, n))
                if shared * 5 >= len(wanted) * 4:
                    out.append((doc, item, len(wanted), shared))
    return out
