"""Plain statements of what the operators compute, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width=4):
    found = words((text or "").translate(LOWER))
    return frozenset(tuple(found[k : k + width]) for k in range(max(1, len(found) - width + 1))) if found else frozenset()


def jaccard_components(rows, width=4, percent=85):
    sets, union = [(i, shingles(t, width)) for i, t in rows], Sets()
    for i, a in sets:
        for j, b in sets:
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                union.link(i, j)
    return sorted((i, len(s), union.find(i)) for i, s in sets)


def without_repeats(rows, width=50):
    first, result = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        found = words(text)
        gone = [False] * len(found)
        for s in range(len(found) - width + 1):
            if first.setdefault(tuple(found[s : s + width]), i) < i:
                gone[s : s + width] = [True] * width
        result.append((i, len(found), sum(gone), " ".join(w for w, g in zip(found, gone) if not g)))
    return sorted(result)


def fuzzy_lines(rows, size=5, percent=80):
    """The text each row keeps; every pair of lines is compared."""
    lines = defaultdict(list)
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                lines[line].append((i, n))
    listed = sorted(lines)
    sets = [frozenset(line[k : k + size] for k in range(max(1, len(line) - size + 1))) for line in listed]
    union = Sets()
    holders = defaultdict(list)
    for n, s in enumerate(sets):
        common = Counter(m for shingle in s for m in holders[shingle])
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m]) - c):
                union.link(n, m)
        for shingle in s:
            holders[shingle].append(n)
    first = {}
    for n, line in enumerate(listed):
        root = union.find(n)
        first[root] = min([*lines[line], *([first[root]] if root in first else [])])
    kept = set(first.values())
    return sorted(
        (i, "" if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) in kept or not x.strip(" \t\n\x0b\x0c\r"))) for i, t in rows
    )


def quality(text):
    found = words(text)
    windows = [tuple(found[k : k + 5]) for k in range(len(found) - 4)]
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(k, k + 5))
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    n = len(found)
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), n < 10 or 100 * len(covered) > 20 * n


def targets(sizes, weights=(1, 2, 3), repeats=3):
    """Water filling by hand: share what is left by weight, stop who is full, share again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return full
        left = (total - sum(full.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > repeats * sizes[s]]
        if not over:
            return full | {s: left * weight[s] for s in open_}
        full |= {s: repeats * sizes[s] for s in over}


def crc(text):
    """The checksum bit by bit, as its polynomial defines it."""
    value = 0xFFFFFFFF
    for byte in text.encode():
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def spelling(rows, shortest=6, least=5, ratio=5, dropped=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc(f"{'' if i is None else i}:{run}")
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % dropped == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    result = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        result.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(result, key=lambda r: r[0])


def accepted_ends(template, words, start):
    """Every end of wording of ``template`` (markup as in the operator) that starts at ``start``, by walking its parts."""
    def parse(parts):
        made = []
        while parts and parts[0] != "]":
            part = parts.pop(0)
            if part == "[":
                made.append(parse(parts))
                parts.pop(0)
            elif m := re.fullmatch(r"\{(\d+)-(\d+)\}", part):
                made.append((int(m[1]), int(m[2])))
            else:
                made.append(part)
        return made

    def ends(parts, at):
        found = {at}
        for part in parts:
            if isinstance(part, str):
                found = {k + 1 for k in found if k < len(words) and words[k] == part}
            elif isinstance(part, tuple):
                found = {k + n for k in found for n in range(part[0], part[1] + 1) if k + n <= len(words)}
            else:
                found = found | {e for k in found for e in ends(part, k)}
        return found

    return ends(parse(re.findall(r"\[|\]|\{\d+-\d+\}|[^\s\[\]{}]+", template)), start)


def license_spans(text, templates):
    """(start, end, label) of the longest wording from each start, for each (label, template)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for start in range(len(words)):
        for label, template in templates:
            if template.split()[0] == words[start] and (ends := accepted_ends(template, words, start)):
                found.append((start, max(ends), label))
    return len(words), sorted(found)


def divergences(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    rows = [tuple(v or "" for v in row) for row in rows]
    held, counts, groups = defaultdict(set), Counter(), defaultdict(set)
    for n, (text, lang, source) in enumerate(rows):
        groups[lang].add(source)
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)):
            held[lang, term].add(n)
            counts[lang, source, term] += 1
    result = []
    for lang, sources in groups.items():
        kept = [t for la, t in held if la == lang and len(held[la, t]) >= least]
        size = len(kept)

        def shares(names):
            total = sum(counts[lang, s, t] for s in names for t in kept)
            return {t: 1 + 1_000_000_000 * (sum(counts[lang, s, t] for s in names) + 2) // (total + 2 * size) for t in kept}

        part = {s: shares([s]) for s in sources}
        q = shares(sources)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(gap(part[s][t], part[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(part[s][t], q[t])) for t in kept if counts[lang, s, t] and part[s][t] > q[t]]
            for name, listed, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(listed, key=lambda x: (-x[1], x[0].encode()))[:most]
                result += [(lang, s, name, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)]
    return sorted(result)
