"""The operators' contracts in plain Python."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def repeats(rows, window, words):
    seqs = [(d, SPACE_WORD.findall(t or "") if words else (t or "").encode()) for d, t in rows]
    seen = Counter(tuple(s[i : i + window]) for _, s in seqs for i in range(len(s) - window + 1))
    out = []
    for d, s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(s, gone) if not g]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(s), sum(gone), sha(" ".join(kept))) if words else (d, len(s), sum(gone), spans, sha(bytes(kept))))
    return sorted(out, key=str)


def contamination(rows, items):
    windows = []
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        n = min(len(w), 10)
        windows += [(item, tuple(w[i : i + n])) for i in range(max(len(w) - 9, 1)) if w]
    out = []
    for d, t in rows:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    ids |= {str(item)} - {"None"}
        out.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return sorted(out, key=str)


def secrets(rows):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = []
    for d, t in rows:
        t = t or ""
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        n = Counter(x[2] for x in found)
        out.append((d, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found)))))
    return sorted(out, key=str)


def shingle_sets(rows, k):
    out = []
    for _, t in rows:
        w = SPACE_WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def groups(rows, k=4, percent=85):
    """(sets, root of each row)."""
    sets = shingle_sets(rows, k)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    common = Counter(p for x in by.values() for p in itertools.combinations(x, 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    return sets, [root(i) for i in range(len(rows))]


def jaccard(rows, k=4, percent=85):
    sets, roots = groups(rows, k, percent)
    least: dict[int, int] = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted([(d, len(s), least.get(r) if s else d) for (d, _), s, r in zip(rows, sets, roots)], key=str)


def quality(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = SPACE_WORD.findall(t)
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {p for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        bad = 10 * symbols > 3 * len(w) or 10 * t.count("!") > 5 * len(w) or chars > 25 * len(w) or chars < 2 * len(w) or 10 * dup > 6 * len(lines)
        out.append((d, len(w), chars, symbols, dup, len(rep), failed, not failed and not bad))
    return sorted(out, key=str)
