"""Plain versions of the operators' contracts."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(t, lower=True):
    return re.findall(WORD, (t or "").translate(LOWER) if lower else t or "")


def shingles(t, width):
    w = words(t)
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows, width):
    """doc_id: (n_shingles, component_id) by comparing all sets that share a shingle."""
    sets, parent = {i: shingles(t, width) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held, shared = collections.defaultdict(list), collections.Counter()
    for i, s in sorted(sets.items()):
        for g in s:
            for j in held[g]:
                shared[j, i] += 1
            held[g].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def without_repeats(rows, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by looking at each string of length bytes."""
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raw):
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(r), sum(gone), spans, sha(kept)))
    return out


def statistics(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(t, lower=False)
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def later_copies(rows, n=50):
    """doc_id: the words that are in a run of n words that an earlier document has."""
    first, out = {}, collections.defaultdict(set)
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), i) != i:
                out[i].update(range(k, k + n))
    return out
