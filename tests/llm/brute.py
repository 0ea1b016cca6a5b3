"""Plain Python versions of the operators' contracts."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def measures(text):
    w, text = words(text), text or ""
    wins = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
    n, hit = collections.Counter(wins), set()
    for j, k in enumerate(wins):
        if n[k] > 1:
            hit |= set(range(j, j + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near(docs, threshold=0.8):
    """(id -> links, id -> least id of the group) of documents with distinct ids."""
    sets, held, links, up = {i: shingles(t) for i, t in docs}, collections.defaultdict(list), collections.Counter(), {i: i for i, _ in docs}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, _ in docs:
        common = collections.Counter(j for t in sets[i] for j in held[t])
        for j, n in common.items():
            if n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for t in sets[i]:
            held[t].append(i)
    return links, {i: find(i) for i, _ in docs}


def substrings(docs, window=50):
    """(id, n_words, n_removed, kept) for each row; ids may repeat or be null."""
    least = {}
    for i, t in docs:
        w = words(t)
        for j in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[j : j + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and least[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        kept = [a for a, b in zip(w, keep, strict=True) if b]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return out


def _either(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def luhn(n):
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(n[::-1])) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15])


def edit_in(text, item):
    """Least edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)
