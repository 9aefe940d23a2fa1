"""The contracts in plain Python, row by row, for small inputs."""
import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[low(t)].append(i)

    def owner(t):
        return max((i for i in groups[low(t)] if i is not None), default=None)
    return [(i, owner(t), len(groups[low(t)]), i == owner(t), sha(low(t))) for i, t in docs]


def substring(docs, size):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = collections.Counter(tuple(w[a:a + size]) for w in words for a in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(docs, words):
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if seen[tuple(w[a:a + size])] > 1:
                gone[a:a + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def contamination(docs, items, size):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in items:
        w = word.findall(low(text))
        for a in range(len(w) - min(size, len(w)) + 1 if w else 0):
            windows[tuple(w[a:a + min(size, len(w))])].add("" if item is None else str(item))
    out = []
    for i, t in docs:
        w, found = word.findall(low(t)), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit[a:a + n] = [True] * n
                    found |= windows[tuple(w[a:a + n])]
        n = sum(hit)
        out.append((i, len(w), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(w)))
    return out


def lines(docs, mode, min_docs, min_length=1):
    def keys(t):
        return [low(x.strip(" \t\n\r\x0b\x0c")) for x in (t or "").split("\n")]
    holders, first = collections.defaultdict(set), {}
    for i, t in docs:
        for k in keys(t):
            holders[k].add(i)
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        for p, k in enumerate(keys(t)):
            first.setdefault(k, (i, p))
    out = []
    for i, t in docs:
        raw = (t or "").split("\n")
        gone = [len(k) >= min_length and (len(holders[k]) >= min_docs if mode == "frequent" else first[k] != (i, p))
                for p, k in enumerate(keys(t))]
        out.append((i, len(raw), sum(gone), "\n".join(x for x, g in zip(raw, gone) if not g)))
    return out


def jaccard(docs, size, percent):
    sets = []
    for _, t in docs:
        w = WORD.findall(low(t))
        sets.append(frozenset(tuple(w[a:a + size]) for a in range(max(1, len(w) - size + 1))) if w else frozenset())
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        r = find(a)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return [(i, len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(docs)]


def language_model(docs, folds, fold, weight, power):
    rows = []
    for i, t in docs:
        held = i is None or zlib.crc32(str(i).encode()) % folds == fold
        rows.append((i, held, WORD.findall(low(t)) + [" end"]))
    one, two = collections.Counter(), collections.Counter()
    for _, held, w in rows:
        if not held:
            one.update(w)
            two.update(zip(w, w[1:]))
    n, v, out = sum(one.values()), len(one), []
    for i, held, w in rows:
        p = [(one[x] + .1) / (n + .1 * (v + 1)) for x in w]
        score = math.log10(p[0])
        for h, x, q in zip(w, w[1:], p[1:]):
            m = weight * one[h] ** power
            score += math.log10((two[h, x] + m * q) / (one[h] + m) if one[h] else q)
        out.append((i, held, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, p)), score))
    return out


def base_secrets(text):
    text = text or ""
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                        re.A)
    spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]
