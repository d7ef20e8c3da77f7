"""Plain Python forms of the operators' contracts."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def low(text):
    return (text or "").encode().lower().decode()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items):
    windows, sizes = collections.defaultdict(set), set()
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(10, len(w))
        if n:
            sizes.add(n)
            for k in range(len(w) - n + 1):
                windows[tuple(w[k:k + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in windows[x] if i is not None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def base_secrets(docs):
    out = []
    for d, t in docs:
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        s.sort()
        out.append((d, *(sum(x[1] == k for x in s) for k in range(3)),
                    sha(",".join(f"{'assign access hex'.split()[k]}:{a}:{b}" for a, k, b in s))))
    return out


def components(docs):
    sets = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    held = collections.defaultdict(list)
    for k, s in enumerate(sets):
        common = collections.Counter()
        for g in s:
            common.update(held[g])
            held[g].append(k)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[max(top(k), top(j))] = min(top(k), top(j))
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            ids[top(k)].append(i)
    return [(i, len(sets[k]), min(ids[top(k)], default=None)) for k, (i, _) in enumerate(docs)]
