"""Plain forms of what the operators do, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re

digits = lambda x: re.sub("[^0-9]", "", x)


def luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
]
_either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
_WORDS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
SECRETS = [
    ("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def spans(text: str, kinds) -> list[tuple[str, int, int]]:
    out = [(m.start(), k, m.end(), n) for k, (n, p, f) in enumerate(kinds) for m in re.finditer(p, text) if f(m)]
    return [(n, a, b) for a, _, b, n in sorted(out)]


def digest(found) -> str:
    return hashlib.sha256(",".join(f"{n}:{a}:{b}" for n, a, b in found).encode()).hexdigest()


def shingles(text: str | None, k: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(rows: list[tuple[int, str | None]], k: int, percent: int) -> list[tuple[int, int]]:
    """Set size and least linked id of each row."""
    sets, up = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in held[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
        for x in s:
            held[x].append(i)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(len(s), least[root(i)]) for i, s in enumerate(sets)]


def lm_scores(texts: list[str | None], train: list[int], mass: float, base: float) -> list[float]:
    """log10 of each text's probability, from counts that are quantised as levels to the given base."""
    words = [[*(t or "").encode().lower().split(), None] for t in texts]
    one, two = collections.Counter(), collections.Counter()
    for i in train:
        one.update(words[i])
        two.update(zip([None, *words[i]], words[i], strict=False))

    def said(c: int) -> float:
        if c <= 1:
            return c
        j = 1
        while base**j <= c:
            j += 1
        return (base ** (j - 1) + base**j) / 2

    unit, out = sum(one.values()) + 0.5 * (len(one) + 1), []
    for w in words:
        total = 0.0
        for v, x in zip([None, *w], w, strict=False):
            c = said(one[v])
            total += math.log10((min(said(two[v, x]), c) + mass * (said(one[x]) + 0.5) / unit) / (c + mass))
        out.append(total)
    return out


def pii_entities(kind: str, value: str) -> set:
    """A value, the part that others share, and its kind."""
    plain = {"email": str.lower, "ip": str, "card": digits, "phone": digits}[kind](value)
    part = {"email": lambda: plain.split("@")[1], "ip": lambda: ".".join(plain.split(".")[:2]), "card": lambda: plain[:6], "phone": lambda: re.match(r"\+([0-9]*)", value)[1][:3]}[kind]()
    return {(kind, plain), (kind, "part", part), (kind,)}


def pii_terms(texts: list[str | None], generalise: float, remove: float) -> list[list[tuple[int, int, str]]]:
    """Start, end and form of each telling term of each text."""
    seen = []
    for t in texts:
        t = t or ""
        base = spans(t, PII)
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"(?<![^\W_])[^\W\d_]+(?![^\W_])", t) if not any(a < m.end() and m.start() < b for _, a, b in base)]
        seen.append((set().union(*(pii_entities(k, t[a:b]) for k, a, b in base)), words))
    n = len(texts)
    n_entity = collections.Counter(e for es, _ in seen for e in es)
    n_term = collections.Counter(w for _, ws in seen for w in {x.lower() for x, _, _ in ws})
    both, where = collections.Counter(), collections.defaultdict(set)
    for t, (es, ws) in zip(texts, seen, strict=True):
        for pair in {(e, w.lower()) for e in es for w, _, _ in ws}:
            both[pair] += 1
            where[pair].add(t)
    told = {}
    for (e, w), c in both.items():
        own, k = math.log2(n / n_entity[e]), len(where[e, w])
        if own > 0 and (d := math.log2(n * c / (n_term[w] * n_entity[e])) / own * (k / (k + 1)) ** 2) >= generalise - 1e-9:
            told[e, w] = d >= remove - 1e-9
    out = []
    for es, ws in seen:
        rows = []
        for w, a, b in ws:
            how = [told[e, w.lower()] for e in es if (e, w.lower()) in told]
            form = "code" if w[:2].isupper() and len(w) > 1 else "name" if w[0].isupper() else "term"
            rows += [(a, b, "gone" if any(how) else form)] if how else []
        out.append(sorted(rows))
    return out


def contaminated(text: str | None, item: str | None, least: int, share: float, whole: int, miss: int) -> bool:
    """Whether some alignment of item and text has a stretch of enough equal words, replaced ones counting against it."""
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    d, b = split(text), split(item)
    if not b or not d:
        return False
    if len(b) <= 2:
        return d == b
    best = 0
    for shift in range(-len(b) + 1, len(d)):
        run = 0
        for k in range(max(0, -shift), min(len(b), len(d) - shift)):
            run = max(run, 0) + (1 if d[shift + k] == b[k] else -miss)
            best = max(best, run)
    return best >= (len(b) if len(b) < whole else min(least, math.ceil(len(b) * share)))
