"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def components(ids: list, sets: dict, percent: int = 80) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def passages(docs: list[tuple[int, str | None]], width: int = 13) -> dict:
    """doc_id -> (n_words, n_removed, words left); documents in order of their ids."""
    first: dict = {}
    out = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        words = WORD.findall(text or "")
        covered = [False] * len(words)
        for k in range(len(words) - width + 1):
            if first.setdefault(tuple(words[k : k + width]), i) < i:
                covered[k : k + width] = [True] * width
        left = " ".join(w for w, c in zip(words, covered, strict=True) if not c)
        out[i] = (len(words), sum(covered), left)
    return out


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(b, ("assign", "access", "hex")[k], e) for b, k, e in sorted(spans)]


def bare_words(text: str | None) -> list[str]:
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").translate(LOWER))


def local_score(a: list[str], b: list[str]) -> int:
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        here = [0]
        for j, y in enumerate(b):
            here.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, here[j] - 1))
        best, above = max(best, max(here)), here
    return best


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], least: float = 0.5) -> set:
    """Pairs with a score of at least ``least``, of those that share three words in a row."""
    grams = defaultdict(set)
    words = {i: bare_words(t) for i, t in items}
    for i, w in words.items():
        for k in range(len(w) - 2):
            grams[tuple(w[k : k + 3])].add(i)
    out = set()
    for d, text in docs:
        w = bare_words(text)
        for i in set().union(*(grams.get(tuple(w[k : k + 3]), ()) for k in range(len(w) - 2))) if len(w) > 2 else ():
            if local_score(words[i], w) >= least * 2 * len(words[i]):
                out.add((d, i))
    return out


SYMBOLS = "#*$%&|<>"
BOILERPLATE = re.compile(
    r"(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|all rights reserved|copyright|licensed under|subscribe|"
    r"newsletter|sign (in|up)|log ?in|click here|read more|share this|powered by)\b",
    re.A,
)


def quality(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    seen = defaultdict(list)
    for k in range(len(words) - 7):
        seen[tuple(words[k : k + 8])].append(k)
    repeated = {j for places in seen.values() if len(places) > 1 for k in places for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def chars(x):
        return sum(len(w) for w in WORD.findall(x))

    def bad(x):
        n = x.strip(" ").count(" ") + 1
        return (
            2 * sum(c in SYMBOLS + "!" for c in x) > n
            or 4 * sum(c in "|>»•·" for c in x) >= n
            or not re.search(r"[.!?…。]['\")\]”’»]*([ \t\n\x0b\f\r]|$)", x)
            or n <= 25 and bool(BOILERPLATE.search(x))
        )

    clean = "\n".join(x for x in text.split("\n") if not WORD.search(x) or not bad(x))
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return {
        "n_words": len(words), "word_chars": chars(text), "n_symbols": sum(c in SYMBOLS for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "base_failed": failed,
        "kept": not failed and 100 * (chars(text) - chars(clean)) <= 60 * chars(text), "clean": clean,
    }
