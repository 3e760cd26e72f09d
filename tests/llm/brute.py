"""Plain single-process versions of the contracts, for comparison on small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti", "ve", "zu") for b in ("", "n", "r", "st", "lo")]


def prose(seed: int, n: int) -> str:
    """Fixed pseudo-random prose."""
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(WORDS[(x >> 16) % len(WORDS)])
    return " ".join(out)


UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def luhn(d: str) -> bool:
    t = 0
    for i, c in enumerate(d[::-1]):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        t += v
    return t % 10 == 0


def pii(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def pii_text(spans) -> str:
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in spans)


def shingles(text: str | None, width: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def near(docs: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int, bool]]:
    """``doc_id -> (set size, component, kept)``, with an inverted list instead of sketches."""
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    lists = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter()
        for s in sets[i]:
            common.update(lists[s])
            lists[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def contamination(docs, items) -> dict:
    windows = collections.defaultdict(set)
    sizes = set()
    for item, text in items:
        w = bench_words(text)
        n = min(13, len(w))
        if n:
            sizes.add(n)
            for i in range(len(w) - n + 1):
                windows[tuple(w[i:i + n])].add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(docs: list[tuple[int, str | None]], length: int = 200) -> dict:
    count = collections.Counter()
    raw = {i: (t or "").encode() for i, t in docs}
    for b in raw.values():
        count.update(b[s:s + length] for s in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        runs = len([1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])])
        out[i] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out
