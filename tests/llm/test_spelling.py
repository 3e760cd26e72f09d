"""Spelling variants against a plain version; signatures against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from brute import UP, prose

from repolumen.llm import spelling


def counted(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(docs):
    words = counted(docs)
    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def rows(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def noisy(seed, n):
    rng = random.Random(seed)
    letters, out = "abcdeéÉß×", []
    base = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(40)]
    for _ in range(n):
        w = rng.choice(base)
        if rng.random() < 0.5:
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", "a", w[i] + "x", "zz"]) + w[i + 1:]
        out.append(w.title() if rng.random() < 0.2 else w)
    return " ".join(out)


def test_variants_equal_the_plain_version(table):
    docs = [(i, noisy(i % 7, 60 + i)) for i in range(60)] + [
        (100, None), (101, ""), (102, " 12 _ "), (103, prose(4, 30_000)), (None, noisy(3, 80)), (7, noisy(9, 50)),
        (7, noisy(9, 50)), (104, "x" * 300_000 + " abcde," * 5), (105, "naïveté naïveté'naïvete naïvetĀ naïveté")]
    want = plain(docs)
    assert rows(spelling.variants(table(docs))) == want
    assert any(f for f, *_ in want.values()) and any(r != f for f, r, *_ in want.values() if f)


@pytest.mark.parametrize(("crowd", "stretch", "distinct"), [(1, 50, 3), (4, 1 << 20, 200_000)])
def test_crowded_signatures_and_small_pieces(table, monkeypatch, crowd, stretch, distinct):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "STRETCH", stretch)
    monkeypatch.setattr(spelling, "DISTINCT", distinct)
    docs = [(i, noisy(i, 90)) for i in range(30)]
    assert rows(spelling.variants(table(docs))) == plain(docs)


@pytest.mark.parametrize(("first", "second"), [(1, 4), (1, 6), (2, 4), (3, 2)])
def test_near_words_share_a_signature(first, second):
    rng = random.Random(first * 10 + second)
    common = [(c, k, 9 - k) for k in range(3) for c in "abcdefg"]
    for scheme in (spelling.PartEnum(2, first, second), spelling.PartEnum(2, first, second, common)):
        for _ in range(300):
            w = "".join(rng.choices("abcdefghij", k=rng.randint(3, 12)))
            i = rng.randrange(len(w))
            v = w[:i] + rng.choice(["", rng.choice("abcxyz"), rng.choice("abcxyz") + w[i]]) + w[i + 1:]
            a, b = scheme.signatures([w, v]).tolist()
            assert set(a) & set(b)
    with pytest.raises(ValueError):
        spelling.PartEnum(2, 1, 2)


def test_ties_and_empty(table):
    docs = [(1, "abcde " * 3 + "abcdf " * 6 + "abcdg " * 6 + "abcdef " * 2)]
    got = rows(spelling.variants(table(docs)))
    assert got == plain(docs) and got["abcde"][0] == min(w for w, r in got.items() if r[2] == 6)
    assert spelling.variants(table([(1, "a")])).count() == 0 and spelling.variants(table([(1, "a")]).limit(0)).count() == 0
