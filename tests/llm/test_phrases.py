"""Collocations and their automata against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tracewright.llm import common, phrases

FOLDER = "/root/testdata/sf0.001"


def brute(rows, best=2000, most=3, least=10, inside=50):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, low = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        for p, a in frequent.items():
            if 100 * inner[p] >= inside * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:best])]
    return sorted(out)


def rows_of(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def listed(found):
    """phrase: count of what an automaton or phrases hold."""
    out = {}
    for depth, level in enumerate(found.levels):
        columns = phrases._columns(found, depth + 1)
        for row in range(len(level.word)):
            if level.count[row]:
                out[tuple(found.words[c[row]] for c in columns)] = int(level.count[row])
    return out


def random_phrases(rng, n=400, letters="abcdef"):
    codes = np.array([rng.choice([*range(len(letters)), -1]) for _ in range(n)])
    codes = codes[np.isin(codes, np.arange(len(letters))) | (codes < 0)]
    plain = Counter()
    for i in range(len(codes)):
        for k in range(1, 4):
            if i + k <= len(codes) and (codes[i : i + k] >= 0).all():
                plain[tuple(letters[c] for c in codes[i : i + k])] += 1
    return phrases.counted(codes, list(letters)), dict(plain)


def test_automata_hold_unite_cut_and_compose():
    rng = random.Random(1)
    for _ in range(60):
        letters = "".join(sorted(rng.sample("abcdefgh", rng.randint(1, 6))))
        a, plain_a = random_phrases(rng, rng.randint(0, 300), letters)
        b, plain_b = random_phrases(rng, 200, "abxy")
        least = phrases.automaton(a)
        assert listed(a) == plain_a and listed(phrases.phrases_of(phrases.unpacked(phrases.packed(least)))) == plain_a
        # no two states have the same arcs
        arcs = [tuple(zip(*(x[s:e].tolist() for x in (least.word, least.weight, least.target)), strict=True)) for s, e in zip(least.first[:-1], least.first[1:], strict=True)]
        assert len(set(arcs[:-1])) == len(arcs) - 1
        both = Counter(plain_a) + Counter(plain_b)
        assert listed(phrases.united([a, b])) == both
        assert listed(phrases.united([a, b], 5)) == {p: n for p, n in both.items() if n >= 5}
        assert listed(phrases.composed(b, least)) == {p: plain_a[p] for p in plain_b if p in plain_a}
        bounds = sorted({("x", rng.choice("abcdefgh"), rng.choice(["", *"abcz"])) for _ in range(4)})
        seen = {}
        for number, part in phrases._in_ranges(a, "x", bounds):
            for p, n in listed(part).items():
                assert p not in seen and number == sum(x[1:] <= (*p, "")[:2] for x in bounds)
                seen[p] = n
        assert seen == plain_a


def test_query_equals_brute_force(spark, monkeypatch):
    rows = [(r.lang, r.text) for r in common.table(spark, FOLDER, "documents").collect()]
    want = brute(rows)
    assert rows_of(phrases.report(common.table(spark, FOLDER, "documents"))) == want and len(want) > 50
    monkeypatch.setattr(phrases, "TOGETHER", 3000)
    monkeypatch.setattr(phrases, "WAITING", 2000)
    monkeypatch.setattr(phrases, "SENT", 1000)
    assert rows_of(phrases.report(common.table(spark, FOLDER, "documents"))) == want


def test_edges(spark):
    rows = [("en", "New York, new york! New  York\tnew york"), ("en", None), (None, "a b " * 40), ("und", "a b c. " * 12), ("", "x y;" * 10), ("en", ""), ("en", "x\x0by\x0cx y\rX Y " * 30)]
    rows += [("en", "big apple " * 11), ("en", "big apple " * 11), ("de", "Ärger über ärger " * 20), ("de", "é 🙂 \x00 | é 🙂 " * 15), ("en", "word " * 60_000), ("fr", ", . ;")]
    frame = spark.createDataFrame([(1, t, lang, 1, "c") for lang, t in rows], "doc_id long, text string, lang string, rank int, phrase string")
    want = brute(rows)
    assert rows_of(phrases.report(frame)) == want and {r[0] for r in want} >= {"en", "und", "", "de"}
    assert rows_of(phrases.mine(frame, best=2, least=5)) == brute(rows, best=2, least=5)
    assert rows_of(phrases.mine(frame, most=4)) == brute(rows, most=4)
    assert phrases.report(frame.limit(0)).count() == 0


def test_scores_beyond_64_bits():
    big = 10**13
    level = lambda p, w, c: phrases.Level(np.array(p), np.array(w), np.array(c))
    own = phrases.Phrases(["a", "b"], [level([0], [0], [3 * big]), level([0], [1], [big])])
    parts = phrases.Phrases(["a", "b"], [level([0, 0], [0, 1], [3 * big, 2 * big])])
    row = phrases._scored("en", own, parts).iloc[0]
    assert (row.a, row.l, row.r, row.score) == (big, 3 * big, 2 * big, 1_000_000 // 6)
