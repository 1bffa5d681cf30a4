"""Line dedup against brute force by edit similarity alone."""

import random

import numpy as np

from evq.llm import lines, units
from evq.llm.scratch import Scratch
from tests.llm.test_operators import DOCS


def removed(spark, texts):
    docs = spark.createDataFrame([(i, t, None, "", "") for i, t in enumerate(texts)], DOCS)
    return {(r["doc_id"], r["no"]) for r in lines.duplicates(docs, Scratch(spark, "test-line-pairs")).collect()}


def word(rng, letters="abcdefghijklmnopqrstuvwxyz"):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(5, 10)))


def changed(rng, n, letters="abcdefghijklmnopqrstuvwxyz", by=" "):
    """A line of n words and the same with one other word, similar enough."""
    while True:
        ws = [word(rng, letters) for _ in range(n)]
        a, at = by.join(ws), rng.randrange(n)
        b = by.join([*ws[:at], word(rng, letters), *ws[at + 1 :]])
        if a != b and lines.similar(a, b):
            return a, b


def test_changed_words_are_found(spark):
    """Of lines with one of n words replaced 0.9 or more are found, also in a script without spaces."""
    rng = random.Random(11)
    kana = "".join(map(chr, range(0x3042, 0x3090)))
    kinds = [(6, {}), (8, {}), (12, {}), (20, {}), (8, {"letters": kana, "by": ""})]
    made = [changed(rng, n, **how) for n, how in kinds for _ in range(60)]
    gone = removed(spark, [t for pair in made for t in pair])
    assert all(i % 2 for i, _ in gone)
    for k in range(len(kinds)):
        assert sum((2 * i + 1, 0) in gone for i in range(60 * k, 60 * k + 60)) >= 54


def test_short_words_count(spark):
    """Lines of short words link by their edit similarity like any others, the few long words they have being different."""
    rng = random.Random(12)
    made = []
    while len(made) < 60:
        ws = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(24)]
        a, b = (" ".join([*ws[:12], word(rng), *ws[12:]]) for _ in "ab")
        if lines.similar(a, b):
            made.append((a, b))
    assert sum(i % 2 for i, _ in removed(spark, [t for pair in made for t in pair])) >= 54


def test_large_keys_are_exact(monkeypatch):
    """Which rows have a partner is the same however large a key may be before it is split."""
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 6, (300, 8), np.uint8)
    prints[:, 7] = rng.integers(40, 70, 300)
    prints[:, :7] += (np.arange(300, dtype=np.uint8) % 40 * 6)[:, None]
    prints = prints.view(np.int64).ravel()
    key = np.sort(rng.integers(0, 4, 300))
    want = [any(i != j and key[i] == key[j] and lines.close(prints[i : i + 1], prints[j : j + 1])[0] for j in range(300)) for i in range(300)]
    for pairs in (4096, 20):
        monkeypatch.setattr(lines, "PAIRS", pairs)
        assert lines.partnered(key, prints).tolist() == want
    assert any(want) and not all(want)


def test_short_lines_by_characters(spark):
    """The limit is in characters, so alike in all scripts."""
    assert len("ключевые слова тут".encode()) > lines.MIN_CHARS > len("ключевые слова тут")
    assert removed(spark, ["ключевые слова тут"] * 3 + ["ключевые слова и тут"] * 2 + ["twelve letters and one"] * 2) == {(4, 0), (6, 0)}


def test_numbers_and_marks_are_told_apart(spark):
    """Rows that only share a format stay; case and spaces make no difference, a few other marks little."""
    table = ["2021-03-04 1234.50 77.1", "1998-12-31 9876.99 50.8", "2007-06-15 4402.17 13.4"]
    same = ["The quick brown fox, they said, jumped.", "the quick  brown fox they said jumped", "the QUICK brown fox, they said, jumped. "]
    assert removed(spark, table + same + ["-" * 40] * 2) == {(4, 0), (5, 0)}


def test_pairs_of_small_groups_are_aligned_together(monkeypatch):
    """Pairs of many small groups, of all sizes, link as edit distance alone says, and hardly any is aligned by itself."""
    rng = random.Random(31)
    texts, cells = [], []
    for cell in range(150):
        base = [word(rng) for _ in range(rng.randrange(6, 20))]
        for _ in range(rng.randrange(2, 5)):
            texts.append(" ".join(x if rng.random() > rng.choice([0.05, 0.1, 0.4]) else word(rng) for x in base))
            cells.append(cell)
    alone, distance = [], lines.distance
    monkeypatch.setattr(lines, "distance", lambda a, b: alone.append(1) or distance(a, b))
    cell, ids, none = np.array(cells), np.arange(len(texts)), np.zeros(len(texts), np.int64)
    keys = (cell[ids], ids)
    src, dst = units.sparse(cell, ids, [t.encode() for t in texts], ids, none, lines.close, cell, keys, none - 1, lines.owner, lines.Screen, none)
    assert len(alone) < len(ids) / 5
    group = {i: i for i in ids.tolist()}
    want = dict(group)
    for found, links in ((group, zip(src.tolist(), dst.tolist())), (want, ((i, j) for i in want for j in range(i) if cells[i] == cells[j] and distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j])) + 1e-9))):
        for i, j in links:
            low, high = sorted((found[i], found[j]))
            found.update((k, low) for k in found if found[k] == high)
    assert group == want and 150 < len(set(want.values())) < len(texts)


def test_similar_pairs_leave_little_to_align(monkeypatch):
    """Of a group of n similar lines hardly more than n - 1 pairs are aligned, whatever keys they meet under."""
    rng = random.Random(41)
    texts, cells, ids = [], [], []
    for group in range(30):
        base = [word(rng) for _ in range(20)]
        variants = [" ".join([*base[:k], word(rng), *base[k + 1 :]]) for k in range(10)]
        for key in range(6):
            some = rng.sample(range(10), 6)
            cells += [6 * group + key] * 6
            ids += [10 * group + k for k in some]
            texts += [variants[k] for k in some]
    looked, alike = [], lines.Screen.alike
    monkeypatch.setattr(lines.Screen, "alike", lambda self, a, b: looked.extend(a) or alike(self, a, b))
    cell, ids, none = np.array(cells), np.array(ids), np.zeros(len(ids), np.int64)
    src, dst = units.sparse(cell, ids, [t.encode() for t in texts], ids, none, lines.close, cell, (cell, np.arange(len(ids))), none - 1, lines.owner, lines.Screen, none)
    assert len(src) == len(set(ids.tolist())) - 30
    assert len(looked) < 1.1 * len(src)


def test_packed_rows_meet_alike(monkeypatch):
    """Rows that are dealt out as packed values, some twice and some of a large key, meet as those of single rows do; what passes because it can't be held loses no row."""
    rng = np.random.default_rng(6)
    key = rng.integers(-(2**63), 2**63 - 1, 300)[rng.integers(0, 300, 900)]
    key[:200] = key[0]
    ids = rng.integers(0, 400, 900)
    prints = np.zeros(900, np.int64)
    some = rng.integers(0, 900, 300)  # another task has these too
    values = sorted([*units.packed(key, ids, prints), *units.packed(key[some], ids[some], prints[some])], key=lambda x: x[0])
    want = {}
    for k, i in zip(key.tolist(), ids.tolist()):
        want.setdefault(k, set()).add(i)
    want = {frozenset(x) for x in want.values() if len(x) > 1}
    for bucket, held in ((1 << 22, 1 << 16), (60, 40), (4, 1 << 16)):
        monkeypatch.setattr(units, "BUCKET", bucket)
        monkeypatch.setattr(units, "HELD", held)
        buckets = units.Buckets(None)
        found = {}
        for columns in [*(c for b, v in values for c in buckets.add(b, v)), *buckets.rest()]:
            for k, i in zip(columns[0].tolist(), columns[1].tolist()):
                found.setdefault(k, set()).add(i)
        got = {frozenset(x) for x in found.values()}
        assert want <= got and all(len(x) == 1 for x in got - want)
        assert bucket == 4 or got == want
