"""Spelling variants against brute force, with every odd kind of row and hot groups."""

import random
import re
import zlib
from collections import Counter

import pytest

from emberwatch.llm import spelling

SCHEMA = "doc_id long, text string, n long, word string, form string, run string, h int, id string"


def documents(seed=2):
    rng = random.Random(seed)
    letters = "abcdeéÿ×"
    stems = ["".join(rng.choices(letters, k=rng.randrange(6, 11))) for _ in range(40)]
    stems += ["prefix" + s for s in stems[:15]] + [s + "suffix" for s in stems[:15]] + ["aaaaaa", "aaaaaaa", "aaaaaaaa"]

    def edited(w):
        at = rng.randrange(len(w) + 1)
        return rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]])

    rows = []
    for i in range(60):
        words = []
        for _ in range(400):
            w = rng.choice(stems[: rng.choice([3, 20, len(stems)])])
            w = edited(w) if rng.random() < 0.2 else w
            w = edited(w) if rng.random() < 0.1 else w
            words.append(w.capitalize() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-1", ",\n"]).join(words)))
    long = "x" * 3_000
    rows += [(None, rows[0][1]), (None, None), (61, None), (62, ""), (63, " .. "), rows[1], rows[1]]
    rows += [(70, " ".join([long, long[:-1], "y" + long] * 8)), (71, " ".join(["Éclairs", "éclairs", "ÉCLAIRS"] * 9))]
    rows += [(72, "abcdef ghijkl " * 50_000)]
    rows += [(73, "linkagexx " * 6 + "linkagex " * 45 + "linkage " * 300)]  # a chain of forms
    return rows


def counted(rows):
    """By the definition: maximal runs, lower-cased, some shortened."""
    out = Counter()
    low = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def edits(a, b):
    """The full matrix."""
    above = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
        above = row
    return above[-1]


def one_apart(a, b):
    """Whether removing or replacing one code point makes them equal."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    near = {w: {v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_apart(v, w)} for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.fixture(scope="module")
def rows():
    return documents()


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash", None, "clash", 0, None) for i, t in rows], SCHEMA)


def test_one_apart_is_edit_distance_one():
    rng = random.Random(1)
    for _ in range(2_000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(1, 6))) for _ in range(2))
        assert one_apart(a, b) == (edits(a, b) == 1)


def test_vocabulary(spark, rows):
    got = {r.word: r.n for r in spelling.vocabulary(table(spark, rows).repartition(7)).collect()}
    assert got == counted(rows)
    assert got["éclairs"] * 2 == got["Éclairs"] == 18  # only A-Z is lower-cased


@pytest.mark.parametrize("block", [16_384, 8])
def test_variants(spark, rows, block, monkeypatch):
    """Also with groups cut into blocks of a few words, and few queries and rows at a time."""
    if block == 8:
        monkeypatch.setattr(spelling, "_QUERIES", 5)
        monkeypatch.setattr(spelling, "_ROWS", 50)
    found = spelling.variants(spelling.vocabulary(table(spark, rows)), block=block).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    want = grouped(counted(rows))
    assert len(found) == len(got) and got == want
    assert sum(f is not None for f, *_ in want.values()) > 20
    assert want["linkagexx"][:2] == ("linkagex", "linkage")


def test_no_words(spark):
    for texts in ([], [(1, None), (2, "short words only"), (3, "sometimes seen")]):
        assert spelling.variants(spelling.vocabulary(table(spark, texts))).collect() == []
