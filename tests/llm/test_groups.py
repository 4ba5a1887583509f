"""Operators across documents, against brute force, with every odd kind of row."""

import json
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import chat, decontaminate, mixing, neardup, passages
from emberwatch.llm.components import components

SCHEMA = "doc_id long, text string, source string, n_words long, node string, _id long"


def texts(seed=1):
    """Originals, exact and near copies (also in chains and one large star), odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    out = []
    for _ in range(6):
        base = [word() for _ in range(120)]
        out.append(" ".join(base))
        for edits in (0, 1, 2, 3, 4, 6):
            copy = list(base)
            for at in rng.sample(range(120), edits):
                copy[at] = word()
            out.append(" ".join(copy).upper() if edits == 1 else " ".join(copy))
        chain = list(base)
        for k in range(5):
            chain[20 * k : 20 * k + 2] = [word(), word()]
            out.append("\n".join(chain))
    star = [word() for _ in range(200)]
    for _ in range(80):
        copy = list(star)
        for at in rng.sample(range(200), 4):
            copy[at] = word()
        out.append(" ".join(copy))
    out += [None, "", "  \n", "one two", "One  TWO", "a b c d e", "a b c d e f", None]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}", 0, "clash", -1) for i, t in enumerate(texts())]
    rows += [rows[3], (None, rows[5][1], None, None, None, None), (None, "alone in here, no id at all", None, None, None, None)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows, least):
    """For each set, the sets that are reachable by links of at least this similarity."""
    sets = sorted({shingles(r.text) for r in rows} - {frozenset()}, key=sorted)
    above = list(range(len(sets)))

    def root(i):
        return i if above[i] == i else root(above[i])

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= least * (len(a) + len(sets[j]) - both):
                above[root(i)] = root(j)
    return {s: root(i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("cell, small", [(256, 32), (8, 2)])
def test_near_duplicates(docs, monkeypatch, cell, small):
    """Also with buckets so limited that most comparisons are made in cells."""
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "SMALL", small)
    rows = docs.collect()
    found = groups(rows, 85)
    least = {}
    for r in rows:
        if r.doc_id is not None and shingles(r.text):
            g = found[shingles(r.text)]
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    want = Counter()
    for r in rows:
        s = shingles(r.text)
        c = least.get(found[s]) if s else r.doc_id
        want[(r.doc_id, len(s), c, r.doc_id == c)] += 1
    assert by == want


def test_one_row_of_each_group(docs):
    rows = docs.collect()
    found = groups(rows, 85)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    full = [r for r in kept if shingles(r.text)]
    assert sorted(found[shingles(r.text)] for r in full) == sorted(set(found.values()))
    assert len(kept) - len(full) == sum(not shingles(r.text) for r in rows)
    assert neardup.deduplicated(docs.limit(0)).isEmpty()


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    sketch = neardup.Sketch()
    a, b = (rng.integers(0, 1 << 63, 1000, dtype=np.uint64) for _ in range(2))
    union = np.maximum(sketch.registers(a), sketch.registers(b))
    assert (sketch.registers(np.concatenate([a, b])) == union).all()
    for share in (0.3, 0.9):
        other = a.copy()
        other[: int(1000 * (1 - share))] = b[: int(1000 * (1 - share))]
        one, two = sketch.registers(a), sketch.registers(other)
        real = len(np.intersect1d(a, other)) / len(np.union1d(a, other))
        grid = np.linspace(0, 1, 101)[:-1]
        likely = [sketch.log_likelihood((one > two).sum(), (one < two).sum(), 0.5, j) for j in grid]
        assert abs(grid[int(np.argmax(likely))] - real) < 0.15
        assert bool(sketch.may_reach(one[None], two[None], np.array([1000]), np.array([1000]), 0.8)[0]) == (share == 0.9)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    links += [(470, i) for i in range(471, 499)]
    above = list(range(500))

    def root(i):
        return i if above[i] == i else root(above[i])

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        above[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: min(m for m in range(500) if root(m) == root(n)) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def passages_table(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    shared = [" ".join(word() for _ in range(55)) for _ in range(3)]
    short = "all rights reserved by the owner"
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(30, 90))) for _ in range(3)]
        if i % 4 == 0:
            parts.insert(rng.randrange(3), shared[i % 3])
        rows.append((i, f"é {short} " + "\n".join(parts), "s", 7, None, None))
    rows += [(60, None, "s", 1, None, None), (61, "", "s", 1, None, None), (62, "   ", "s", 1, None, None), (None, rows[0][1], None, None, None, None), (63, rows[0][1], "s", 1, None, None)]
    rows += [(64, rows[4][1], "s", 1, None, None), (64, "short", "s", 1, None, None), (64, " ".join(word() for _ in range(40)), "s", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA), shared


def test_repeated_passages(spark):
    docs, shared = passages_table(spark)
    found = passages.without_repeats(docs.repartition(3)).collect()
    got = {r.doc_id if r.doc_id != 64 else (64, r.n_words): r for r in found}
    assert set(docs.columns) - {"n_words"} < set(passages.without_repeats(docs).columns) and len(got) == docs.count()
    for passage in shared:
        holders = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id < 60 and passage in (r.text or ""))
        assert [i for i in holders if passage in got[i].text] == holders[:1]
        assert all(got[i].removed_words >= 20 for i in holders[1:])
    for r in docs.collect():
        after = got[r.doc_id if r.doc_id != 64 else (64, len(r.text.split()))]
        if r.text is None:
            assert after.text is None and (after.n_words, after.n_chunks, after.spans) == (0, 0, [])
            continue
        assert after.n_words == len(r.text.split())
        whole, at = r.text.encode(), 0
        left = b""
        for s in after.spans:
            left, at = left + whole[at : s.start], s.end
        assert (left + whole[at:]).decode() == after.text
        assert after.removed_words == len(r.text.split()) - len(after.text.split())
        if r.doc_id is not None and r.doc_id < 60 and not any(p in r.text for p in shared):
            assert after.text == r.text, "short common phrases stay"
    assert got[63].text == "" or len(got[63].text.split()) < 20
    assert passages.without_repeats(docs.limit(0)).isEmpty()


def test_text_pieced_together_stays(spark):
    """One chunk from each of many texts: every chunk stood somewhere, no 20 words of it did."""
    rng = random.Random(14)
    rows, pieces, seen = [], [], set()
    for i in range(150):
        text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)).encode()
        rows.append((i, text.decode()))
        made = passages.Chunks([text], 24, 32)
        seen |= set(made.digests().tolist())
        cut = made.chunk_word
        pieces += [text.split()[a:b] for a, b in zip(cut[1:-2], cut[2:-1]) if 4 <= b - a <= 9][:1]
    patched = b" ".join(w for p in pieces for w in p)
    made = passages.Chunks([patched], 24, 32)
    run = most = 0
    for d, n in zip(made.digests().tolist(), np.diff(made.chunk_word).tolist()):
        run = run + n if d in seen else 0
        most = max(most, run)
    assert most >= 40
    rows += [(200, patched.decode()), (201, rows[3][1] + " and " + rows[4][1])]
    got = {r.doc_id: r for r in passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == t for i, t in rows[:-1])
    assert got[201].removed_words > 100


def test_stretches_cover_passages():
    """Whatever stands around it, a passage's stretches are the same and cover all its whole chunks."""
    rng = random.Random(15)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(n)).encode()
    for _ in range(20):
        body = text(60)
        chunks = passages.Chunks([text(30) + b" " + body + b" " + text(30), b"", None, b"few words", text(7) + b" " + body], 24, 32)
        start, stop, digest, edge = chunks.stretches(20)
        words = np.diff(chunks.chunk_word)
        assert edge[1] == edge[2] == edge[3] == edge[4] and edge[5] == len(digest)
        assert all(words[a:b].sum() >= 20 and min(words[a + 1 : b].sum(), words[a : b - 1].sum()) < 20 for a, b in zip(start, stop))
        same = np.isin(digest[edge[4] :], digest[: edge[1]])
        whole = np.isin(chunks.digests()[chunks.first_chunk[4] :], chunks.digests()[: chunks.first_chunk[1]])
        cover = np.zeros(len(whole), bool)
        for a, b in zip(start[edge[4] :][same], stop[edge[4] :][same]):
            cover[a - chunks.first_chunk[4] : b - chunks.first_chunk[4]] = True
        assert (cover == whole).all() and words[chunks.first_chunk[4] :][cover].sum() >= 40


def test_rows_that_share_an_id(spark):
    """Each gets the digests that it repeats itself, not those of all rows of the id."""
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    known = [text(60) for _ in range(30)]
    rows = [(i, t, "s", 0, None, None) for i, t in enumerate(known)]
    rows += [(99, f"{text(40)} {t} {text(40)}", "s", 0, None, None) for t in known] + [(99, text(100), "s", 0, None, None)]
    found = [r for r in passages.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect() if r.doc_id == 99]
    assert len(found) == 31
    for r in found:
        assert not any(t in r.text for t in known)
        assert (r.removed_words >= 25) == (r.n_words == 140) and (r.removed_words == 0) == (r.n_words == 100)


def test_repeats_against_all_places(spark):
    """What is cut, and nothing else, stands in one piece of 20 words in an earlier text or place."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    pool = [[word() for _ in range(rng.choice([15, 30, 60, 90]))] for _ in range(12)]
    texts = []
    for _ in range(70):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [word() for _ in range(rng.randrange(5, 60))]
            words += rng.choice(pool)
        texts.append(words)
    rows = [(i, " ".join(w), "s", 0, None, None) for i, w in enumerate(texts)]
    got = {r.doc_id: r for r in passages.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    earlier = set()  # runs of 20 words of all earlier texts
    for i, words in enumerate(texts):
        runs = [tuple(words[k : k + 20]) for k in range(len(words) - 19)]
        seen, covered = set(earlier), [0] * len(words)
        for k, run in enumerate(runs):
            if run in seen:
                covered[k : k + 20] = [1] * 20
            seen.add(run)
        cut = [0] * len(words)
        at, data = 0, " ".join(words).encode()
        for k, w in enumerate(words):
            cut[k] = any(s.start <= at and at + len(w.encode()) <= s.end for s in got[i].spans)
            at += len(w.encode()) + 1
        assert all(c or not x for x, c in zip(cut, covered)), i  # only repeats are cut
        edges = [k for k in range(len(words) + 1) if (k == 0 or not covered[k - 1]) != (k == len(words) or not covered[k])]
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= 50:  # all of a long repeat but its ends
                assert sum(cut[a:b]) >= b - a - 30, (i, a, b)
        earlier |= set(runs)
        assert got[i].removed_words == sum(cut) and data


def test_chunks_resist_shifts():
    rng = random.Random(8)
    body = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(400)).encode()
    plain, moved = (set(passages.Chunks([t], 24, 32).digests().tolist()) for t in (body, b"put in front " + body))
    assert len(plain & moved) >= 0.97 * len(plain)
    whole = passages.Chunks([body, None, b"", b" x ", body], 24, 32)
    d, f = whole.digests(), whole.first_chunk
    assert (d[f[0] : f[1]] == d[f[4] : f[5]]).all() and f[1] == f[2] == f[3] and f[4] == f[3] + 1
    one = passages.Chunks([b"a " * 1000], 24, 32)
    assert np.diff(one.chunk_word).max() <= 32 and one.chunk_word[-1] == 1000


def test_contaminated(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(8, 60)).capitalize() + ". " + text(rng.randrange(1, 9)).capitalize() + ".") for i in range(40)]
    benchmark = spark.createDataFrame(items + [(None, "x y z"), (90, None), (91, "")], "item_id long, text string")
    rows, want = [], set()
    for i in range(120):
        parts = [text(rng.randrange(0, 150)), text(rng.randrange(0, 150))]
        if i % 3 == 0:
            item, t = items[rng.randrange(40)]
            want.add((i, item))
            parts.insert(1, t.upper() if i % 2 else t.replace(".", "!***"))
        elif i % 3 == 1:  # half an item does not count
            parts.insert(1, " ".join(items[0][1].split()[: len(items[0][1].split()) // 2]))
        rows.append((i, " ".join(parts), "s", 1, None, None))
    rows += [(500, None, "s", 1, None, None), (501, "", "s", 1, None, None), (None, items[2][1], "s", 1, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    questions = decontaminate.questions(benchmark)
    for shard_words in (50_000, 100):  # one shard, several
        made = decontaminate.indexes(questions, shard_words=shard_words)
        assert (len(made) > 1) == (shard_words == 100)
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, made).collect()}
        assert got == want | {(None, 2)}
        clean = decontaminate.decontaminated(docs, made)
        assert clean.columns == docs.columns
        assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {i for i, _ in got}
    none = decontaminate.indexes(questions.limit(0))
    assert decontaminate.contaminated(docs, none).isEmpty() and decontaminate.decontaminated(docs, none).count() == len(rows)


def test_passage_scores_are_bm25():
    items = [(1, b"red fox jumps", b"high"), (2, b"red hen sits", b"low"), (3, b"", b""), (4, b"blue", b"")]
    index = decontaminate.Index(items, 0.4, 0.5, 5)
    assert index.ids == [1, 2, 4]
    words = b"the red fox jumps so high".split()
    terms = np.array([index.term.get(w, -1) for w in words])
    found = index.matches(words, terms)
    assert set(found) == {0} and abs(found[0][1] - 1) < 1e-9


@pytest.mark.parametrize("cells", [1 << 22, 1, 40])
def test_every_passage_against_every_item(monkeypatch, cells):
    """All passages scored on all items by the formula, without blocks, bounds or runs of parts."""
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    rng = random.Random(13)
    text = lambda n: [f"w{min(rng.randrange(60), rng.randrange(60))}".encode() for _ in range(n)]
    items = [(i, b" ".join(text(rng.randrange(3, 14))), b" ".join(text(rng.randrange(0, 4)))) for i in range(30)]
    index = decontaminate.Index(items, 0.5, 0.4, 2)
    sizes = [len((q + b" " + a).split()) for _, q, a in items]
    df = Counter(w for _, q, a in items for w in {*q.split(), *a.split()})
    impacts = []
    for (_, q, a), size in zip(items, sizes):
        c = Counter([*q.split(), *a.split()])
        one = {w: math.log(1 + (30 - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / (sum(sizes) / 30))) for w, n in c.items()}
        impacts.append({w: x / sum(one.values()) for w, x in one.items()})
    hits = 0
    for _ in range(40):
        words = text(rng.randrange(0, 200))
        for _ in range(2):
            _, q, a = items[rng.randrange(30)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (q + b" " + a).split()
        want = {}
        for p in range(-(-len(words) // index.step)):
            part = words[p * index.step : (p + 2) * index.step]
            grams = {tuple(part[i : i + n]) for n in (1, 2) for i in range(len(part))}
            for i, (_, q, a) in enumerate(items):
                score = sum(impacts[i].get(w, 0) for w in set(part))
                shares = [
                    sum(g in grams for g in own) / len(own) if own else 1.0
                    for own in (decontaminate._grams(q.split(), 2), decontaminate._grams(a.split(), 2))
                ]
                if score >= 0.5 + 1e-9 and min(shares) >= 0.4:
                    n, best, *most = want.get(i, (0, 0, 0, 0))
                    want[i] = (n + 1, max(best, score), max(most[0], shares[0]), max(most[1], shares[1]))
        got = index.matches(words, np.array([index.term.get(w, -1) for w in words], np.int64))
        assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)
        hits += len(want)
    assert hits >= 80


def test_a_million_words_in_bounded_memory():
    """A text of a million words against 1,600 items takes no more than a text of a tenth."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}".encode() for i in range(3_000)], dtype=object)
    items = [(i, b" ".join(rng.choice(vocabulary, 25)), b" ".join(rng.choice(vocabulary, 3))) for i in range(1_600)]
    index = decontaminate.Index(items, 0.5, 0.8, 5)

    def peak(n):
        words = rng.choice(vocabulary, n).tolist()
        words[n // 2 : n // 2] = items[7][1].split() + items[7][2].split()
        terms = np.array([index.term.get(w, -1) for w in words], np.int64)
        tracemalloc.start()
        found = index.matches(words, terms)
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert set(found) == {7}
        return size

    assert peak(1_000_000) < peak(100_000) + 120 * 1_000_000  # the pairs of part and term themselves


def mixture(spark, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice("aaaaaaaabbc"), 0, None, None) for i in range(400)]
    rows += [(900, None, "empty", 0, None, None), (901, "x", None, 0, None, None), (None, "x y", "a", 0, None, None), rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


def test_mixing_without_budget(spark):
    docs = mixture(spark)
    got = mixing.mix(docs, repeats=2.5, block_tokens=200).collect()
    size = Counter()
    for r in docs.collect():
        size[r.source or ""] += len((r.text or "").split())
    ids = Counter((r.doc_id, r.source) for r in docs.collect())
    times = Counter((r.doc_id, r.source) for r in got)
    assert set(times) == set(ids) and all(ids[k] <= times[k] <= 3 * ids[k] for k in ids)
    share = {s: n / sum(size.values()) for s, n in size.items() if n}
    a = mixing.exponent(spark.createDataFrame(list(size.items()), "source string, tokens long"), repeats=2.5)
    ratio = (min(share.values()) / max(share.values())) ** (a - 1)
    assert 2.49 < ratio <= 2.5001
    given = Counter()
    for r in got:
        given[r.source or ""] += r.n_tokens
    most = max(share.values())
    for s, p in share.items():
        target = size[s] * (p / most) ** (a - 1)
        assert target - 60 <= given[s] <= target + 1, s
    assert all(r.epoch == 0 and r.weight == 0 for r in got if r.source == "empty")


def test_mixing_to_a_budget_and_an_entropy(spark):
    docs = mixture(spark)
    got = mixing.mix(docs, entropy=0.9, budget=3000, block_tokens=100).collect()
    given = Counter()
    weight = {}
    for r in got:
        given[r.source or ""] += r.n_tokens
        weight[r.source or ""] = r.weight
    for s, w in weight.items():
        assert given[s] <= 3000 * w + 1e-6 and (s == "empty" or given[s] > 3000 * w - 60)
    p = np.array([w for w in weight.values() if w])
    assert abs(-(p * np.log(p)).sum() - 0.9 * np.log(len(p))) < 1e-3
    # epochs are whole before the last one, and later epochs have another order
    seen = defaultdict(set)
    for r in got:
        seen[(r.source, r.epoch)].add(r.doc_id)
    for (s, e), ids in seen.items():
        if e:
            assert ids <= seen[(s, e - 1)]
    assert mixing.mix(docs.limit(0), repeats=2.0).isEmpty()


def calls():
    rows = [
        (1, 0, "system", None, None, "be kind", []),
        (1, 1, "call", "a", "add", '{"y": 2, "x": 1}', ["c"]),
        (1, 2, "result", "a", None, "3", []),
        (1, 3, "call", "c", "add", '{"x": "one"}', []),
        (1, 0, "result", "c", None, "before its call", []),
        (1, 5, "call", "a", "add", "{}", []),
        (1, 6, "result", "zz", None, "nobody asked", []),
        (2, 0, "call", "p", "nope", "not json", ["q"]),
        (2, 1, "call", "q", "add", "not json", ["p"]),
        (2, 2, "call", "r", "nope", "{}", []),
        (2, 3, "call", None, "add", '{"x":1,"y":NaN}', None),
        (3, 0, "user", None, None, None, []),
        (None, 0, "call", "a", "add", '{"x":1,"y":2,"é":0}', []),
        (None, None, None, None, None, None, None),
    ]
    return rows


def test_tool_calls(spark):
    schemas = {"add": {"type": "object", "required": ["x", "y"], "additionalProperties": False, "properties": {"x": {"type": "integer"}, "y": {"type": "number"}}}}
    messages = spark.createDataFrame(calls(), "conv_id long, turn long, role string, call_id string, name string, body string, needs array<string>")
    got = chat.formatted(messages.withColumn("link", F.lit("clash")).repartition(3), schemas).collect()
    assert len(got) == len(calls())
    by = {(r.conv_id, r.turn, r.role, r.call_id): r for r in got}
    one = {k[1:]: (r.link, r.level) for k, r in by.items() if k[0] == 1}
    assert one == {
        (0, "system", None): (None, 0), (3, "call", "c"): ("answered", 3), (0, "result", "c"): ("linked", 4),
        (1, "call", "a"): ("answered", 5), (2, "result", "a"): ("linked", 6), (5, "call", "a"): ("repeated", 5), (6, "result", "zz"): ("orphan", 6),
    }
    assert by[(1, 1, "call", "a")].message == '{"role":"assistant","tool_calls":[{"function":{"arguments":{"x":1,"y":2},"name":"add"},"id":"a","type":"function"}]}'
    assert by[(1, 2, "result", "a")].call_turn == 1 and json.loads(by[(1, 2, "result", "a")].message)["tool_call_id"] == "a"
    problems = {k: r.problem for k, r in by.items() if r.problem}
    assert problems == {
        (1, 3, "call", "c"): "$.y: missing; $.x: not of type integer", (1, 5, "call", "a"): "$.x: missing; $.y: missing",
        (2, 0, "call", "p"): "arguments are not JSON", (2, 1, "call", "q"): "arguments are not JSON",
        (2, 2, "call", "r"): "unknown tool", (2, 3, "call", None): "arguments are not JSON", (None, 0, "call", "a"): "$.é: not allowed",
    }
    assert {k[3] for k, r in by.items() if r.cyclic} == {"p", "q"}
    assert by[(None, None, None, None)].message == '{"content":null,"role":null}'
    assert chat.formatted(messages.limit(0), schemas).isEmpty()


def test_turns_become_calls(spark):
    turns = [(7, 0, "user", "hi"), (7, 1, "assistant", "yes"), (7, 2, "user", ""), (8, 0, "system", "s"), (8, 1, "user", "é\"")]
    got = chat.formatted(chat.turns_as_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), chat.REPLY_SCHEMAS).collect()
    found = {(r.conv_id, r.turn): (r.link, r.level, r.problem) for r in got}
    assert found == {
        (7, 0): ("answered", 0, None), (7, 1): ("linked", 1, None), (7, 2): ("unanswered", 2, "$.prompt: too short"),
        (8, 0): (None, 0, None), (8, 1): ("unanswered", 1, None),
    }


def test_schema_checks():
    schema = {"type": ["array", "null"], "items": {"enum": [1, "a", None]}}
    assert chat.violations([1, "a", None], schema) == [] and chat.violations(None, schema) == []
    assert chat.violations([2], schema) == ["$[0]: not in enum"] and chat.violations({}, schema) == ["$: not of type array|null"]
    assert chat.violations(True, {"type": "integer"}) and not chat.violations(3.0, {"type": "integer"})
    assert chat.violations("ab", {"minLength": 3}) and chat.violations(5, {"maximum": 4}) and chat.violations(5, {"minimum": 6})


def test_any_json_is_formatted(spark):
    """Numbers out of range, deep nesting, lone surrogates, and whole numbers with a fraction."""
    deep = "[" * 100_000 + "]" * 100_000
    bodies = ['{"a":1e999}', deep, '{"a":"\\ud800 \\ude00\\ud83d\\ude00"}', '{"b":2.0,"a":-0.0,"c":1e2,"d":0.5}', '"x"', "", "1e400", "[true]"]
    schemas = {"f": {"properties": {"b": {"enum": [2]}}}, "g": {"type": "thing"}}
    rows = [(i, 0, "call", "c", "f", b, []) for i, b in enumerate(bodies)] + [(99, 0, "call", "c", "g", "{}", [])]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, call_id string, name string, body string, needs array<string>")
    got = {r.conv_id: r for r in chat.formatted(messages, schemas).collect()}
    problems = {k: r.problem for k, r in got.items()}
    assert problems == {
        0: "arguments hold a number out of range", 1: "arguments are nested too deeply", 2: None, 3: None, 4: None,
        5: "arguments are not JSON", 6: "arguments hold a number out of range", 7: None, 99: "$: not of type thing",
    }
    sent = {k: json.loads(r.message)["tool_calls"][0]["function"]["arguments"] for k, r in got.items()}
    assert sent[0] == bodies[0] and sent[1] == deep and sent[4] == "x" and sent[7] == [True]
    assert sent[2] == {"a": "\ud800 \ude00\U0001f600"} and "\\ud800" in got[2].message and "\U0001f600" in got[2].message
    assert '"arguments":{"a":0,"b":2,"c":100,"d":0.5}' in got[3].message
    assert chat.violations(True, {"enum": [1]}) and chat.violations([1], {"enum": [[True]]}) and not chat.violations({"a": 1.0}, {"enum": [{"a": 1}]})


def test_many_blocks_of_a_source(spark, monkeypatch):
    """Blocks without number, of which only those under a few digits of their keys are ordered."""
    rows = [(i, "w " * (i % 5 + 1), "big") for i in range(3_000)] + [(i, "w w", "small") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = None
    for digits in (1, 2, 32):
        monkeypatch.setattr(mixing, "KEY_DIGITS", digits)
        got = mixing.mix(docs, entropy=0.9, budget=5_000, block_tokens=2).collect()
        assert len({(r.source, r.block) for r in got}) > 500
        found = sorted((r.source, r.doc_id, r.epoch, r.block_key, r.doc_key) for r in got)
        want = want or found
        assert found == want
    given = Counter()
    for r in got:
        given[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in got}
    assert all(5_000 * w - 10 < given[s] <= 5_000 * w + 1e-6 for s, w in weight.items())
