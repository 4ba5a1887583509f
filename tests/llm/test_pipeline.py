"""The pipeline over small tables, stage by stage and at once."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    frequent = [word() for _ in range(40)]
    prose = lambda n: " ".join(rng.choice(frequent) if rng.random() < 0.7 else word() for _ in range(n))
    items = [(i, prose(20) + ". " + prose(4) + ".") for i in range(5)]
    shared = prose(70)
    rows = {i: prose(120) for i in range(60)}
    rows[60], rows[61] = rows[3], rows[4] + " one more word"  # copies
    rows[62], rows[63] = prose(60) + " " + shared + " " + prose(60), shared + " " + prose(60)
    rows[64] = prose(50) + " " + items[2][1] + " " + prose(50)  # leak
    rows[65], rows[66], rows[67] = "too short", "again and again and again " * 40, None
    folder = str(tmp_path_factory.mktemp("tables"))
    documents = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in rows.items()]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, shared


def test_stages(spark, tables, tmp_path):
    folder, rows, shared = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "mixture"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns[: len(columns)] == columns
        assert name == "mixture" or docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    clean = set(range(60)) | {62, 63}
    assert set(seen[0]) == set(rows) - {65, 66, 67}
    assert set(seen[1]) == set(seen[0]) - {60, 61}
    assert set(seen[2]) == set(seen[1]) and {i for i in seen[2] if seen[2][i].text != rows[i]} == {63}
    assert shared in seen[2][62].text and shared not in seen[2][63].text
    assert all(r.n_chars == len(r.text) for r in seen[2].values())
    assert set(seen[3]) == set(seen[4]) == clean
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, whole)) == sorted(map(str, docs.collect()))


def test_near_copies_from_four_fifths_go(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    rows, near = [], set()
    for i in range(20):
        words = [word() for _ in range(120)]
        copy = list(words)
        edits = (30, 90) if i % 2 else (20, 60, 100)
        for at in edits:
            copy[at] = word()
        a, b = shingles(words), shingles(copy)
        share = len(a & b) / len(a | b)
        assert 0.80 <= share < 0.85 if i % 2 else 0.75 < share < 0.80
        near |= {100 + i} if i % 2 else set()
        rows += [(i, " ".join(words)), (100 + i, " ".join(copy))]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - near


def test_queries_without_the_subpackage():
    """The entry module still works when the subpackage is gone."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('emberwatch.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') and '_' in n and n[2].isdigit() for n in e.queries())\n"
        "assert 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=100)


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
