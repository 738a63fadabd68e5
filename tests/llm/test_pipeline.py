"""The pipeline against brute force: what each stage keeps of a small corpus with repeated, missing and clashing values."""

from __future__ import annotations

import itertools
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

from tests.llm.test_operators import brute_repeats, similar_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, first boolean, id long"


def made():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(40)
    rows = []
    for i in range(120):
        text = prose(rng.randint(30, 200))
        if i % 6 == 0:
            text += " you idiot, worthless moron"
        elif i % 5 == 0:
            text += " " + passage + " " + prose(5)
        rows.append([i, text])
    rows += [[200, rows[1][1]], [201, rows[1][1] + " end"], [None, rows[2][1]], [None, prose(50)], [3, prose(60)], [3, rows[4][1]], [None, None], [202, ""], [203, " \n"]]
    return [(i, t, ["es", "en", None][k % 3], ["a", "b"][k % 4 == 0], None if t is None else len(t), "r", True, -k) for k, (i, t) in enumerate(rows)]


def representatives(rows):
    """One row of each group of similar texts: the smallest id, null ids last, of equal ones the first."""
    roots, _ = similar_groups([r[1] for r in rows], corpus_pipeline.SIMILARITY, corpus_pipeline.SHINGLE)
    groups = {}
    for i, (r, root) in enumerate(zip(rows, roots)):
        key = (r[0] is None, r[0] or 0, i)
        groups[root] = min(groups.get(root, key), key)
    return sorted(k[2] for k in groups.values())


def key(rows):
    return sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in rows))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = made()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    steps, docs = [], spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        steps.append((docs.columns, [tuple(r) for r in docs.collect()]))
    return path, rows, steps


def test_columns(corpus):
    for columns, _ in corpus[2][:4]:
        assert columns == corpus_pipeline.COLUMNS


def test_toxic_documents_go_and_clean_ones_stay(corpus):
    _, rows, steps = corpus
    assert key(steps[0][1]) == key([r for r in rows if "idiot" not in (r[1] or "")])


def test_one_row_of_each_group_stays(corpus):
    before, after = corpus[2][0][1], corpus[2][1][1]
    assert key(after) == key([before[i] for i in representatives(before)])


def test_repeated_passages_are_cut(corpus):
    before, after = corpus[2][1][1], corpus[2][2][1]
    order = sorted(range(len(before)), key=lambda i: (before[i][0] is None, before[i][0] or 0, i))
    texts = {place: (before[i][1] or "").encode() for place, i in enumerate(order)}
    cut = brute_repeats(texts)
    kept = sorted(len(t) - cut[p][1] for p, t in texts.items() if cut[p][1] == 0 and t.split())
    got = sorted(len(r[1].encode()) for r in after)
    assert all(r[4] == len(r[1]) and r[1].split() for r in after)
    assert sum(cut[p][1] for p in texts) > 100 and set(kept) <= set(got)
    whole = [t for p, t in texts.items() if cut[p][1] == 0 and t.split()]
    assert set(whole) <= {r[1].encode() for r in after} and len(after) <= len(before)
    lost = sum(len(t) for t in texts.values()) - sum(got)
    blank = sum(len(t) for t in texts.values() if not t.split())
    assert sum(c[1] for c in cut.values()) <= lost <= sum(c[1] for c in cut.values()) + blank + 3 * len(before)


def test_mixing_meets_its_expectation(corpus):
    before, after = corpus[2][2][1], corpus[2][3][1]
    assert {(r[0], r[1]) for r in after} <= {(r[0], r[1]) for r in before}
    tokens = lambda rows: sum(len(r[1].split()) for r in rows)
    assert 0.75 < tokens(after) / tokens(before) < 1.05
    for r in {(r[0], r[1]) for r in after}:
        assert sum((x[0], x[1]) == r for x in after) <= 4


def test_packing_holds_every_row(corpus):
    from tokenizers import Tokenizer

    from corvina.llm.queries import tokenizer_path

    coder = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for r in corpus[2][3][1]:
        ids = np.array(coder.encode(r[1], add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(r[0], k, len(ids[lo : lo + 2048]), zlib.crc32(ids[lo : lo + 2048].tobytes())) for k, lo in enumerate(range(0, len(ids), 2048))]
    columns, got = corpus[2][4]
    rows = [dict(zip(columns, r)) for r in got]
    order = lambda x: (x[0] is None, *(v or 0 for v in x))
    assert sorted(((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows), key=order) == sorted(want, key=order)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_run_is_its_stages(spark, corpus):
    columns, got = corpus[2][4]
    again = corpus_pipeline.run(spark, corpus[0])
    pick = lambda rows, names: sorted(str([dict(zip(names, r))[c] for c in ("doc_id", "piece", "length", "ids_crc32")]) for r in rows)
    assert pick([tuple(r) for r in again.collect()], again.columns) == pick(got, columns)


def test_stages_of_an_empty_table(spark, corpus):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus[0])
        assert out.count() == 0, name
