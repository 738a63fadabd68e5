"""Piece codec, vector codes and fill-in-middle against the library, brute force and exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest

from corvina.llm import fill_in_middle as fim
from corvina.llm import piece_codec, vector_codes
from corvina.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id long, n long, form string, output string, decoded string, ids string"
PARTS = ["a", "b", "th", "ing", "e", " ", "  ", "\n", "é", "漢", "😀", "▁", ".", "\x00", "ß", "́", "<s>", "<0x0A>", "1", "23", "\t", "\r\n", "<P>", "<S", ">"]


def texts(seed=1, n=120):
    rng = random.Random(seed)
    found = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    found += [None, "", " ", "\n", "\n\n\n", "one", "no end\nof line", "<P>", "a<S>b", "<M>\n", " " * 5000, "x" * 3000, "word " * 5000, "漢字" * 2000]
    return found + found[:3]


def frame(spark, values):
    ids = [None if i % 17 == 5 else i // 2 for i in range(len(values))]  # null ids and repeated ids
    return spark.createDataFrame([(i, t, 1, 2, "f", "o", "d", "x") for i, t in zip(ids, values)], SCHEMA), ids


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_codec_equals_the_library(spark, library):
    values = texts()
    df, ids = frame(spark, values)
    got = sorted(tuple(r) for r in piece_codec.coded(df, MODEL).selectExpr("coalesce(doc_id, -1)", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded").collect())
    want = []
    for i, t in zip(ids, values):
        e = library.encode(t or "", add_eos=True)
        d = library.decode(e)
        want.append((-1 if i is None else i, len(e), sha(" ".join(map(str, e))), sha(d), e, d))
    assert got == sorted(want)
    short = piece_codec.coded(df, MODEL, end=False, with_content=False)
    assert sorted(r["n_tokens"] for r in short.collect()) == sorted(w[1] - 1 for w in want)
    assert all(r["ids"] is None and r["decoded"] is None for r in short.collect())
    assert piece_codec.coded(df.limit(0), MODEL).collect() == []


def test_codec_on_random_texts_and_ids(library):
    c = piece_codec.PieceCodec(MODEL)
    rng = random.Random(7)
    for _ in range(1500):
        t = "".join(rng.choice(PARTS) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(rng.randint(0, 40)))
        assert c.encode(t).tolist() == library.encode(t), t
    for _ in range(1500):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 28705, 259]) for _ in range(rng.randint(0, 12))]
        assert c.decode(ids) == library.decode(ids), ids


def test_backtracking_is_merging():
    c = piece_codec.PieceCodec(MODEL)
    rng = random.Random(3)
    for _ in range(300):
        t = "▁" + "".join(rng.choice("ethinrsaoub") for _ in range(rng.randint(1, 24)))
        assert c.backtracked(t) == c.merged(t)


def test_codec_remembers_boundedly(monkeypatch, library):
    c = piece_codec.PieceCodec(MODEL)
    c.units.most = c.pairs.most = 10
    t = " ".join(f"word{i} thing{i % 7}" for i in range(200))
    assert c.encode(t).tolist() == library.encode(t)
    assert max(len(m.young) + len(m.old) for m in (c.units, c.pairs)) <= 20


def vectors(seed=2, n=150, width=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    rows = [(i * 2, [float(v) for v in x[i]], int(i % 3) if i % 5 else None, "c", 1) for i in range(n)]
    rows += [(3, [float(v) for v in x[9]], 1, "c", 1), (3, [float(v) for v in x[9]], 1, "c", 1)]  # one id, the same vector as another
    rows += [(10**6, [0.0] * width, None, "c", 1), (None, [1.0] * width, 2, "c", 1)]
    dropped = [(7, None, 1, "c", 1), (9, [None] + [1.0] * (width - 1), 1, "c", 1), (11, [math.nan] * width, 1, "c", 1), (13, [math.inf] + [0.0] * (width - 1), 1, "c", 1), (999_999, [1.0], 1, "c", 1), (17, [], 1, "c", 1)]
    return rows, dropped


VECTORS = "vec_id long, embedding array<float>, label int, code string, q int"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = sorted(((i is None, i or 0, [math.floor(scale * v) for v in x]), label) for i, x, label, *_ in rows)
    width = len(kept[0][0][2]) // parts
    cut = [[k[2][p * width : (p + 1) * width] for k, _ in kept] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [near(v, books[p])[1] for v in cut[p]]
            for j in range(len(books[p])):
                mine = [v for v, k in zip(cut[p], at) if k == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[near(cut[p][i], books[p]) for p in range(parts)] for i in range(len(kept))]
    errors, by = [sum(d for d, _ in f) for f in found], {}
    for (_, label), e in zip(kept, errors):
        by[label] = by.get(label, 0) + e
    digest = sha(",".join(str(c) for b in books for e in b for c in e))
    return [(-1 if k[0] else k[1], "".join(f"{j:02x}" for _, j in f), e, by[label], digest) for ((k, label), f, e) in zip(kept, found, errors)]


@pytest.mark.parametrize("n", [1, 40, 150])
def test_vector_codes_equal_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 16)
    rows, dropped = vectors(n=max(n, 10))
    rows = rows[:n] if n < 10 else rows
    df = spark.createDataFrame(rows + dropped, VECTORS).repartition(5)
    got, books = vector_codes.compress(df)
    got_rows = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect())
    assert got_rows == sorted(brute(rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.codebooks_sha256(books) == got_rows[0][4]


def test_vector_codes_of_nothing_and_of_ties(spark):
    rows, dropped = vectors(n=10)
    for nothing in ([], dropped[:4]):
        found, books = vector_codes.compress(spark.createDataFrame(nothing, VECTORS))
        assert found.collect() == [] and books.size == 0
    same = [(i, [0.5] * 16, None, "c", 1) for i in range(5)]  # all entries are equal: ties go to entry 0
    found, _ = vector_codes.compress(spark.createDataFrame(same, VECTORS))
    assert {(r["code"], r["error"], r["label_error"]) for r in found.collect()} == {("00" * 16, 0, 0)}
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 17, 1, "c", 1)], VECTORS))
    far = [(i, [3e38 * (-1) ** i] * 16, i, "c", 1) for i in range(2)]  # held within LARGEST
    assert {r["error"] for r in vector_codes.compress(spark.createDataFrame(far, VECTORS))[0].collect()} == {0}


def test_restored_vectors_are_near(spark):
    rows, _ = vectors(n=150)
    df = spark.createDataFrame(rows, VECTORS)
    codes, books = vector_codes.compress(df)
    back = {r["vec_id"]: np.array(r["vector"]) for r in vector_codes.restored(codes, books).collect()}
    true = {i: np.array(x) for i, x, *_ in rows}
    off = sum(((back[i] - true[i]) ** 2).sum() for i in true)
    assert off < 0.2 * sum((x**2).sum() for x in true.values())


def test_fill_in_middle_equals_its_rule(spark):
    values = texts(seed=5)
    df, ids = frame(spark, values)
    got = sorted(map(tuple, fim.fill_in_middle(df).selectExpr("coalesce(doc_id, -1)", "n", "form", "coalesce(prefix_chars, -1)", "coalesce(middle_chars, -1)", "output", "output_sha256", "restored_sha256").collect()))
    want = []
    for i, t in zip(ids, values):
        t = t or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
            row = ("plain", -1, -1, t)
        elif h[3] % 100 < 50:
            row = ("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
        else:
            row = ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
        want.append((-1 if i is None else i, len(units), *row, sha(row[3]), sha(t)))
    assert got == sorted(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).collect() == []
    few = fim.fill_in_middle(df, rate=0, with_output=False)
    assert {(r["form"], r["output"]) for r in few.collect()} == {("plain", None)}
    assert {r["form"] for r in fim.fill_in_middle(df, spm_rate=0).collect()} == {"plain", "psm"}


def test_restore_finds_the_text_back():
    rng = random.Random(11)
    splitter = fim.Splitter()
    for k in range(2000):
        t = "".join(rng.choice(["<", "P>", "S", ">", "\n", "M", "<<", "é", "\n\n"]) for _ in range(rng.randint(0, 20)))
        _, form, _, _, out = fim.transform(t, fim.draws(7, k), splitter)
        assert fim.restore(out, form) == t
