"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm import isotonic, labelled
from corvina.llm.common import staged

_SYMBOLS = b"#*$%&<>"
_PUNCT = b"!\"'(),-./:;?[]{}_"
N_STATS = 20
#: Parts of the sample (by the hash of the id) that take turns at being left out.
FOLDS = 3


def statistics(data: bytes) -> list[float]:
    """Statistics of a whole text, as rates or logarithms."""
    tokens = data.split()
    n, size = len(tokens), max(1, len(data))
    m = max(1, n)
    counts = Counter(tokens)
    common = counts.most_common(2)
    histogram = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) if data else np.zeros(256)
    p = histogram[histogram > 0] / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    windows = len(set(zip(tokens, tokens[1:], tokens[2:])))
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:]))
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b",", b";", b":") for x in lines)
    return [
        math.log1p(n),
        math.log1p(size / m),
        len(counts) / m,
        (common[0][1] / m) if common else 0.0,
        (common[1][1] / m) if len(common) > 1 else 0.0,
        repeats / m,
        1 - windows / max(1, n - 2) if n > 2 else 0.0,
        len(set(lines)) / k,
        math.log1p(n / k),
        ended / k,
        float(sum(histogram[c] for c in _SYMBOLS)) / m,
        float(histogram[ord("|")]) / m,
        float(sum(histogram[c] for c in _PUNCT)) / m,
        float(histogram[48:58].sum()) / size,
        float(histogram[65:91].sum()) / m,
        float(histogram[97:123].sum()) / size,
        float(histogram[128:].sum()) / size,
        float(-(p * np.log2(p)).sum()) if data else 0.0,
        sum(len(w) <= 2 for w in counts) / max(1, len(counts)),
        sum(len(w) > 20 for w in tokens) / m,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of the standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = math.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.concatenate([waves, z, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return isotonic.apply(self.knots, self.lift(x) @ self.weights)


def _stats_rows(texts) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts]).reshape(-1, N_STATS)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
    modulus: int = 4, held: int = 2, sample_limit: int = 40_000, waves: int = 256, gamma: float = 0.05, ridge: float = 1.0,
) -> Model:
    """Fit on at most sample_limit labelled rows outside the fold crc32(id) mod modulus = held.

    Means and spreads, then the normal equations of each of FOLDS parts of the sample (by the hash of the id), are summed in
    at most 4 partitions; only these sums reach the driver. The equations of all parts but one give the weights that score
    that part, and these scores of the whole sample are calibrated together; the final weights solve the sum of all parts.
    Rows of one label alone, or none: every score is the share of label 1 (0.5 without labels).
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fold = (pd.util.hash_array(b["id"].to_numpy()) % FOLDS).astype("int32")
            yield pd.DataFrame({"label": b["label"], "fold": fold, "x": [statistics(t or b"") for t in b["text"]]})

    sample = labelled.sample(docs, labels, id_col, text_col, label, modulus, held, sample_limit)
    rows = staged(sample.mapInPandas(measure, "label int, fold int, x array<double>"), "quality-sample").coalesce(4)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, ones, s, q = 0, 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for b in batches:
            x = np.array(b["x"].tolist()).reshape(-1, N_STATS)
            n, ones, s, q = n + len(x), ones + int(b["label"].sum()), s + x.sum(axis=0), q + (x**2).sum(axis=0)
        yield pd.DataFrame({"n": [n], "ones": [ones], "s": [s], "q": [q]})

    got = rows.mapInPandas(moments, "n long, ones long, s array<double>, q array<double>").collect()
    n, ones = sum(r["n"] for r in got), sum(r["ones"] for r in got)
    total = max(1, n)
    mean = np.sum([r["s"] for r in got], axis=0) / total if got else np.zeros(N_STATS)
    square = np.sum([r["q"] for r in got], axis=0) / total if got else np.ones(N_STATS)
    scale = np.sqrt(np.maximum(square - mean**2, 1e-12))
    scale[scale < 1e-6] = 1.0
    rng = np.random.default_rng(7)
    frequencies = rng.normal(0, math.sqrt(2 * gamma), (N_STATS, waves))
    model = Model(mean, scale, frequencies, rng.uniform(0, 2 * math.pi, waves), None, None, ones / n if n else 0.5)
    if not 0 < ones < n:
        return model
    width = waves + N_STATS + 1
    upper = np.triu_indices(width)  # the equations are symmetric

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, c = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width))
        for b in batches:
            z, y, fold = model.lift(np.array(b["x"].tolist()).reshape(-1, N_STATS)), b["label"].to_numpy(float), b["fold"].to_numpy()
            for k in range(FOLDS):
                a[k] += z[fold == k].T @ z[fold == k]
                c[k] += z[fold == k].T @ y[fold == k]
        yield pd.DataFrame({"fold": range(FOLDS), "a": [x[upper].tobytes() for x in a], "c": [x.tobytes() for x in c]})

    a, c = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width))
    for r in rows.mapInPandas(normal, "fold int, a binary, c binary").collect():
        a[r["fold"]][upper] += np.frombuffer(bytes(r["a"]))
        c[r["fold"]] += np.frombuffer(bytes(r["c"]))
    a += np.triu(a, 1).transpose(0, 2, 1)
    solve = lambda parts: np.linalg.solve(a[parts].sum(axis=0) + ridge * np.eye(width), c[parts].sum(axis=0))
    without = np.stack([solve([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)])
    model.weights = solve(list(range(FOLDS)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = model.lift(np.array(b["x"].tolist()).reshape(-1, N_STATS))
            yield pd.DataFrame({"raw": (z * without[b["fold"].to_numpy()]).sum(axis=1), "label": b["label"].to_numpy(float)})

    left_out = rows.mapInPandas(judge, "raw double, label double").toPandas()
    model.knots = isotonic.fit(left_out["raw"].to_numpy(), left_out["label"].to_numpy())
    return model


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held: int = 2,
    threshold: float = 0.7,
) -> DataFrame:
    """id_col, held_out, score, predicted for each row of docs.

    Edge cases: null and empty texts get the score of a text without words; a null id has held_out false; repeated rows are
    each scored; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(_stats_rows(b["text"]))
            yield pd.DataFrame({"id": b["id"], "held_out": b["held_out"], "score": s, "predicted": (s >= threshold).astype("int32")})

    src = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(labelled.fold(id_col, modulus) == held, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    out = src.mapInPandas(run, "id long, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
