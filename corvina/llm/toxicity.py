"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm import isotonic, labelled
from corvina.llm.common import staged

# Common insults of four languages, second-person words of the same languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash garbage disgusting clown fool "
    "imbecile retard bastard bitch asshole jerk ugly filthy vermin shit fuck fucking crap damn hate kill "
    "idiota imbecil estupido basura mierda tonto payaso inutil "
    "connard salaud merde debile ordure minable cretin "
    "dumm idioten trottel arschloch scheisse abschaum widerlich versager"
)
SECOND_PERSON = "you your yours yourself u ur tu te ton ta toi vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus su"
NEAR = 5
MIN_LIFT = 3.0
MIN_SHARE = 0.01
#: Parts of the sample (by the hash of the id) that take turns at being left out.
FOLDS = 5
#: Stems are learned as well as words: the first so many bytes of a word.
STEMS = (4, 5, 6)

_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _PUNCT, bytes(range(97, 123)) + b" " * len(_PUNCT))
_LEET = bytes.maketrans(bytes(range(65, 91)) + b"013457@$!|", bytes(range(97, 123)) + b"oieastasii")
_OBFUSCATED = re.compile(rb"[A-Za-z][@$*!0-9]+(?=[A-Za-z])")
_SHOUTED = re.compile(rb"\b[A-Z]{3,}\b")
_STRETCHED = re.compile(rb"([A-Za-z])\1{3,}")
_EDGES = b"\"#%&'()*+,-./:;<=>?[\\]^_`{}~"
N_FEATURES = 18


class Lexicon:
    """Words with marks (1 listed, 2 learned, 4 second person) and learned stems, looked up by their first four bytes."""

    def __init__(self, learned: list[bytes] = ()):
        self.words = {w: 1 for w in INSULTS.encode().split()} | {w: 4 for w in SECOND_PERSON.encode().split()}
        self.stems: dict[bytes, tuple[bytes, ...]] = {}
        for key in learned:
            if key.endswith(b"*"):
                head = key[: STEMS[0]]
                self.stems[head] = (*self.stems.get(head, ()), key[:-1])
            else:
                self.words[key] = self.words.get(key, 0) | 2

    def mark(self, word: bytes) -> int:
        found = self.stems.get(word[: STEMS[0]])
        return self.words.get(word, 0) | (2 if found and word.startswith(found) else 0)


def features(data: bytes, lexicon: Lexicon) -> list[float]:
    """Dense features of a whole text."""
    tokens = data.translate(_PLAIN).split()
    n, size = max(1, len(tokens)), max(1, len(data))
    known, stems, mark = lexicon.words, lexicon.stems, lexicon.mark
    hits = [(i, m) for i, w in enumerate(tokens) if (w in known or w[:4] in stems) and (m := mark(w))]
    bad = [i for i, m in hits if m & 3]
    you = [i for i, m in hits if m & 4]
    listed = sum(m & 1 for _, m in hits)
    learned = sum(m & 2 for _, m in hits) // 2
    near, closest = 0, 1e6
    if bad and you:
        at = np.searchsorted(you, bad)
        spots = np.array(you)
        gap = np.minimum(
            np.abs(spots[np.minimum(at, len(you) - 1)] - bad), np.abs(np.array(bad) - spots[np.maximum(at - 1, 0)])
        )
        near, closest = int((gap <= NEAR).sum()), float(gap.min())
    marks = _OBFUSCATED.findall(data)
    hidden = 0
    if marks:
        hidden = sum(
            1 for w in data.translate(_LEET).split() if mark(w.strip(_EDGES)) & 3
        ) - sum(1 for w in data.lower().split() if mark(w.strip(_EDGES)) & 3)
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    punct = len(data) - len(data.translate(None, _PUNCT))
    return [
        listed / n,
        math.log1p(listed),
        learned / n,
        math.log1p(learned),
        len({tokens[i] for i in bad}),
        len(you) / n,
        near / n,
        1.0 / (1.0 + closest),
        upper / size,
        len(_SHOUTED.findall(data)) / n,
        data.count(b"!") / n,
        data.count(b"?") / n,
        punct / size,
        len(marks) / n,
        max(0, hidden) / n,
        math.log1p(max(0, hidden)),
        len(_STRETCHED.findall(data)) / n,
        math.log1p(len(tokens)),
    ]


@dataclass
class Boosted:
    """Logistic gradient boosting with histogram splits; trees are complete, of one depth."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.15
    bins: int = 64
    min_rows: int = 3
    penalty: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base = math.log(share / (1 - share))
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        # quantiles of all values and of those above zero: rates are zero for most texts
        self.edges = [
            np.unique(np.concatenate([np.quantile(c, quantiles), np.quantile(c[c > 0], quantiles[::4]) if (c > 0).any() else []]))
            for c in x.T
        ]
        binned = self._bin(x)
        width, n_feat = max(len(e) for e in self.edges) + 1, x.shape[1]
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            split_on, split_at = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, width, dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                gain, where = np.zeros(count), np.full(count, -1)
                for f in range(n_feat):
                    key = node * width + binned[:, f]
                    gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                    hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                    ns = np.bincount(key, minlength=count * width).reshape(count, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    score = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    score[(ns < self.min_rows) | (ns[:, -1:] - ns < self.min_rows)] = 0
                    best = score.argmax(axis=1)
                    top = score[np.arange(count), best]
                    better = top > gain + 1e-12
                    gain[better], where[better] = top[better], f * width + best[better]
                found = where >= 0
                split_on[first : first + count][found] = where[found] // width
                split_at[first : first + count][found] = where[found] % width
                at = first + node
                node = 2 * node + (binned[np.arange(len(y)), split_on[at]] > split_at[at])
            leaves = 2**self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.penalty)
            raw += value[node]
            self.trees.append((split_on, split_at, value))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.trees:
            return out
        binned, rows = self._bin(x), np.arange(len(x))
        for split_on, split_at, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, split_on[node]] > split_at[node])
            out += value[node - (2**self.depth - 1)]
        return out


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x = np.array([features(t or b"", self.lexicon) for t in texts])
        if self.trees is None:
            return np.where(x[:, 1] + x[:, 3] > 0, max(0.9, self.prior), self.prior)
        return isotonic.apply(self.knots, self.trees.raw(x))


def _keys(text: bytes | None) -> set[bytes]:
    words = {w for w in (text or b"").translate(_PLAIN).split() if 2 < len(w) <= 40}
    return words | {w[:k] + b"*" for k in STEMS for w in words if len(w) >= k}


def learned_words(sample: DataFrame, max_learned: int) -> list[list[bytes]]:
    """Words (of 3 to 40 bytes) and stems ("stem*"): for each fold those learned from the other folds, then those from all.

    A word is learned if its share among toxic texts is MIN_SHARE or more (and two texts) and e**MIN_LIFT times that among
    others; of more than max_learned the ones in most toxic texts. Equal texts count once.
    """
    columns = [f"n{k}" for k in range(2 * FOLDS)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, list[int]] = {}
        for x in batches:
            for text, at in zip(x["text"], x["fold"] * 2 + x["label"]):
                for w in _keys(text):
                    seen.setdefault(w, [0] * 2 * FOLDS)[at] += 1
        made = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2 * FOLDS)
        yield pd.DataFrame({"word": list(seen), **{c: made[:, k] for k, c in enumerate(columns)}})

    once = sample.groupBy(F.md5("text").alias("h")).agg(F.min("id").alias("id")).select("id")
    sizes = {(r["fold"], r["label"]): r["n"] for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    counts = sample.join(once, "id").select("text", "fold", "label").mapInPandas(count, "word binary, " + ", ".join(f"{c} long" for c in columns))
    toxic = sum((F.sum(c) for c in columns[3::2]), F.sum(columns[1]))
    counts = staged(counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns), toxic.alias("toxic")).filter("toxic >= 2"), "toxic-words")
    out = []
    for left_out in range(FOLDS + 1):
        used = [k for k in range(FOLDS) if k != left_out]
        n0, n1 = (sum(sizes.get((k, label), 0) for k in used) for label in (0, 1))
        non, tox = (sum((F.col(f"n{2 * k + label}") for k in used), F.lit(0)) for label in (0, 1))
        lift = F.log((tox + 0.5) / (n1 + 1)) - F.log((non + 0.5) / (n0 + 1))
        rows = (
            counts.filter((tox >= max(2.0, MIN_SHARE * n1)) & (lift >= MIN_LIFT))
            .orderBy(tox.desc(), "word")
            .limit(max_learned)
            .select("word")
            .collect()
        )
        out.append([bytes(r["word"]) for r in rows])
    return out


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
    modulus: int = 3, held: int = 1, sample_limit: int = 30_000, max_learned: int = 1000,
) -> Model:
    """Fit on at most sample_limit labelled rows outside the fold crc32(id) mod modulus = held.

    The sample has FOLDS parts by the hash of the id. A row's features use the words learned from the other parts, so trees
    don't trust a word for having been learned from that very row, and growing and scoring see lexicons of nearly one size.
    Raw scores of each part by trees grown on the others are calibrated together, so every row of the sample calibrates; the
    final trees are grown on all rows. A leaf needs min_rows rows at any size of the sample. Without rows of both labels
    nothing can be learned: texts with a listed insult then score 0.9, others the share of toxic labels (0 without labels).
    """
    sample = labelled.sample(docs, labels, id_col, text_col, label, modulus, held, sample_limit)
    sample = staged(sample.withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(FOLDS)).cast("int")), "toxic-sample")
    learned = learned_words(sample, max_learned)
    lexicons = [Lexicon(x) for x in learned]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [features(t or b"", lexicons[k]) for t, k in zip(x["text"], x["fold"])]
            yield pd.DataFrame({"id": x["id"], "fold": x["fold"], "label": x["label"], "x": rows})

    got = sample.mapInPandas(measure, "id long, fold int, label int, x array<double>").toPandas()
    if got["label"].nunique() < 2:
        return Model(lexicons[-1], None, None, float(got["label"].mean()) if len(got) else 0.0)
    got = got.sort_values("id", kind="stable")
    x, y, fold = np.array(got["x"].tolist()), got["label"].to_numpy(float), got["fold"].to_numpy()
    raw = np.empty(len(y))
    for k in np.unique(fold):
        out = fold == k
        raw[out] = Boosted().fit(x[~out], y[~out]).raw(x[out]) if (~out).any() else 0.0
    return Model(lexicons[-1], Boosted().fit(x, y), isotonic.fit(raw, y), float(y.mean()))


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held: int = 1,
    threshold: float = 0.7,
) -> DataFrame:
    """id_col, held_out, score, predicted for each row of docs.

    Edge cases: null and empty texts get the score of a text without words; a null id is in fold null (held_out false);
    repeated rows are each scored; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            s = model.score(x["text"])
            yield pd.DataFrame({"id": x["id"], "held_out": x["held_out"], "score": s, "predicted": (s >= threshold).astype("int32")})

    src = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(labelled.fold(id_col, modulus) == held, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    out = src.mapInPandas(run, "id long, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return docs.filter(toxic(F.col(text_col).cast("string").cast("binary")) < threshold)
