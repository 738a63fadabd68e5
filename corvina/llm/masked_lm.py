"""Masked pseudo-likelihood of texts under a bidirectional window network, trained in numpy over the whole corpus."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvina.llm.common import partitions, staged

OWN = 1 << 13  # the most frequent words, which the network predicts one by one
SHARED = 1 << 13  # all others are predicted by place of so many, and by exact counts within it
INPUTS = 1 << 13  # vectors of neighbours
SIDE = 2  # neighbours on each side
WIDTH, HIDDEN, MIXED = 16, 32, 16
SMOOTH = 1000.0  # tokens' worth of the unigram in each component
ALPHA = 0.5  # added to each word's count within its place
WALK_BYTES = 16 << 20  # text that one walk of a round trains on, on average
WARM_UP = 1000  # documents of the walk that all others start from
PIECE = 1 << 13  # parameters are summed in pieces of so many numbers, FAN at a time
FAN = 64
BATCH = 2048
SLOTS = 18  # bits of a word's hash by which it is looked up


def hashed(data: bytes) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    tokens = data.lower().split()
    return np.fromiter(map(xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens)).view(np.int64)


@dataclass
class Places:
    """Where words are predicted: own holds the most frequent words (sorted), at most n_own, each a place of its own; the
    others share the places from n_own on."""

    own: np.ndarray
    counts: np.ndarray  # tokens of each place
    words: np.ndarray  # different words of each place
    n_own: int

    @property
    def n_shared(self) -> int:
        return len(self.counts) - self.n_own

    def of(self, words: np.ndarray) -> np.ndarray:
        shared = self.n_own + (words & np.int64(self.n_shared - 1))
        if not len(self.own):
            return shared
        slot = words & np.int64((1 << SLOTS) - 1)
        at = self._slots()[slot]
        found = (at >= 0) & (self.own[at] == words)
        out = np.where(found, at, shared)
        crowded = np.flatnonzero(at == -2)  # two words of own lie in this slot
        if len(crowded):
            w = words[crowded]
            at = np.minimum(np.searchsorted(self.own, w), len(self.own) - 1)
            out[crowded] = np.where(self.own[at] == w, at, shared[crowded])
        return out

    def _slots(self) -> np.ndarray:
        """Where in own a word with these lowest bits may be: -1 nowhere, -2 in several places."""
        if "table" not in self.__dict__:
            slot = self.own & np.int64((1 << SLOTS) - 1)
            table = np.full(1 << SLOTS, -1, dtype=np.int32)
            table[slot] = np.arange(len(self.own))
            table[np.flatnonzero(np.bincount(slot, minlength=1 << SLOTS) > 1)] = -2
            self.__dict__["table"] = table
        return self.__dict__["table"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}


@dataclass
class Network:
    """Neighbours -> vectors -> tanh layer -> shares of MIXED components, each with its own distribution over all places.

    P(place | both sides) = sum over components of share(component | both sides) * P(place | component), so every word's
    probability depends on its context and the sum over all places is one. mass[place, component] are expected counts.
    """

    vectors: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    squares: list[np.ndarray]  # sums of squared gradients
    mass: np.ndarray

    @staticmethod
    def fresh(places: Places) -> Network:
        rng, f = np.random.default_rng(5), np.float32
        parts = [
            rng.normal(0, 0.3, (INPUTS, WIDTH)).astype(f),
            rng.normal(0, 1 / math.sqrt(2 * SIDE * WIDTH), (2 * SIDE * WIDTH, HIDDEN)).astype(f),
            np.zeros(HIDDEN, f),
            rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, MIXED)).astype(f),
            np.zeros(MIXED, f),
        ]
        share = places.counts / max(1.0, places.counts.sum())
        mass = (share[:, None] * rng.uniform(0, 2, (len(share), MIXED)) * SMOOTH).astype(f)
        return Network(*parts, [np.zeros_like(p) for p in parts], mass)

    def layers(self) -> list[np.ndarray]:
        return [self.vectors, self.w1, self.b1, self.w2, self.b2]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.layers(), *self.squares, self.mass)])

    def with_values(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for x in (*self.layers(), *self.squares, self.mass):
            out.append(flat[at : at + x.size].astype(np.float32).reshape(x.shape))
            at += x.size
        return Network(*out[:5], out[5:10], out[10])

    def shares(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, hidden, shares of the components) for rows of 2 * SIDE neighbours."""
        x = self.vectors[around].reshape(len(around), -1)
        h = np.tanh(x @ self.w1 + self.b1)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return x, h, z / z.sum(axis=1, keepdims=True)

    def components(self, unigram: np.ndarray) -> np.ndarray:
        """P(place | component), one column each."""
        return (self.mass + SMOOTH * unigram[:, None]) / (self.mass.sum(axis=0) + SMOOTH)

    def log_probs(self, place: np.ndarray, around: np.ndarray, components: np.ndarray) -> np.ndarray:
        return np.log(np.einsum("ij,ij->i", self.shares(around)[2], components[place], dtype=np.float64))

    def walk(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], unigram: np.ndarray, rate: float = 0.1) -> np.ndarray:
        """Train on (places, neighbours) one after the other; returns the expected counts that were gathered on the way."""
        before, floor = self.mass.copy(), SMOOTH * unigram
        totals = self.mass.sum(axis=0) + SMOOTH
        for place, around in batches:
            x, h, share = self.shares(around)
            r = self.mass[place]
            r += floor[place, None]
            r *= share
            r /= totals
            r /= r.sum(axis=1, keepdims=True)
            rows, part = _summed_rows(place, r)
            self.mass[rows] += part
            totals += part.sum(axis=0)
            d = (share - r) / np.float32(len(place))
            dh = (d @ self.w2.T) * (1 - h * h)
            rows, dx = _summed_rows(around.ravel(), (dh @ self.w1.T).reshape(-1, WIDTH))
            steps = ((self.w1, x.T @ dh), (self.b1, dh.sum(axis=0)), (self.w2, h.T @ d), (self.b2, d.sum(axis=0)))
            for k, (p, g) in enumerate(steps):
                self.squares[k + 1] += g * g
                p -= rate * g / (np.sqrt(self.squares[k + 1]) + 1e-6)
            self.squares[0][rows] += dx * dx
            self.vectors[rows] -= rate * dx / (np.sqrt(self.squares[0][rows]) + 1e-6)
        return self.mass - before


def _summed_rows(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different key and the sum of its rows of values."""
    order = np.argsort(keys.astype(np.uint16) if INPUTS + OWN + SHARED <= 1 << 16 else keys, kind="stable")  # short keys sort faster
    k = keys[order]
    cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[cut], np.add.reduceat(values[order], cut, axis=0)


def windows(words: np.ndarray) -> np.ndarray:
    """The inputs of the SIDE neighbours on both sides of each word of a text; beyond its ends is input 0."""
    gap = np.zeros(SIDE, dtype=np.int64)
    inputs = np.concatenate([gap, 1 + (words.view(np.uint64) % np.uint64(INPUTS - 1)).astype(np.int64), gap])
    return np.stack([inputs[SIDE + k : SIDE + k + len(words)] for k in range(-SIDE, SIDE + 1) if k], axis=1)


def _batches(texts: Iterator[bytes], places: Places) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All positions of the texts in their order, BATCH at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for t in texts:
        words = hashed(t)
        held.append((places.of(words), windows(words)))
        n += len(words)
        if n >= 64 * BATCH:
            place, around = (np.concatenate(v) for v in zip(*held))
            whole = n // BATCH * BATCH
            yield from ((place[lo : lo + BATCH], around[lo : lo + BATCH]) for lo in range(0, whole, BATCH))
            held, n = [(place[whole:], around[whole:])], n - whole
    if n:
        place, around = (np.concatenate(v) for v in zip(*held))
        yield from ((place[lo : lo + BATCH], around[lo : lo + BATCH]) for lo in range(0, n, BATCH))


PIECES = pa.schema([("piece", pa.int32()), ("walk", pa.int64()), ("numbers", pa.binary())])
PIECES_SQL = "piece int, walk long, numbers binary"
#: Parameters are summed as whole multiples of this, so that sums don't depend on their order.
GRAIN = 2.0**-20


def _in_pieces(vector: np.ndarray, walk: int) -> pa.RecordBatch:
    whole = np.rint(vector.astype(np.float64) / GRAIN).astype(np.int64)
    parts = [whole[k : k + PIECE].tobytes() for k in range(0, len(whole), PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([walk] * len(parts), pa.int64()), pa.array(parts)], schema=PIECES)


def _summed(df: DataFrame, size: int, walks: int) -> np.ndarray:
    """The sum of the vectors that walks gave in pieces, FAN of them in one group, level by level; the driver gets one vector."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(PIECE, dtype=np.int64)
        for b in t.column("numbers").to_pylist():
            part = np.frombuffer(b, dtype=np.int64)
            total[: len(part)] += part
        return pa.Table.from_arrays([t.column("piece")[:1].combine_chunks(), t.column("walk")[:1].combine_chunks(), pa.array([total.tobytes()])], schema=PIECES)

    while True:
        walks = -(-walks // FAN)
        df = df.withColumn("walk", F.floor(F.col("walk") / FAN)).groupBy("piece", "walk").applyInArrow(add, PIECES_SQL)
        if walks <= 1:
            break
    out = np.zeros(-(-size // PIECE) * PIECE, dtype=np.int64)
    for r in df.collect():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] += np.frombuffer(bytes(r["numbers"]), dtype=np.int64)
    return out[:size] * GRAIN


@dataclass
class Model:
    places: Places
    network: Network
    vocabulary: DataFrame | None  # (word, n): exact counts of all words
    targets: int = 0  # positions that training predicted, over all rounds


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def vocabulary(src: DataFrame, n_own: int, n_shared: int) -> tuple[DataFrame, Places]:
    """The exact count of every word, as a table; and the places, for which the driver gets n_own + n_shared rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for x in itertools.chain(batches, [None]):
            if x is not None:
                held += [hashed(t) for t in x.column("text").to_pylist()]
                size = sum(map(len, held))
            if size and (x is None or size > 3_000_000):
                words, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], names=["word", "n"])
                held, size = [], 0

    table = staged(src.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    top = table.orderBy(F.desc("n"), "word").limit(n_own).collect()
    own = np.array(sorted(r["word"] for r in top), dtype=np.int64)
    counts, words = np.zeros(n_own + n_shared), np.zeros(n_own + n_shared)
    for r in top:
        counts[np.searchsorted(own, r["word"])], words[np.searchsorted(own, r["word"])] = r["n"], 1
    if len(top) == n_own:
        last = top[-1]
        rest = table.filter((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"])))
        place = F.pmod("word", F.lit(n_shared)).cast("int")  # a power of two: as of the unsigned number
        for r in rest.groupBy(place.alias("p")).agg(F.sum("n").alias("n"), F.count("*").alias("w")).collect():
            counts[n_own + r["p"]], words[n_own + r["p"]] = r["n"], r["w"]
    return table, Places(own, counts, words, n_own)


def train(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rounds: int = 1, walk_bytes: int = WALK_BYTES,
    n_own: int = OWN, n_shared: int = SHARED,
) -> Model:
    """Count all words of all rows, then train on every position of every row in each of the rounds.

    Rows are dealt by a hash of id and text into walks of about walk_bytes and sorted by it, so a walk is the same rows in
    the same order however the table is partitioned. In a round every walk starts from the shared parameters; afterwards
    they are averaged, and the expected counts of the components are summed, as whole multiples of GRAIN: the model depends
    on the rows alone. The first start is a walk over the WARM_UP different texts of the least hashes (all texts, if there
    are fewer), which only breaks the symmetry of the components. What walks send grows with the input, and so does the
    table of word counts; the driver gets one vector of fixed length and n_own + n_shared counts (n_shared is a power of two).
    """
    src = _texts(df, id_col, text_col)
    table, places = vocabulary(src, n_own, n_shared)
    unigram = (places.counts / max(1.0, places.counts.sum())).astype(np.float32)
    start = Network.fresh(places)
    size = start.flat().size
    keyed = src.withColumn("h", F.xxhash64("text"))
    total = keyed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if not places.counts.sum():
        return Model(places, start, table)

    def warm_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for x in batches for t in x.column("text").to_pylist()]
        if texts:
            net = start.with_values(start.flat())
            for _ in range(4):
                net.mass = net.walk(_batches(iter(texts), places), unigram)
            yield _in_pieces(net.flat(), 0)

    least = keyed.filter("octet_length(text) > 0").select("h").distinct().orderBy("h").limit(WARM_UP).agg(F.max("h")).first()[0]
    first = keyed.filter(F.col("h") <= least).groupBy("h").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions("h")
    net = start.with_values(_summed(first.mapInArrow(warm_up, PIECES_SQL), size, 1))
    walks, targets = max(1, round(total / walk_bytes)), 0
    dealt = keyed.withColumn("h", F.xxhash64("id", "h")).withColumn("walk", F.pmod("h", F.lit(walks)))
    for _ in range(rounds):
        now = net

        def round_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for walk, texts in _by_walk(batches):
                n, net = [0], now.with_values(now.flat())

                def counted(texts=texts, n=n):
                    for place, around in _batches(texts, places):
                        n[0] += len(place)
                        yield place, around

                net.mass = net.walk(counted(), unigram)
                if n[0]:
                    yield _in_pieces(np.append(net.flat(), [1.0, n[0] / 1024]), walk)

        rows = dealt.repartitionByRange(max(partitions(df.sparkSession), walks), "walk").sortWithinPartitions("walk", "h", "text")
        got = _summed(rows.select("walk", "text").mapInArrow(round_, PIECES_SQL), size + 2, walks)
        flat, n_walks = got[:size], max(1.0, got[size])
        flat[: size - start.mass.size] /= n_walks
        net = start.with_values(flat)
        targets += round(got[size + 1] * 1024)
    return Model(places, net, table, targets)


def _by_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(walk, its texts) of rows that are sorted by walk; each iterator of texts is to be used up before the next one."""
    rows = ((w, t) for x in batches for w, t in zip(x.column("walk").to_pylist(), x.column("text").to_pylist()))
    for walk, part in itertools.groupby(rows, key=lambda r: r[0]):
        yield walk, (t for _, t in part)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, log_prob (sum over all tokens, each given both sides), mean_log_prob, pseudo_perplexity.

    A token's probability is that of its place given both sides, times the word's share of its place: 1 for a word with a
    place of its own, else (n - own + ALPHA) / (all - beside + ALPHA * words), where n and all count the word and the place
    in the corpus, own and beside count them in this document, which is so not judged by its own words. Those counts are
    joined by word; none of these words has more than a part in n_own of all tokens, so no key is hot.

    Edge cases: null and blank texts have 0 tokens, log_prob 0 and null means; repeated rows are each scored; a null id
    stays null; an empty table gives no rows (and an untrained model); other columns are ignored.
    """
    places, network = model.places, model.network
    components = network.components((places.counts / max(1.0, places.counts.sum())).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sizes, base, rare, times = [], [], [], []
            for t in x.column("text").to_pylist():
                words = hashed(t)
                place, around, got = places.of(words), windows(words), 0.0
                for lo in range(0, len(words), 1 << 14):  # one text at a time: the same sums in whatever batch it comes
                    got += float(network.log_probs(place[lo : lo + (1 << 14)], around[lo : lo + (1 << 14)], components).sum())
                some = place >= places.n_own
                w, n = np.unique(words[some], return_counts=True)
                if len(w):
                    at, beside = np.unique(place[some], return_counts=True)
                    rest = np.maximum(places.counts[at] - beside, 0.0) + ALPHA * np.maximum(places.words[at], 1.0)
                    got += float((beside * (math.log(ALPHA) - np.log(rest))).sum())  # as if in no other document; what is, is added below
                sizes.append(len(words))
                base.append(got)
                rare.append(w)
                times.append(n)
            ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([*rare, np.zeros(0, np.int64)])), pa.array(np.concatenate([*times, np.zeros(0, np.int64)]).astype(np.int32))],
                names=["word", "n"],
            )
            columns = [x.column("id"), pa.array(sizes, pa.int64()), pa.array(base, pa.float64()), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "base", "rare"])

    out = _texts(df, id_col, text_col).mapInArrow(run, "id long, n_tokens long, base double, rare array<struct<word:long,n:int>>")
    out = staged(out.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = out.select("row", F.explode("rare").alias("x")).select("row", "x.*")
    known = model.vocabulary if model.vocabulary is not None else df.sparkSession.createDataFrame([], "word long, n long")
    # words that are in other documents too; the side of the counts is built per partition, so the longer one isn't sorted
    joined = rare.join(known.filter("n > 1").withColumnRenamed("n", "in_all").hint("shuffle_hash"), "word").filter("in_all > n")
    share = F.log((F.col("in_all") - F.col("n") + ALPHA) / ALPHA)
    sums = joined.groupBy("row").agg(F.sum(F.col("n") * share).alias("shares"))
    whole = out.join(sums, "row", "left").withColumn("log_prob", F.round(F.col("base") + F.coalesce("shares", F.lit(0.0)), 6))
    mean = F.col("log_prob") / F.nullif("n_tokens", F.lit(0))
    return whole.select(
        F.col("id").alias(id_col), "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(F.least(F.lit(700.0), -mean)).alias("pseudo_perplexity")
    )
