"""Packing token pieces into sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import remembered, staged

#: Words whose ids a worker remembers in each of two generations.
CACHE = 60_000
#: Pieces that one packer takes, on average, in every round.
PACKER_ROWS = 20_000
#: Sequences filled to less than this share are opened again while that saves sequences.
GOOD_FILL = 0.98


class WordTokenizer:
    """ids of texts by a tokenizer whose tokens never cross white space, word by word with a bounded memory.

    The words of a text are looked up (as bytes of little-endian unsigned 32-bit ids); only unseen words reach the
    tokenizer. Words are split at ASCII white space alone, so what else may count as white space stays inside a word and is
    left to the tokenizer. fold: the tokenizer lower-cases and breaks between letters and marks, so an unseen word is first
    looked up in lower case, and as what is before and from its closing marks.
    """

    #: Fixed value: marks that a word may end with.
    MARKS = b".,;:!?|*$%&#"
    #: Words that go to the tokenizer in one text.
    TOGETHER = 1000
    # The normalizers and the splitter for which _plain() holds.
    NORMAL = [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)]
    SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}

    def __init__(self, path: str, fold: bool = True):
        self.fold = fold
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain, self.closes = self._plain()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def batch(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text; the tokenizer is called once for all unseen words of about a megabyte of texts."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > 1_000_000:
                yield from self._few(group)
                group, size = [], 0
        yield from self._few(group)

    def _few(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [t.split() for t in texts]
        young, old = self.young, self.old
        unseen, parts = [], {}
        for w in set().union(*split).difference(young):
            if (v := old.get(w)) is not None:
                young[w] = v
            elif cut := self._parts(w):
                parts[w] = cut
            else:
                unseen.append(w)
        for w in {x for cut in parts.values() for x in cut}.difference(unseen):
            if w not in young:
                if (v := old.get(w)) is not None:
                    young[w] = v
                else:
                    unseen.append(w)
        if self.plain is not None:
            unseen = self._coded_letters(unseen)
        for lo in range(0, len(unseen), 20_000):
            self._coded(unseen[lo : lo + 20_000])
        for w, cut in parts.items():
            young[w] = b"".join([young[x] for x in cut])
        for ws in split:
            yield b"".join(map(young.__getitem__, ws))
        if len(young) > CACHE:
            self.old, self.young = young, {}

    def _coded(self, words: list[bytes]) -> None:
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        for w, e in zip(words, coded):
            self.young[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _coded_letters(self, words: list[bytes]) -> list[bytes]:
        """Codes the words of small Latin letters alone, many in one text, and returns the others."""
        texts = [w.decode() for w in words]
        plain = [t.isalpha() and t == t.lower() and max(t) < "\u0250" for t in texts]
        own = [(w, t) for w, t, p in zip(words, texts, plain) if p]
        for lo in range(0, len(own), self.TOGETHER):
            part = own[lo : lo + self.TOGETHER]
            (coded,) = self.plain.encode_batch_fast([" ".join([t for _, t in part])], add_special_tokens=False)
            ids = np.array(coded.ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(part):
                self._coded([w for w, _ in part])
                continue
            raw = ids.tobytes()
            self.young.update(zip([w for w, _ in part], [raw[a:b] for a, b in zip([0, *ends], ends)]))
        return [w for w, p in zip(words, plain) if not p]

    def _plain(self):
        """The tokenizer without the steps that change nothing in a word of small Latin letters (they are composed and one
        piece to the splitter), and which ids end a word; (None, None) for a tokenizer of other steps."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        spec = json.loads(self.tokenizer.to_str())
        normal, split, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
        kinds = [(n["type"], n.get("pattern")) for n in normal.get("normalizers", [])]
        steps = split.get("pretokenizers", [])
        known = kinds == self.NORMAL and [x["type"] for x in steps] == ["Split", "ByteLevel"] and model.get("end_of_word_suffix") == "</w>"
        if not known or steps[0]["pattern"] != self.SPLIT or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
            return None, None
        if steps[1]["use_regex"] or steps[1]["add_prefix_space"] or model.get("dropout") or spec["post_processor"]:
            return None, None
        plain = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "post_processor": None}))
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        vocabulary = plain.get_vocab()
        closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        return plain, closes

    def _parts(self, word: bytes) -> tuple[bytes, ...]:
        """The lower-case parts of a word that are coded on their own; () if the word is to be coded as it is."""
        if not self.fold or b"<|" in word:  # that may be a special token
            return ()
        low = word.lower()
        core = low.rstrip(self.MARKS)
        if core and core != low and core[-1:].isalnum():
            return core, low[len(core) :]
        return (low,) if low != word else ()


_TOKENIZERS: dict[str, WordTokenizer] = remembered("packing")


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this process: a worker's later tasks find the words of its earlier ones."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


PIECES = pa.schema([
    ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])


def pieces(
    df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most capacity ids of each row's ids and end_id: id, piece, start, length, ids_crc32, ids (or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for x in batches:
            texts = [t or b"" for t in x.column("text").to_pylist()]
            out: list[list] = [[] for _ in PIECES]
            for key, ids in zip(x.column("id").to_pylist(), words.batch(texts)):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    row = (key, k, lo // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, PIECES)], schema=PIECES)

    src = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    return src.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, placed in the order given.

    count[g] is the number of open sequences with gap g. A piece goes to the gap after which the sum of count[g]**2 over
    0 < g < capacity is smallest, ties to the smallest gap; a new sequence is begun only where it fits in no gap. All pieces
    are known and come longest first, so a sequence that is begun early to balance the gaps would only be one more.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made, closed = 0, 1 << 60
    for i, s in enumerate(lengths.tolist()):
        g = capacity
        if s < capacity:
            change = 2 - 2 * count[s:capacity] + 2 * count[: capacity - s]  # gap g -> g - s
            change[0] = 1 - 2 * count[s]  # filled up
            change[count[s:capacity] == 0] = closed
            best = int(change.argmin())
            if change[best] < closed:
                g = s + best
        if g < capacity:
            at = open_[g].pop()
            count[g] -= 1
        else:
            at = made
            made += 1
        sequence[i], offset[i] = at, capacity - g
        if g > s:
            open_[g - s].append(at)
            count[g - s] += 1
    return sequence, offset


def pack(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    with_ids: bool = False,
    packer_rows: int = PACKER_ROWS,
) -> DataFrame:
    """Pack all rows into sequences of at most capacity ids; only longer ones are cut.

    Packers take about packer_rows pieces each, dealt by hash, longest first, by the sum-of-squares rule. The pieces of
    sequences under GOOD_FILL are dealt anew, again about packer_rows to a packer, as long as that makes fewer sequences of
    them; a round that doesn't is thrown away. So the loss is that of one packer and not one for each, and where no better
    filling exists (pieces that are all over half of capacity) it ends after two rounds.

    Edge cases: a null or empty text is one piece of the end id alone; rows that are repeated, and rows with a null id, are
    each packed (pieces are told apart by a row number); an empty table gives no rows; other columns are ignored.
    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.
    """
    coded = pieces(df, id_col, text_col, tokenizer_path, capacity, with_ids=with_ids)
    made = staged(coded.withColumn("row", F.monotonically_increasing_id()), "pieces")
    schema = "id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, fill long"

    def placed(todo: DataFrame, packers: int, level: int) -> DataFrame:
        def run(x: pd.DataFrame) -> pd.DataFrame:
            x = x.sort_values(["length", "id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
            sequence, offset = sum_of_squares(x["length"].to_numpy(), capacity)
            fill = np.bincount(sequence, x["length"].to_numpy()).astype(np.int64)
            number = (level << 56) + (int(x["packer"].iloc[0]) << 32) + sequence
            return x.drop(columns="packer").assign(sequence_id=number, offset=offset, fill=fill[sequence])

        dealt = todo.withColumn("packer", F.pmod(F.xxhash64(F.lit(level), "row"), F.lit(packers)).cast("int"))
        return staged(dealt.groupBy("packer").applyInPandas(run, schema), f"packed{level}")

    def sizes(x: DataFrame) -> tuple[int, int]:
        return tuple(x.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first())

    packers, level = max(1, -(-made.count() // packer_rows)), 0
    packed, done = placed(made.drop("ids"), packers, 0), []
    good = F.col("fill") >= int(GOOD_FILL * capacity)
    while packers > 1:
        n, sequences = sizes(packed.filter(~good))
        packers, level = -(-n // packer_rows), level + 1
        if not n:
            break
        again = placed(packed.filter(~good).drop("sequence_id", "offset", "fill"), packers, level)
        if sizes(again)[1] >= sequences:
            break
        done.append(packed.filter(good))
        packed = again
    out = packed
    for x in done:
        out = out.unionByName(x)
    out = out.drop("fill")
    if with_ids:
        out = out.join(made.select("row", "ids"), "row")
    return out.drop("row").withColumnRenamed("id", id_col)
