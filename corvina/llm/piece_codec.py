"""SentencePiece merge-type encoding by backtracking, and decoding."""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import remembered

#: Fixed values of the format: the mark that stands for a space, and what an unknown id decodes to.
SPACE, UNKNOWN = "▁", " ⁇ "
#: Units (and pairs of pieces) that a worker remembers, in each of two generations; longer units are coded anew each time.
CACHE, CACHED_CHARS = 400_000, 48

#: Each byte that isn't part of a character becomes one replacement character, as the library does it.
codecs.register_error("corvina-each", lambda e: ("�", e.start + 1))


class _Memo:
    """A dictionary of two generations: what wasn't asked for while the younger one filled up is forgotten."""

    def __init__(self, most: int = CACHE):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PieceCodec:
    """Encoder and decoder of one model file: a merge-type (BPE) model with byte pieces that leaves texts as they are.

    Encoding. Merging always joins the adjacent symbols that make the best-scored piece, of equals the leftmost. A sequence
    of pieces is its result exactly if merging each two neighbours by themselves gives back these two: merges inside a stretch
    happen in the same order with and without what stands around it, so the first merge over a boundary would happen between
    the two alone as well. So encode() takes the longest piece at each place (an Aho-Corasick automaton finds all of them in
    one pass), shortens it while it doesn't go with the piece before, and steps back where no length does. A place from
    which the rest has failed is marked in a bitfield and never tried again, so the steps stay linear in the text.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        probe = "Ａ  ﬁ \t"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE) or sum(map(sp.is_byte, range(size))) != 256 or any(map(sp.is_unused, range(size))):
            raise ValueError(f"{path}: only models with byte pieces that keep texts as they are")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end_id, self.n_ids = sp.eos_id(), size
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.score = {names[i]: sp.get_score(i) for i in normal}
        # a piece that merging its own characters doesn't give can't be in any result
        self.ids = {names[i]: i for i in normal if self.merged(names[i]) == [names[i]]}
        self.found = ahocorasick.Automaton()
        for piece in self.ids:
            self.found.add_word(piece, piece)
        self.found.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None) for p in self.ids}
        self.pairs, self.units = _Memo(), _Memo()
        inner = {c for p in self.ids if len(p) > 1 for c in p} - {SPACE}
        some = "[" + "".join(re.escape(c) for c in sorted(inner)) + "]"
        crossing = any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:]))
        # no piece goes over these boundaries: before a run of spaces, and around characters that are in no longer piece
        rest = f"[^{SPACE}{some[1:]}"
        self.cut = re.compile(f"(?:{SPACE}|{some})+|{rest}" if crossing else f"{SPACE}+{some}*|{some}+|{rest}")
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.surface = [b""] * size
        for i in range(size):
            if i in self.bytes_of:
                self.surface[i] = bytes([self.bytes_of[i]])
            elif sp.is_unknown(i):
                self.surface[i] = UNKNOWN.encode()
            elif not sp.is_control(i):
                self.surface[i] = names[i].replace(SPACE, " ").encode()
        self.hidden = {i for i in range(size) if sp.is_control(i)}
        self.drops_space = {i for i in normal if names[i].startswith(SPACE)}
        self.decimal = [str(i) for i in range(size)]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def goes_with(self, a: str, b: str) -> bool:
        """Whether merging a + b ends at a and b."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.merged(a + b) == [a, b]
            self.pairs.put((a, b), known)
        return known

    def backtracked(self, text: str) -> list[str]:
        """The pieces of a text of known characters."""
        n = len(text)
        longest: list[str | None] = [None] * (n + 1)
        for last, piece in self.found.iter(text):
            longest[last - len(piece) + 1] = piece  # later matches that begin here are longer
        failed = bytearray((n >> 3) + 1)
        taken: list[str] = []
        at, piece = 0, longest[0]
        while at < n:
            before = taken[-1] if taken else None
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (before is None or self.goes_with(before, piece)):
                    break
                piece = self.shorter[piece]
            if piece is not None:
                taken.append(piece)
                at, piece = end, longest[end]
            elif taken:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(taken.pop())
                piece = self.shorter[before]
            else:
                raise ValueError(f"no pieces for {text[:100]!r}")
        return taken

    def unit(self, text: str) -> bytes:
        """The ids of a unit, as little-endian unsigned 32-bit numbers; an unknown character becomes its bytes' pieces."""
        if len(text) == 1 and text not in self.ids:
            ids = [self.byte_ids[b] for b in text.encode()]
        else:
            ids = [self.ids[p] for p in self.backtracked(text)]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, without an end id; an empty text has none."""
        if not text:
            return np.zeros(0, dtype="<u4")
        units = self.cut.findall(SPACE + text.replace(" ", SPACE))
        memo = self.units
        for u in set(units):
            if u not in memo.young and memo.get(u) is None and len(u) <= CACHED_CHARS:
                memo.put(u, self.unit(u))
        young, old = memo.young, memo.old
        return np.frombuffer(b"".join([young.get(u) or old.get(u) or self.unit(u) for u in units]), dtype="<u4")

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: bytes that make no character become U+FFFD each, and one space of the first piece goes."""
        runs: list[list[int]] = [[]]
        for hidden, run in itertools.groupby(ids, self.hidden.__contains__):
            if not hidden:  # bytes on both sides of a control id make no character together
                runs.append(list(run))
        runs = runs[1:] or runs
        parts = [b"".join(map(self.surface.__getitem__, r)) for r in runs]
        if runs[0] and runs[0][0] in self.drops_space:
            parts[0] = parts[0][1:]
        return "".join([x.decode(errors="corvina-each") for x in parts])


_CODECS: dict[str, PieceCodec] = remembered("piece_codec")


def codec(path: str) -> PieceCodec:
    """The codec of this process: a worker's later tasks find what its earlier ones have learned."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


FOUND = pa.schema([
    ("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
    ("ids", pa.list_(pa.int32())), ("decoded", pa.string()),
])
SCHEMA = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


def coded(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True, with_content: bool = True) -> DataFrame:
    """Each row's whole text as ids of the model at model_path (a file on every worker), and decoded again from them.

    A row depends on itself alone: nothing is shuffled. What a worker remembers is bounded (two generations of CACHE units).
    Edge cases: null and empty texts have no ids but the end id, and decode to an empty text; characters that the model
    doesn't know become byte pieces, and decode to themselves; a U+2581 of the text decodes to a space, as in the library;
    rows that are repeated or have a null id are coded each; an empty table gives no rows; other columns are ignored.
    Returns id_col, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256, and ids and decoded (null
    unless asked for).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for x in batches:
            rows: list[tuple] = []
            for i, text in zip(x.column("id").to_pylist(), x.column("text")):
                ids = c.encode(text.as_py() or "").tolist()
                if end:
                    ids.append(c.end_id)
                decoded = c.decode(ids)
                named = " ".join(map(c.decimal.__getitem__, ids)).encode()
                digests = hashlib.sha256(named).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                rows.append((i, len(ids), *digests, *((ids, decoded) if with_content else (None, None))))
            columns = zip(*rows) if rows else [[]] * len(FOUND)
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(columns, FOUND)], schema=FOUND)

    found = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
    return found.withColumnRenamed("id", id_col)
