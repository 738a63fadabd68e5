"""Fill-in-middle: each text is cut at two line ends into prefix, middle and suffix, and written in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the marks before prefix, suffix and middle, and what counts as a line.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINE = r"[^\n]*\n|[^\n]+"


class Splitter:
    """Code-point offsets of a text's units, by a pre-tokenizer that isolates each match of a pattern; nothing is trained."""

    def __init__(self, pattern: str = LINE):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(pattern), behavior="isolated")

    def ends(self, text: str) -> list[int]:
        """0 and where each unit ends, so unit k is text[ends[k]:ends[k + 1]] and there are len(ends) - 1 of them."""
        return [0, *(end for _, (_, end) in self.split.pre_tokenize_str(text))] if text else [0]


def draws(seed: int, row_id) -> list[int]:
    """The four unsigned numbers of a row: the first 8-digit groups of the hex sha256 of seed:id."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in (0, 8, 16, 24)]


def transform(text: str, h: list[int], splitter: Splitter, rate: int = 100, spm_rate: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of one text with its draws."""
    ends = splitter.ends(text)
    n = len(ends) - 1
    if not text or h[2] % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((ends[h[0] % (n + 1)], ends[h[1] % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that transform() was given, from its output and form alone: no part of it holds a mark."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at, end = output.index(second), output.index(MIDDLE)
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


FOUND = pa.schema([
    ("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output", pa.string()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
])
SCHEMA = "id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, with_output: bool = True
) -> DataFrame:
    """Each row's text in fill-in-middle form: rate % of the texts, spm_rate % of those with the suffix first.

    A row depends on its own id and text alone, so nothing is shuffled and a task that runs again gives the same rows.
    Edge cases: a null text is the empty one; empty texts, and texts that hold a mark already, stay plain (n is counted all
    the same); a null id draws as if it had no digits; rows that are repeated come out equal; an empty table gives no rows;
    other columns are ignored. Returns id_col, n (units), form, prefix_chars, middle_chars (null if plain), output (null
    unless asked for), output_sha256 and restored_sha256, the digest of the text rebuilt from output and form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for x in batches:
            rows: list[tuple] = []
            for i, text in zip(x.column("id").to_pylist(), x.column("text")):
                n, form, a, m, output = transform(text.as_py() or "", draws(seed, i), splitter, rate, spm_rate)
                digests = (hashlib.sha256(t.encode()).hexdigest() for t in (output, restore(output, form)))
                rows.append((i, n, form, a, m, output if with_output else None, *digests))
            columns = zip(*rows) if rows else [[]] * len(FOUND)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)

    found = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
    return found.withColumnRenamed("id", id_col)
