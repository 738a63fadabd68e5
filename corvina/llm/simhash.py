"""SimHash: signed-bit votes of weighted term hashes, packed fingerprints, block tables within a Hamming radius."""

from __future__ import annotations

import itertools

import numpy as np
import xxhash

#: Bits of each byte value, highest first; a rule, not data.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def word_starts(data: bytes) -> tuple[bytes, np.ndarray]:
    """The words of data joined by one space each, and where each word starts in that."""
    tokens = data.split()  # on bytes: exactly \x20 and \x09-\x0D
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    starts = np.zeros(len(tokens), dtype=np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    return joined, starts


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of size words, repeats included; shorter texts count as one shingle, blank ones as none."""
    joined, starts = word_starts(data)
    n = len(starts)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.append(starts[size:] - 1, len(joined)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends)), dtype=np.uint64, count=n - size + 1
    )


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes: 0."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def ascii_lower(text: str) -> bytes:
    return text.encode("utf-8").lower()  # bytes.lower() touches A-Z alone


def weighted_votes(hashes: np.ndarray, weights: np.ndarray, owners: np.ndarray, n_owners: int) -> np.ndarray:
    """Signed votes: for each owner and bit, the weight of the hashes with the bit minus the weight of those without.

    hashes is (n, width) bytes. Each byte place is counted as a histogram of byte values and multiplied with their bits.
    """
    width = hashes.shape[1]
    total = np.bincount(owners, weights=weights, minlength=n_owners)
    votes = np.empty((n_owners, 8 * width))
    for place in range(width):
        key = owners * 256 + hashes[:, place]
        seen = np.bincount(key, weights=weights, minlength=256 * n_owners).reshape(n_owners, 256)
        votes[:, 8 * place : 8 * place + 8] = 2 * (seen @ _BITS) - total[:, None]
    return votes


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of packed fingerprints."""
    return np.bitwise_count(np.bitwise_xor(a, b)).sum(axis=1).astype(np.int64)


def likeness(distance, bits: int):
    """Cosine that so many differing bits stand for, at least 0."""
    return np.maximum(0.0, np.cos(np.pi * np.asarray(distance, dtype=float) / bits))


def block_permutations(bits: int, radius: int, blocks: int) -> list[list[int]]:
    """The tables: each leads with blocks - radius whole blocks, so any pair within the radius agrees on one table's lead."""
    if not radius < blocks <= bits:
        raise ValueError("blocks must be over radius and at most bits")
    edges = [bits * k // blocks for k in range(blocks + 1)]
    tables = []
    for lead in itertools.combinations(range(blocks), blocks - radius):
        tables.append([b for k in lead for b in range(edges[k], edges[k + 1])])
    return tables
