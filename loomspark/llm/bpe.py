"""Operator 12, byte-level BPE encoding and decoding.

A text is split into pre-tokens by a pattern. The distinct pre-tokens of a block of texts are looked up in two
tiers. First a minimal perfect hash over the vocabulary, one probe of flat arrays for all of them at once, finds those
that are tokens as a whole; a stored token is compared, so that no other text passes. The misses are merged byte by
byte: the parts are a linked list, and a heap holds the adjacent pairs that are tokens by (rank, place), so that the
lowest rank merges first, the leftmost of equals, in O(n log n) for a pre-token of any length. A task remembers the
last short ones, MEMO at most. Ids are packed as little-endian unsigned 32-bit integers. Decoding gathers the tokens' bytes by id.

The vocabulary is read on the driver, must have ranks 0 to n - 1 and is broadcast with its hash; MAX_TOKENS bounds it.

Defined cases: null texts count as empty and have no ids; decoding null or no ids gives empty bytes; every
single byte must be a token, so any text can be encoded, and unknown ids are an error; texts of special tokens are
ordinary text; very long texts are split and encoded whole, BLOCK pre-tokens at a time; null ids and repeated rows are
encoded like others; an empty table gives an empty result; other columns are kept, but one that has the name of the
result is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import read

#: Most tokens of a vocabulary, which is broadcast; pre-tokens encoded at once.
MAX_TOKENS, BLOCK = 1_000_000, 250_000
#: Merged pre-tokens that a task remembers at most.
MEMO = 300_000
_PLACE = (1 << 40) - 1
_MIX, _STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_WORD = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0 to n - 1")
    return [found[i] for i in range(len(found))]


def _slot(h, seed, n: int):
    """Slot of a hash under a bucket's seed, for numbers and arrays of 64-bit unsigned integers."""
    x = h ^ seed
    x = x * np.uint64(_MIX)
    return (x ^ (x >> np.uint64(29))) % np.uint64(n)


@dataclass
class Vocabulary:
    """A minimal perfect hash of n tokens: seeds[h % n] leads to the slot of a token, slots[slot] is its rank.

    Negative seeds name the slot itself, for buckets of one token.
    """

    tokens: list[bytes]
    seeds: np.ndarray
    slots: np.ndarray

    @classmethod
    def build(cls, tokens: list[bytes]) -> Vocabulary:
        import xxhash

        n = len(tokens)
        if not n or n > MAX_TOKENS or len(set(tokens)) < n:
            raise ValueError(f"a vocabulary has 1 to {MAX_TOKENS} different tokens")
        hashes = [xxhash.xxh64_intdigest(t) for t in tokens]
        if len(set(hashes)) < n:
            raise ValueError("two tokens share a 64-bit hash")
        buckets: dict[int, list[int]] = {}
        for rank, h in enumerate(hashes):
            buckets.setdefault(h % n, []).append(rank)
        seeds, slots = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        values = np.array(hashes, np.uint64)
        order = sorted(buckets.items(), key=lambda b: -len(b[1]))
        for bucket, ranks in order:
            if len(ranks) == 1:
                break
            own, seed = values[ranks], 0
            while True:
                seed += 1
                at = _slot(own, np.uint64(seed * _STEP & _WORD), n).astype(np.int64)
                if (slots[at] < 0).all() and len(set(at.tolist())) == len(ranks):
                    break
            seeds[bucket], slots[at] = seed, ranks
        free = iter(np.flatnonzero(slots < 0).tolist())
        for bucket, ranks in order:
            if len(ranks) == 1:
                at = next(free)
                seeds[bucket], slots[at] = -1 - at, ranks[0]
        return cls(tokens, seeds, slots)

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """Rank of each token by the ranks of any two tokens that it consists of."""
        rank = {t: i for i, t in enumerate(self.tokens)}
        return {(x, y): r for t, r in rank.items() for k in range(1, len(t)) if (x := rank.get(t[:k])) is not None and (y := rank.get(t[k:])) is not None}

    @cached_property
    def singles(self) -> list[int]:
        """Rank of each byte."""
        found = self.ranks([bytes([b]) for b in range(256)]).tolist()
        if min(found) < 0:
            raise ValueError("every byte must be a token")
        return found

    def bytes_of(self, word: bytes) -> list[int]:
        return [self.singles[b] for b in word]

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Ranks of many tokens, -1 where a word is none."""
        import xxhash

        n = np.uint64(len(self.tokens))
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        seeds = self.seeds[(h % n).astype(np.int64)]
        with np.errstate(over="ignore"):
            at = _slot(h, np.where(seeds < 0, 0, seeds).astype(np.uint64) * np.uint64(_STEP), int(n)).astype(np.int64)
        found = self.slots[np.where(seeds < 0, -1 - seeds, at)]
        same = pa.compute.equal(self.table.take(pa.array(found)), pa.array(words, pa.large_binary()))
        return np.where(same.to_numpy(zero_copy_only=False), found, -1)

    def __post_init__(self) -> None:
        self.table = pa.array(self.tokens, pa.large_binary())

    def __reduce__(self):
        return Vocabulary, (self.tokens, self.seeds, self.slots)


def merged(word: bytes, vocabulary: Vocabulary) -> tuple[int, ...]:
    """Ids of a pre-token: adjacent parts merge while they are a token, the lowest rank first."""
    ids, pair_rank = vocabulary.bytes_of(word), vocabulary.pairs.get
    n = len(ids)
    best = [*map(pair_rank, zip(ids, ids[1:])), None]  # rank of each part with the one after it
    heap = [rank << 40 | i for i, rank in enumerate(best) if rank is not None]
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while heap:
        top = heappop(heap)
        rank, i = top >> 40, top & _PLACE
        if best[i] != rank:  # one of the two was merged meanwhile
            continue
        j = after[i]
        ids[i], ids[j], best[j] = rank, -1, None
        after[i] = k = after[j]
        best[i] = None
        if k < n:
            before[k] = i
            best[i] = up = pair_rank((rank, ids[k]))
            if up is not None:
                heappush(heap, up << 40 | i)
        h = before[i]
        if h >= 0:
            best[h] = up = pair_rank((ids[h], rank))
            if up is not None:
                heappush(heap, up << 40 | h)
    return tuple([x for x in ids if x >= 0])


class Encoder:
    """A vocabulary with the ids of short misses merged last: those since the memory was last full, and those of the time before."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.known, self.older = vocabulary, {}, {}

    def merged(self, word: bytes) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word) or merged(word, self.vocabulary)
            if len(word) <= 64:
                if len(self.known) >= MEMO // 2:
                    self.known, self.older = {}, self.known
                self.known[word] = ids
        return ids

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ids of all pre-tokens, and where each one's end."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        whole = self.vocabulary.ranks(distinct)
        missing = np.flatnonzero(whole < 0)
        lists = [self.merged(distinct[k]) for k in missing.tolist()]
        sizes = np.ones(len(distinct), np.int64)
        sizes[missing] = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.cumsum(sizes) - sizes
        table = np.empty(int(sizes.sum()), np.uint32)
        table[starts[whole >= 0]] = whole[whole >= 0]
        table[_ranges(starts[missing], sizes[missing])] = np.fromiter(chain.from_iterable(lists), np.uint32)
        codes = coded.indices.to_numpy()
        return table[_ranges(starts[codes], sizes[codes])], np.cumsum(sizes[codes])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each start, so many of each, one behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _pieces(text: str, pattern) -> Iterator[list[str]]:
    """The pre-tokens of a text, BLOCK at a time at most."""
    if len(text) <= BLOCK:
        yield pattern.findall(text)
        return
    found = (m[0] for m in pattern.finditer(text))
    while piece := list(islice(found, BLOCK)):
        yield piece


def _blocks(texts: pa.Array, pattern) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
    """Blocks of up to twice BLOCK pre-tokens, each with (row, number) of the rows that they come from, in order."""
    words: list[str] = []
    rows: list[tuple[int, int]] = []
    for row, value in enumerate(texts):
        text = value.as_py()
        for piece in _pieces(text, pattern) if text else ():
            words += piece
            rows.append((row, len(piece)))
            if len(words) >= BLOCK:
                yield words, rows
                words, rows = [], []
    if words:
        yield words, rows


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, c in enumerate(batch.schema.names) if c != name]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], values], [*[batch.schema.names[i] for i in kept], name])


def _schema(df: DataFrame, name: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name], f"`{name}` binary"])


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with column `to`, the packed ids of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.build(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, encoder = regex.compile(pattern), Encoder(shared.value)
        for batch in batches:
            packed: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for words, rows in _blocks(batch.column(text), split):
                ids, ends = encoder.encoded(words)
                at = start = 0
                for row, n in rows:
                    at += n
                    packed[row].append(ids[start : (start := int(ends[at - 1]))].astype("<u4").tobytes())
            yield _with(batch, to, pa.array([b"".join(x) for x in packed], pa.binary()))

    return docs.mapInArrow(run, _schema(docs, to))


def decode(rows: DataFrame, tokens: list[bytes], ids: str = "ids", to: str = "decoded") -> DataFrame:
    """rows with column `to`, the bytes that the packed ids stand for."""
    shared = rows.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.large_binary())

        def whole(packed: pa.Scalar) -> bytes:
            """The tokens taken lie one behind the other in one buffer."""
            taken = table.take(pa.array(np.frombuffer(packed.as_py() or b"", "<u4")))
            size = pa.compute.sum(pa.compute.binary_length(taken)).as_py()
            return taken.buffers()[2].slice(0, size).to_pybytes() if size else b""

        for batch in batches:
            yield _with(batch, to, pa.array([whole(x) for x in batch.column(ids)], pa.binary()))

    return rows.mapInArrow(run, _schema(rows, to))


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    at = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k, F.lit(1))), 16, 10).cast("long")
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum((F.shiftleft(at(i, k + 1), 8 * k) for k in range(4)), F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>"))


def op12_byte_level_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    tokens = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, tokens, public_tokenizers.PATTERN).select("doc_id", "ids")
    out = decode(coded, tokens)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
