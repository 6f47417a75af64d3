"""Byte-level BPE encoding and decoding by a rank file.

Corpus-wide counts give the most frequent distinct words; Spark's higher-order functions fold ranked merges over
their bytes, with the ranks as one literal map in hash-addressed buckets. That dictionary holds at most DICTIONARY
words of at most WORD bytes, so what is broadcast doesn't grow with the data. Each task encodes whole texts with
it. A word outside of it is merged by the same ranks on the spot and remembered, up to a bound, in the task.
Decoding concatenates the ids' binary pieces.

Cases: null and empty texts have no ids. Rows without doc_id and repeated rows are encoded like others. A run of
any length without a break is merged in O(n log n). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

#: The words that the folded dictionary holds and the bytes of each, at most, and how often one is met at least.
DICTIONARY, WORD, LEAST = 65536, 24, 4
#: Words that a task remembers beside them.
REMEMBERED = 400_000
#: Buckets of the literal map.
BUCKETS = 1 << 14
NO_RANK = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def java_pattern(pattern: str) -> str:
    r"""The pattern for Java, whose \s knows ASCII only."""
    white = r"\p{IsWhite_Space}"
    return pattern.replace(r"[^\s", "[^" + white).replace(r"\S", r"\P{IsWhite_Space}").replace(r"\s", white)


def rank_of(ranks: dict[bytes, int]):
    """A function from a Column, a piece with a character U+0000 to U+00FF for each byte, to its rank or null."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.decode("latin-1")
        buckets[zlib.crc32(name.encode()) % BUCKETS][name] = rank
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
    return lambda piece: F.try_element_at(F.get(literal, (F.crc32(piece) % BUCKETS).cast("int")), piece)


def let(value, body):
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(word, ranks: dict[bytes, int]):
    """The ids of a word: a fold that in each step merges the first pair of the lowest rank."""
    rank = rank_of(ranks)
    text = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

    def joined(pieces, at):
        return F.concat(F.slice(pieces, F.lit(1), at - 1), F.array(F.concat(F.get(pieces, at - 1), F.get(pieces, at))), F.slice(pieces, at + 2, F.size(pieces)))

    def merge(pieces, _):
        n = F.size(pieces)
        found = F.zip_with(F.slice(pieces, 1, n - 1), F.slice(pieces, 2, n - 1), lambda a, b: F.coalesce(rank(F.concat(a, b)), F.lit(NO_RANK)))
        first = lambda pairs: let(F.array_min(pairs), lambda best: F.when(best < NO_RANK, F.array_position(pairs, best).cast("int")))
        return F.when(n < 2, pieces).otherwise(let(found, lambda pairs: let(first(pairs), lambda at: F.when(at.isNull(), pieces).otherwise(joined(pieces, at)))))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 1))
    return F.transform(F.aggregate(steps, F.split(text, ""), merge), rank)


def dictionary(documents: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(word, ids) of the most frequent distinct words of all texts."""
    words = documents.select(F.explode(F.regexp_extract_all("text", F.lit(java_pattern(pattern)), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.octet_length("word") <= WORD) & (F.col("word") != ""))
    counted = written(counted.filter(F.col("n") >= LEAST).withColumn("level", F.floor(8 * F.log2("n"))), "words")
    levels = counted.groupBy("level").count().orderBy(F.desc("level")).collect()  # at most 8 for each doubling of the count
    sums = list(accumulate(r["count"] for r in levels))
    low = next((r["level"] for r, n in reversed(list(zip(levels, sums))) if n <= DICTIONARY), None)
    top = counted.filter(F.col("level") >= low if low is not None else F.lit(False)).repartition(documents.sparkSession.sparkContext.defaultParallelism)
    return top.select("word", folded(F.col("word"), ranks).alias("ids"))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a run of bytes: always the leftmost of the pairs of the lowest rank is merged next."""
    n = len(piece)
    if n == 1 or piece in ranks:
        return [piece]
    parts: list[bytes | None] = [piece[k : k + 1] for k in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, parts[k] + parts[k + 1]) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, whole = heapq.heappop(heap)
        j = after[k]
        if parts[k] is None or j >= n or len(parts[k]) + len(parts[j]) != len(whole):
            continue
        parts[k], parts[j] = whole, None
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
            if (r := ranks.get(new := whole + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, new))
        if before[k] >= 0 and (r := ranks.get(new := parts[before[k]] + whole)) is not None:
            heapq.heappush(heap, (r, before[k], new))
    return [p for p in parts if p is not None]


class Words(dict):
    """From a word to its ids as little-endian unsigned 32-bit integers; an unknown one is merged and remembered."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int]):
        super().__init__(known)
        self.known, self.ranks = known, ranks

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(self.ranks[p].to_bytes(4, "little") for p in merged(word.encode("utf-8", "surrogatepass"), self.ranks))
        if len(self) > len(self.known) + REMEMBERED:
            self.clear()
            self.update(self.known)
        self[word] = ids
        return ids


SUMMARY = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(documents: DataFrame, path: str, pattern: str, whole: bool = True) -> DataFrame:
    """For (doc_id, text): doc_id, n_tokens, and the SHA-256 of the ids, as little-endian unsigned 32-bit integers,
    and of the bytes that they decode to. whole: also those themselves, ids and decoded."""
    rows = dictionary(documents.select("text"), read_ranks(path), pattern).collect()  # at most DICTIONARY
    known = documents.sparkSession.sparkContext.broadcast({r["word"]: np.array(r["ids"], "<u4").tobytes() for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        words, find = Words(known.value, ranks), regex.compile(pattern).findall
        pieces = [piece for piece, _ in sorted(ranks.items(), key=lambda x: x[1])]
        for batch in batches:
            ids = [b"".join(map(words.__getitem__, find(t))) if t else b"" for t in batch.column(1).to_pylist()]
            decoded = [decode(x, pieces) for x in ids]
            hashed = [pa.array([hashlib.sha256(x).hexdigest() for x in column], pa.string()) for column in (ids, decoded)]
            out = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *hashed]
            more = [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())] if whole else []
            yield pa.RecordBatch.from_arrays(out + more, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out + more)])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), SUMMARY + ", ids binary, decoded binary" * whole)


def decode(ids: bytes, pieces: list[bytes]) -> bytes:
    """The bytes of ids, given the pieces in the order of their ids."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
