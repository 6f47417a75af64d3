"""Exact dedup by a minimal perfect hash over historical distinct digests.

History's distinct digests are dealt to buckets of bounded size by digest. Each bucket builds a minimal perfect
hash (levels of bit arrays: what collides on one level goes on to the next) whose slots hold the full digest, the
winner's doc_id and the copies counted. A later digest asks the hash for its slot and compares all 32 bytes there:
equal bytes are a repeat of the slot's winner; other digests are no members and group among themselves.

Cases: null text counts as empty, so all null and empty texts are one group. A row without doc_id counts in its
group's size and is kept only if no row of the group has one (keep_id is then null). Repeated rows with the
winning doc_id are all kept, as one document. An empty table gives no rows. Columns beside the two named are
ignored here; ``keep_first`` leaves them as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, written

#: Digests that a bucket holds on average.
BUCKET = 32768
#: Bits of a level for each digest that reaches it, and levels before the rest is held in order.
GAMMA, LEVELS = 2, 24


class PerfectHash:
    """A minimal perfect hash: n distinct digests, as an (n, 4) array of uint64, to slots 0 .. n - 1."""

    def __init__(self, digests: np.ndarray):
        keys = digests[:, 0] ^ mix(digests[:, 1])
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        rest, self.taken = np.arange(len(keys)), 0
        while len(rest) and len(self.bits) < LEVELS:
            at = self._at(keys[rest], len(self.bits), GAMMA * len(rest))
            alone = np.bincount(at, minlength=GAMMA * len(rest)) == 1
            self.bits.append(alone)
            self.before.append(self.taken + np.cumsum(alone) - alone)
            self.taken += int(alone.sum())
            rest = rest[~alone[at]]
        self.rest = {row.tobytes(): self.taken + k for k, row in enumerate(digests[rest])}

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys, level) % U64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for each digest. One that is no member may get any slot, or -1."""
        keys, out = digests[:, 0] ^ mix(digests[:, 1]), np.full(len(digests), -1)
        todo = np.arange(len(digests))
        for level, (bits, before) in enumerate(zip(self.bits, self.before)):
            at = self._at(keys[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = before[at[hit]]
            todo = todo[~hit]
        for k in todo if self.rest else ():
            out[k] = self.rest.get(digests[k].tobytes(), -1)
        return out


def _wide(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), np.uint64).reshape(-1, 4)


def _meet(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Each distinct digest of a bucket once, with its winner and its copies in history and after."""
    new = new.rename(columns=lambda c: c.removeprefix("new_"))
    held, asked = _wide(old["digest"]), _wide(new["digest"])
    index = PerfectHash(held)
    order = np.argsort(index.slots(held))
    slots = old.iloc[order].reset_index(drop=True)
    found = index.slots(asked)
    member = found >= 0
    member[member] = (held[order][found[member]] == asked[member]).all(axis=1)
    slots.loc[found[member], "size"] += new["size"].to_numpy()[member]
    return pd.concat([slots, new[~member]])[["digest", "keep_id", "size"]].astype({"keep_id": "Int64"})


def groups(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, size) for the distinct digests of (doc_id, digest). History is the half with smaller doc_id."""
    n, low, high = digests.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    split = low + (high - low) // 2 if low is not None else 0
    buckets = max(16, n // BUCKET)
    counted = lambda rows: rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size")).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    old = counted(digests.filter(F.col("doc_id") <= split))
    new = counted(digests.filter(F.coalesce(F.col("doc_id") > split, F.lit(True))))
    new = new.select(*[F.col(c).alias(f"new_{c}") for c in new.columns])  # own attributes: the two sides share a table
    return old.groupBy("bucket").cogroup(new.groupBy("new_bucket")).applyInPandas(_meet, "digest binary, keep_id long, size long")


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(documents: DataFrame, text: str = "text") -> DataFrame:
    """For each row of (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 of the text with white space made one space."""
    digests = written(documents.select("doc_id", F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest")), "digests")
    won = groups(digests)
    return digests.join(won, "digest").select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows of documents that exact_dedup keeps, with all their columns; of repeated rows with one doc_id, each."""
    kept = exact_dedup(documents, text).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return documents.join(kept, documents["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
