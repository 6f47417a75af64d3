"""Exact substring dedup by a logarithmic family of suffix arrays.

A string of LENGTH bytes that starts in two places has in both the same anchors: grams of GRAM bytes that are the
smallest by hash among all grams of some LENGTH bytes. Equal texts, known by 128 bits, repeat each other whole; one of
them stands for all against the rest. Only suffixes at anchors whose gram occurs twice or more are indexed, each with
the bytes around it that a match can touch. They are dealt to tasks by gram.

A task takes its suffixes in batches. Each batch gets a suffix array, by the bytes from the gram on, and one of the
reversed text, by the bytes before it; a search finds its place in each level that stands, where it is scanned
against its neighbours, and it then merges with levels of equal size, so that a suffix is merged a logarithmic number
of times. In a scan, neighbours of one gram tell how far a suffix matches to either side: together LENGTH bytes or more are a repeat. As the scans meet every
neighbour in the final order, the longest matches to each side are exact. Where no one neighbour gives both, all
strings of LENGTH bytes around the gram are compared for that gram, by hash and then byte by byte.

Two windows around one gram that are repeated cover all bytes between them, so the first and the last one are
enough. A long run of one period repeats itself; three of its anchors stand for all.

Cases: null and empty texts have no bytes and nothing to remove. Repeated rows are copies of each other, so all of
their bytes go if they are long enough. Rows without doc_id take part like others. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, gram_hashes
from .common import portions, tidy, written

LENGTH, GRAM = 400, 100
#: Bytes that a match can reach before a gram, and from its start.
LEFT, RIGHT = LENGTH - GRAM, LENGTH
#: Suffixes of a batch; of a task, about.
BATCH, TASK = 4096, 16000
#: Suffixes of grams that are compared at once where neighbours don't settle them, and hashes of windows held for it.
TOGETHER, HELD = 4096, 2_000_000


def flat_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64)


def thinned(at: np.ndarray, keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors to keep, and the (first anchor's index, last's) of long runs of one period, of which three stay."""
    keep = np.ones(len(at), bool)
    if len(at) < 8:
        return keep, []
    step = np.diff(at)
    same = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1]) & (step <= GRAM)
    joined = same[1:] & same[:-1] & (step[1:] == step[:-1])  # three anchors in a row
    edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
    runs = []
    for first, last in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1):
        if at[last] - at[first] >= LEFT + RIGHT + 4 * GRAM:
            keep[first + 1 : last] = False
            keep[first + int(np.searchsorted(at[first : last + 1], at[first] + LEFT + GRAM))] = True
            runs.append((int(first), int(last)))
    return keep, runs


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, twin, doc_id, n_bytes, ats, keys, runs) for (row, twin, doc_id, text)."""
    for batch in batches:
        texts = batch.column(3).to_pylist()
        for where in portions(texts):
            flat, ends = flat_of(texts[where])
            at, keys = anchors(flat, ends, LENGTH, GRAM)
            owner = np.searchsorted(ends, at, side="right")
            keep, runs = thinned(at, keys, owner)
            begins = np.concatenate([[0], ends[:-1]])
            found: list[list] = [[] for _ in ends]
            for first, last in runs:
                k = owner[first]
                found[k].append({"start": int(at[first] - begins[k]), "end": int(at[last] + GRAM - begins[k])})
            at, keys, owner = at[keep], keys[keep], owner[keep]
            bounds = pa.array(np.searchsorted(owner, np.arange(len(ends) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k).slice(where.start, where.stop - where.start) for k in range(3)],
                    pa.array(ends - begins, pa.int64()),
                    pa.ListArray.from_arrays(bounds, pa.array((at - begins[owner]).astype(np.int32))),
                    pa.ListArray.from_arrays(bounds, pa.array(keys.astype(np.int64))),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["row", "twin", "doc_id", "n_bytes", "ats", "keys", "runs"],
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row, twin, at, before, context) for (row, twin, text, ats, keys): a suffix with the bytes that its matches can touch."""
    for batch in batches:
        rows, twins, texts, places, keys = (batch.column(k).to_pylist() for k in range(5))
        for where in portions(texts):
            out: list[tuple] = []
            for row, twin, text, own, named in zip(rows[where], twins[where], texts[where], places[where], keys[where]):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(key, row, twin, at, min(at, LEFT), raw[max(0, at - LEFT) : at + RIGHT]) for at, key in zip(own, named)]
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "row", "twin", "at", "before", "context"])


class Family:
    """Suffixes of a growing set of batches in levels that double, and what of each is known to be repeated."""

    def __init__(self) -> None:
        self.keys, self.bytes = np.zeros(0, np.uint64), np.zeros((0, LEFT + RIGHT), np.uint8)
        self.before, self.after = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The longest match to either side with a suffix of the same gram; the outermost repeated windows' starts before the gram.
        self.left, self.right = np.full(0, -1), np.full(0, -1)
        self.most, self.least = np.full(0, -1), np.full(0, LENGTH)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def _named(self, rows: np.ndarray, backward: bool) -> np.ndarray:
        """What the suffixes are in order by: the gram, then the bytes from it on, or those before it from the nearest on."""
        own = self.bytes[rows]
        parts = [own[:, LEFT:], own[:, LEFT - 1 :: -1]]
        name = np.concatenate([self.keys[rows].astype(">u8").view(np.uint8).reshape(-1, 8), *(parts[::-1] if backward else parts)], axis=1)
        return np.ascontiguousarray(name).view(f"S{name.shape[1]}").ravel()

    def _scan(self, order: np.ndarray, since: int) -> None:
        """Notes how far each two neighbours of one gram match, of which one has the number ``since`` or a later one."""
        first = np.flatnonzero((np.maximum(order[1:], order[:-1]) >= since) & (self.keys[order[1:]] == self.keys[order[:-1]]))
        for k in range(0, len(first), TOGETHER):
            part = first[k : k + TOGETHER]
            a, b = order[part], order[part + 1]
            differ = self.bytes[a] != self.bytes[b]
            ahead, behind = differ[:, LEFT:], differ[:, LEFT - 1 :: -1]
            right = np.where(ahead.any(axis=1), ahead.argmax(axis=1), RIGHT)
            left = np.where(behind.any(axis=1), behind.argmax(axis=1), LEFT)
            right = np.minimum(right, np.minimum(self.after[a], self.after[b]))
            left = np.minimum(left, np.minimum(self.before[a], self.before[b]))
            long = left + right >= LENGTH
            for x in (a, b):
                np.maximum.at(self.left, x, left)
                np.maximum.at(self.right, x, right)
                np.maximum.at(self.most, x[long], left[long])
                np.minimum.at(self.least, x[long], LENGTH - right[long])

    def add(self, keys: np.ndarray, bytes_: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        n, m = len(self.keys), len(keys)
        self.keys, self.bytes = np.concatenate([self.keys, keys]), np.concatenate([self.bytes, bytes_])
        self.before, self.after = np.concatenate([self.before, before]), np.concatenate([self.after, after])
        for name, fill in (("left", -1), ("right", -1), ("most", -1), ("least", LENGTH)):
            setattr(self, name, np.concatenate([getattr(self, name), np.full(m, fill)]))
        own = []
        for backward in (False, True):
            rows = np.arange(n, n + m)
            own.append(rows[np.argsort(self._named(rows, backward), kind="stable")])
            self._scan(own[-1], n)
        new = tuple(own)
        for level in reversed(self.levels):  # merge-scan against what stands
            for side in (0, 1):
                self._scan(self._merged(level[side], new[side], bool(side)), n)
        while self.levels and len(self.levels[-1][0]) <= len(new[0]):
            level = self.levels.pop()
            new = tuple(self._merged(level[side], new[side], bool(side)) for side in (0, 1))
        self.levels.append(new)

    def _merged(self, a: np.ndarray, b: np.ndarray, backward: bool) -> np.ndarray:
        """Two runs in order as one, by a search in the longer one for each of the other."""
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        return np.insert(a, np.searchsorted(self._named(a, backward), self._named(b, backward), side="right"), b)

    def settle(self) -> None:
        """Compares all windows of the grams where neighbours leave open which are the outermost that repeat."""
        most, least = np.minimum(self.left, LEFT), np.maximum(LENGTH - self.right, 0)
        open_ = (self.left >= 0) & (most >= least) & ((self.most < most) | (self.least > least))
        rows = np.flatnonzero(np.isin(self.keys, np.unique(self.keys[open_])))
        rows = rows[np.argsort(self.keys[rows], kind="stable")]
        edges = np.flatnonzero(np.diff(self.keys[rows])) + 1
        begin = 0
        for end in [*edges, len(rows)]:
            if end - begin >= TOGETHER or end == len(rows):
                if end > begin:
                    self._compare(rows[begin:end], int(least[rows[begin:end]].min()), int(most[rows[begin:end]].max()))
                begin = end

    def _windows(self, rows: np.ndarray, low: int, high: int) -> np.ndarray:
        """Hashes of the windows that start low to high bytes before each row's gram, in that order."""
        out = np.empty((len(rows), high - low + 1), np.uint64)
        for k in range(0, len(rows), 256):
            part = self.bytes[rows[k : k + 256]]
            own = np.zeros(part.size, np.uint64)
            hashes = gram_hashes(part.ravel(), LENGTH)
            own[: len(hashes)] = hashes
            out[k : k + 256] = own.reshape(len(part), -1)[:, LEFT - high : LEFT - low + 1][:, ::-1]
        return out

    def _compare(self, rows: np.ndarray, low: int, high: int) -> None:
        low, step = max(low, 0), max(1, HELD // len(rows))
        for first in range(low, high + 1, step):
            hashes = self._windows(rows, first, min(high, first + step - 1))
            for at, column in enumerate(hashes.T, first):
                own = np.flatnonzero((self.before[rows] >= at) & (self.after[rows] >= LENGTH - at))
                if len(own) < 2:
                    continue
                order = np.lexsort((column[own], self.keys[rows[own]]))
                h, k = column[own][order], self.keys[rows[own]][order]
                one = rows[own[order]]
                new = lambda x: (self.most[x] < at) | (self.least[x] > at)
                twin = np.flatnonzero((h[1:] == h[:-1]) & (k[1:] == k[:-1]) & (new(one[1:]) | new(one[:-1])))
                window = slice(LEFT - at, LEFT - at + LENGTH)
                twin = twin[(self.bytes[one[twin], window] == self.bytes[one[twin + 1], window]).all(axis=1)]
                found = one[np.unique(np.concatenate([twin, twin + 1]))]
                self.most[found] = np.maximum(self.most[found], at)
                self.least[found] = np.minimum(self.least[found], at)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, twin, start, end): bytes of a row that are covered by repeated strings, for (key, row, twin, at, before, context)."""
    family, rows, twins, ats = Family(), [], [], []
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH):
            part = batch.slice(k, BATCH)
            before = part.column(4).to_numpy().astype(np.int64)
            held = part.column(5).to_pylist()
            sizes = np.array([len(c) for c in held])
            place = np.arange(sizes.sum()) + np.repeat(np.arange(len(held)) * (LEFT + RIGHT) + LEFT - before - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            bytes_ = np.zeros(len(held) * (LEFT + RIGHT), np.uint8)
            bytes_[place] = np.frombuffer(b"".join(held), np.uint8)
            family.add(part.column(0).to_numpy().view(np.uint64), bytes_.reshape(-1, LEFT + RIGHT), before, sizes - before)
            rows.append(part.column(1).to_numpy())
            twins.append(part.column(2).to_numpy())
            ats.append(part.column(3).to_numpy().astype(np.int64))
    if rows:
        family.settle()
        rows, twins, ats = np.concatenate(rows), np.concatenate(twins), np.concatenate(ats)
        hit = family.most >= 0
        start, end = ats[hit] - family.most[hit], ats[hit] - family.least[hit] + LENGTH
        yield pa.RecordBatch.from_arrays([pa.array(rows[hit]), pa.array(twins[hit]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["row", "twin", "start", "end"])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of the bytes in spans."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        out = []
        for text, own in zip(texts, spans):
            raw, runs = text.encode("utf-8", "surrogatepass"), union([(s["start"], s["end"]) for s in own])
            cuts = [0, *(x for run in runs for x in run), len(raw)]
            out.append((len(runs), b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))))
        columns = list(zip(*out)) or [[]] * 2
        kinds = (pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["row", "twin", "n_spans", "rest"])


NAME = ["row", "twin"]


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that stay, for every row of (doc_id, text)."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select(F.xxhash64("text").alias("row"), F.xxhash64(F.lit(1), "text").alias("twin"), "doc_id", "text")  # 128 bits of a text
    found = texts.mapInArrow(tidy(_anchored), "row long, twin long, doc_id long, n_bytes long, ats array<int>, keys array<long>, runs array<struct<start:int,end:int>>")
    found = written(found, "anchors")
    one = found.groupBy(*NAME).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.first(F.struct("n_bytes", "ats", "keys", "runs")).alias("x")).select(*NAME, "copies", "doc_id", "x.*")
    one = written(one, "distinct")
    suffixes = one.select(*NAME, F.explode(F.arrays_zip("ats", "keys")).alias("x")).select(*NAME, "x.ats", "x.keys")
    twice = suffixes.groupBy("keys").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("keys")
    both = suffixes.join(twice, "keys").groupBy(*NAME).agg(F.collect_list(F.struct("ats", "keys")).alias("x"))
    wanted = one.filter("size(ats) > 0").select(*NAME, "copies", "doc_id", "runs").join(both, NAME, "left").filter("x IS NOT NULL OR size(runs) > 0")
    wanted = wanted.select(*NAME, "copies", F.col("doc_id").alias("of"), "runs", F.col("x.ats").alias("ats"), F.col("x.keys").alias("keys"))
    held = texts.join(wanted, NAME).filter(F.col("doc_id").eqNullSafe(F.col("of"))).drop("doc_id", "of")
    held = written(held, "held")
    tasks = max(partitions, (held.agg(F.sum(F.size("ats"))).first()[0] or 0) // TASK)
    held = held.dropDuplicates(NAME)  # rows with one doc_id and one text
    contexts = held.filter("ats IS NOT NULL").select(*NAME, "text", "ats", "keys").mapInArrow(tidy(_contexts), "key long, row long, twin long, at int, before int, context binary")
    spans = contexts.repartition(tasks, "key").mapInArrow(tidy(_repeats), "row long, twin long, start int, end int")
    inside = held.filter("copies = 1").select(*NAME, F.explode("runs").alias("r")).select(*NAME, "r.start", "r.end")
    spans = spans.union(inside).groupBy(*NAME).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cut = held.filter("copies = 1").select(*NAME, "text").join(spans, NAME).mapInArrow(tidy(_removed), "row long, twin long, n_spans long, rest binary")
    copies = one.filter(f"copies > 1 AND n_bytes >= {LENGTH}").select(*NAME, F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("rest"))
    out = texts.join(written(cut.union(copies), "cut"), NAME, "left").withColumn("whole", F.col("text").cast("binary")).withColumn("kept", F.coalesce("rest", "whole"))
    n_bytes, n_kept = (F.octet_length(c).cast("long") for c in ("whole", "kept"))
    return out.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - n_kept).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
