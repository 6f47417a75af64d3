"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find.

SuperMinHash gives each element a random permutation of the signature's places, one place a round, and a value
r + round there, so an element's values are ranks that differ from place to place; a document stops as soon as no
later round can lower a place. Documents with equal sets are one class, stood for by the smallest doc_id. Classes
that agree on all ROWS values of one of BANDS bands are candidates, and a link is an intersection of at least
threshold times the union of the two full sets.

The search has two steps. First, in every other band, the classes of a bucket stand in an order that differs from band
to band, cut into chunks of about CHUNK; each is a candidate with its chunk's first, in buckets of one chunk also with
its predecessor, and the chunks' first ones with the bucket's. Each class is verified against its likeliest candidates,
so that the many copies of one text collapse into one component with work in proportion to the classes.

Then every bucket that still holds several components is searched to the end: all its pairs across components are
compared, in units of at most two blocks of about BLOCK classes (or ELEMENTS shingles), which tasks hold one at a time.
The largest component of a bucket needs no comparison within itself, so a unit of two of its blocks doesn't exist. A
pair whose signatures agree in less than LIKELY of the places, five standard deviations under a similarity of 0.8, is
passed over; one that meets in several bands is compared in the first. What remains is compared on full sets, and a
unit returns a link only where it joins two components, so the rows never outgrow the classes.

Cases: null, empty and white-space texts have no set (n_shingles 0) and are linked with nothing. With fewer words
than the width, the whole sequence is one shingle. Rows with one doc_id are one document, which links wherever one of
its texts does; n_shingles is each row's own. Rows without doc_id take no part in links and are returned with a null
component and kept false. An empty table gives no rows. Columns beside the two named are ignored here; ``keep_one``
leaves them as they are, and leaves rows without doc_id in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mix, portions, shingles_of, tidy, words_of, written
from .components import components

#: At a similarity of 0.8 a pair shares none of 24 bands of 4 values in 3 of a million cases.
BANDS, ROWS = 24, 4
PLACES = BANDS * ROWS
CHUNK = 256
#: Classes of a block, and shingles; pairs that are compared on full sets at once, and bytes of bit sets held for it.
BLOCK, ELEMENTS, TOGETHER, HELD = 8192, 2_000_000, 8192, 1 << 24
#: The least similarity of a link, in hundredths.
PERCENT = 80
#: Of PLACES, those that two signatures agree in at least, and those of a pair that is all but surely a link.
LIKELY, SURE = 58, 82


def sets_of(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted hashes, and their bounds."""
    hashes, bounds, _, _ = words_of(texts)
    counts = np.diff(bounds)
    shingles, at = shingles_of(hashes, bounds, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = []
        for k in short:
            own = hashes[bounds[k] : bounds[k] + 1]
            for w in range(bounds[k] + 1, bounds[k + 1]):
                own = mix(own * U64(0x9E3779B97F4A7C15)) + hashes[w : w + 1]
            whole.append(own)
        shingles = np.concatenate([shingles, mix(np.concatenate(whole), 1)])
    owner = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(at)), short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    shingles, owner = shingles[new], owner[new]
    return shingles, np.searchsorted(owner, np.arange(len(texts) + 1))


def digests(shingles: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A name of 16 bytes for each set."""
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(shingles, seed))]) for seed in (11, 12)]
    return pa.array([d.tobytes() for d in np.stack([x[bounds[1:]] - x[bounds[:-1]] for x in sums], 1)], pa.binary())


def signatures(shingles: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash values, as round * 2 ** 32 + a 32-bit fraction, of each set; all-ones for an empty one."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    best = np.full(n * places, 0xFFFFFFFFFFFFFFFF, U64)
    active = np.arange(len(shingles))
    for turn in range(places):
        if not len(active):
            break
        drawn = mix(shingles[active], turn + 2)
        swap = turn + ((drawn >> U64(32)) * U64(places - turn) >> U64(32)).astype(np.int64)
        if turn == 0:
            place = swap
            moved_at, moved_to = [swap], [np.zeros(len(active), np.int64)]  # place swap now holds 0
        else:
            # Fisher-Yates with only the places that were moved: where an element's place ``swap`` points now
            place, mine = swap.copy(), np.full(len(active), turn)
            for at, to in zip(moved_at, moved_to):
                place = np.where(at == swap, to, place)
                mine = np.where(at == turn, to, mine)
            moved_at.append(swap)
            moved_to.append(mine)
        value = (U64(turn) << U64(32)) | (drawn & U64(0xFFFFFFFF))
        np.minimum.at(best, owner[active] * places + place, value)
        most = (best.reshape(n, places).max(axis=1) >> U64(32)).astype(np.int64)
        going = most[owner[active]] > turn
        active = active[going]
        moved_at, moved_to = [x[going] for x in moved_at], [x[going] for x in moved_to]
    return best.reshape(n, places)


def prepared(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch): digest names the set in 128 bits, bands are a hash for each band, sketch has a byte for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for where in portions(texts):
                part = batch.slice(where.start, where.stop - where.start)
                shingles, bounds = sets_of(texts[where], width)
                sizes = np.diff(bounds)
                signed = signatures(shingles, bounds)
                bands = np.zeros((len(sizes), BANDS), U64)
                for r in range(ROWS):
                    bands = mix(bands + signed[:, r::ROWS][:, :BANDS], r)
                bands = mix(bands + np.arange(BANDS, dtype=U64), 9).astype(np.int64)
                sketch = (mix(signed, 13) & U64(255)).astype(np.uint8).view(np.int64)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), digests(shingles, bounds), listed(bands), listed(sketch)],
                    ["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _agreeing(x, y):
    """How many bytes of two sketches are equal."""
    differ = F.lit(0)
    for k in range(PLACES // 8):
        z = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        for shift in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        differ = differ + F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(PLACES) - differ


def _pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, likely) with a < b of rows (x, y), two classes (id, n) that may be similar enough."""
    fit = rows.filter((F.col("x.id") != F.col("y.id")) & (100 * F.least("x.n", "y.n") >= F.lit(PERCENT) * F.greatest("x.n", "y.n")))
    fit = fit.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    side = lambda me, name: classes.select(F.col("id").alias(me), F.col("sketch").alias(name))
    both = fit.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.select("a", "b", _agreeing(F.col("x"), F.col("y")).alias("likely")).filter(F.col("likely") >= LIKELY)


ME = ("id", "n")


def candidates(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes in the buckets (bucket, size, id, n), at most three for each row."""
    ranked = buckets.withColumn("rank", F.xxhash64("bucket", "id"))
    dealt = ranked.withColumn("chunk", F.pmod("rank", F.ceil(F.col("size") / CHUNK)))
    order = Window.partitionBy("bucket", "chunk").orderBy("rank", "id")
    me = F.struct(*ME)
    near = dealt.withColumns({"first": F.first(me).over(order), "before": F.lag(me).over(order), "me": me}).select("bucket", "size", "me", "first", "before")
    heads = near.filter(F.col("before").isNull() & (F.col("size") > CHUNK)).select("bucket", "me")
    tops = heads.groupBy("bucket").agg(F.min("me").alias("top"))
    close = F.when(F.col("size") <= CHUNK, F.col("before"))
    pairs = near.select(F.col("me").alias("x"), F.explode(F.array_compact(F.array(F.col("first"), close))).alias("y"))
    return _pairs(pairs.union(heads.join(tops, "bucket").select("me", "top")), classes)


def likeliest(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are the likeliest of a or of b, and each one's with the smallest other of those that are all but SURE."""
    side = lambda me, other: pairs.select(F.col(me).alias("me"), F.struct("likely", (-F.col(other)).alias("other")).alias("to"), F.when(F.col("likely") >= SURE, F.col(other)).alias("sure"))
    best = side("a", "b").union(side("b", "a")).groupBy("me").agg((-F.max("to")["other"]).alias("likely"), F.min("sure").alias("sure"))
    best = best.select("me", F.explode(F.array_compact(F.array("likely", "sure"))).alias("other"))
    return best.select(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")).distinct()


def units(buckets: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    """UNIT rows of the buckets (bucket, id, n) that hold several components: each class in every unit that it is compared in."""
    labelled = buckets.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("elements"))
    most = F.max(F.struct("members", "elements", "component")).alias("most")
    mixed = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("members").alias("members"), F.sum("elements").alias("elements"), most).filter("parts > 1")
    blocks = lambda members, elements: F.greatest(F.ceil(members / BLOCK), F.ceil(elements / ELEMENTS)).cast("int")
    whole = blocks(F.col("members"), F.col("elements")) <= 1
    others = F.when(whole, 1).otherwise(blocks(F.col("members") - F.col("most.members"), F.col("elements") - F.col("most.elements")))
    sized = mixed.select("bucket", whole.alias("whole"), F.col("most.component").alias("largest"), others.alias("others"), blocks(F.col("most.members"), F.col("most.elements")).alias("mine"))
    rows = labelled.join(sized, "bucket").withColumn("top", ~F.col("whole") & (F.col("component") == F.col("largest")))
    at = F.pmod(F.xxhash64("id", "bucket"), F.when(F.col("top"), F.col("mine")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("top"), F.col("others")).otherwise(0) + at)
    other = F.sequence(F.lit(0), F.when(F.col("whole"), 0).when(F.col("top"), F.col("others") - 1).otherwise(F.col("others") + F.col("mine") - 1))
    met = F.transform(other, lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    dealt = rows.select("bucket", F.explode(met).alias("u"), "block", "id", "n", "component").join(classes.select("id", "bands", "sketch", "digest"), "id")
    return dealt.select("bucket", "u.i", "u.j", (F.col("block") != F.col("u.i")).alias("second"), "id", "n", "component", "bands", "sketch", "digest")


UNIT = "bucket long, i int, j int, second boolean, id long, n long, component long, bands array<long>, sketch array<long>, digest binary"


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy()


def _each_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole units, and where each unit begins, and the last one's end, of rows in the order of (bucket, i, j)."""
    held = None
    for batch in batches:
        own = pa.Table.from_batches([batch])
        held = own if held is None else pa.concat_tables([held, own])
        key = np.stack([held.column(k).to_numpy() for k in ("bucket", "i", "j")])
        edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if len(edges):
            yield held.slice(0, edges[-1]), [0, *edges.tolist()]
            held = held.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


class _Unit:
    """Classes to compare, from row begin to end of a table's columns."""

    def __init__(self, columns: dict[str, np.ndarray], begin: int, end: int) -> None:
        own = {k: v[begin:end] for k, v in columns.items()}
        self.bucket, self.id, self.n, self.bands, self.sketch = own["bucket"][0], own["id"], own["n"], own["bands"], own["sketch"]
        self.part = np.unique(own["component"], return_inverse=True)[1]
        self.second = int((~own["second"]).sum()) if own["i"][0] != own["j"][0] else 0

    @staticmethod
    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        out = {k: table.column(k).to_numpy() for k in ("bucket", "i", "j", "second", "id", "n", "component")}
        return out | {"bands": _flat(table.column("bands")).reshape(-1, BANDS), "sketch": _flat(table.column("sketch")).view(np.uint8).reshape(-1, PLACES)}

    def close(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each class the later ones in other components that it may link with and meets here first."""
        for k in range(self.second or len(self.id)):
            begin = self.second or k + 1
            n, mine = self.n[begin:], self.n[k]
            other = begin + np.flatnonzero((self.part[begin:] != self.part[k]) & (100 * np.minimum(n, mine) >= PERCENT * np.maximum(n, mine)))
            if len(other):
                equal = (self.sketch[other] == self.sketch[k]).view(U64).sum(axis=1, dtype=U64)  # each byte: places of eight
                other = other[(equal * U64(0x0101010101010101)) >> U64(56) >= LIKELY]
            if len(other):
                shared = self.bands[other] == self.bands[k]
                other = other[self.bands[k][shared.argmax(axis=1)] == self.bucket]
            if len(other):
                yield k, other


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The UNIT rows that have a pair to compare."""
    for table, edges in _each_unit(batches):
        columns, keep = _Unit.columns(table), np.zeros(table.num_rows, bool)
        for begin, end in zip(edges, edges[1:]):
            for k, other in _Unit(columns, begin, end).close():
                keep[begin + k] = keep[begin + other] = True
        yield from table.filter(pa.array(keep)).combine_chunks().to_batches()


def shared_counts(members: np.ndarray, bounds: np.ndarray):
    """A function from two arrays of sets' numbers to the sizes of their intersections; members are the sets, one after another."""
    names, codes = np.unique(members, return_inverse=True)
    common = np.bincount(codes) > 1
    sizes, codes = np.diff(bounds), np.where(common, np.cumsum(common) - 1, -1)[codes]
    width = -(-int(common.sum()) // 64)
    if width * 8 * len(sizes) <= HELD:
        owner, shared = np.repeat(np.arange(len(sizes)), sizes), codes >= 0
        bits = np.zeros((len(sizes), width), U64)
        np.bitwise_or.at(bits, (owner[shared], codes[shared] >> 6), U64(1) << (codes[shared] & 63).astype(U64))
        step = max(1, (HELD >> 4) // max(1, width))  # so that what is made of them takes no more than the bits themselves

        def counted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            parts = [np.bitwise_count(bits[a[k : k + step]] & bits[b[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), step)]
            return np.concatenate(parts)

        return counted

    # what only one set has is of no account
    kept = codes >= 0
    bounds, codes = np.concatenate([[0], np.cumsum(kept)])[bounds], codes[kept]
    own = lambda k: codes[bounds[k] : bounds[k + 1]]
    return lambda a, b: np.array([len(np.intersect1d(own(x), own(y), assume_unique=True)) for x, y in zip(a, b)], np.int64)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links between components, no more than join them, for UNIT rows with members."""
    for table, edges in _each_unit(batches):
        columns, members = _Unit.columns(table), table.column("members").combine_chunks()
        flat, at = members.flatten().to_numpy(), members.offsets.to_numpy() - members.offsets[0].as_py()
        out = []
        for begin, end in zip(edges, edges[1:]):
            unit = _Unit(columns, begin, end)
            count = shared_counts(flat[at[begin] : at[end]], at[begin : end + 1] - at[begin])
            waiting, n = [], 0

            def settle() -> None:
                a = np.concatenate([np.full(len(o), k) for k, o in waiting])
                b = np.concatenate([o for _, o in waiting])
                both = count(a, b)
                linked = 100 * both >= PERCENT * (unit.n[a] + unit.n[b] - both)
                up = np.arange(len(unit.id))
                for x, y in zip(a[linked].tolist(), b[linked].tolist()):
                    p, q = int(unit.part[x]), int(unit.part[y])
                    while up[p] != p:
                        p = int(up[p])
                    while up[q] != q:
                        q = int(up[q])
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        out.append((unit.id[x], unit.id[y]))
                while (again := up[up]).tolist() != up.tolist():
                    up = again
                unit.part = up[unit.part]

            for k, other in unit.close():
                waiting.append((k, other))
                n += len(other)
                if n >= TOGETHER:
                    settle()
                    waiting, n = [], 0
            if waiting:
                settle()
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def across(buckets: DataFrame, classes: DataFrame, component: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all components that share a bucket and have a pair that is similar enough."""
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "second")
    wanted = written(dealt(units(buckets, classes, component)).mapInArrow(tidy(_wanted), UNIT), "wanted")
    return dealt(wanted.join(sets, ["id", "digest"])).mapInArrow(tidy(_joined), "a long, b long")


def full_sets(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, digest, members): the sets of the documents (doc_id, text) in ids (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for where in portions(texts):
                part = batch.slice(where.start, where.stop - where.start)
                shingles, bounds = sets_of(texts[where], width)
                yield pa.RecordBatch.from_arrays([part.column(0), digests(shingles, bounds), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shingles.astype(np.int64)))], ["id", "digest", "members"])

    texts = documents.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return texts.mapInArrow(tidy(run), "id long, digest binary, members array<long>").filter(F.size("members") > 0)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    side = lambda me, name: sets.join(pairs.select(F.col(me).alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias(me), F.col("members").alias(name))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("all"))
    return shared.filter(100 * F.col("both") >= PERCENT * (F.col("all") - F.col("both"))).select("a", "b").distinct()


def several(own: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from each class of a doc_id with several texts to that doc_id."""
    sets = own.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "digest")
    many = sets.groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("many")).filter("many").select("doc_id")
    of = sets.join(many, "doc_id", "left_semi").distinct().join(classes.select("n_shingles", "digest", "id"), ["n_shingles", "digest"])
    return of.filter("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))


def near_duplicates(documents: DataFrame, width: int = 5) -> DataFrame:
    """For each row of (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that its links reach), kept."""
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    own = written(prepared(documents, width), "prepared")
    classes = own.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("id"), F.first(F.struct("bands", "sketch")).alias("s"))
    classes = written(classes.select("n_shingles", "digest", "id", "s.bands", "s.sketch"), "classes")
    rows = classes.select("id", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = written(rows.join(sizes, "bucket"), "buckets")
    sets = written(full_sets(documents, buckets.select("id").distinct(), width), "sets")
    near = written(candidates(buckets.filter("band % 2 = 0"), classes), "candidates")
    links = written(verified(likeliest(near), sets).union(several(own, classes)), "links")
    more = written(across(buckets.select("bucket", "id", "n"), classes, components(links), sets), "links")
    component = components(links.union(more).distinct())
    of = classes.join(component, "id", "left").select("n_shingles", "digest", F.coalesce("component", "id").alias("component_id"))
    grouped = own.filter("n_shingles > 0").drop("bands", "sketch").join(of, ["n_shingles", "digest"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    empty = own.filter("n_shingles = 0").select("doc_id", "n_shingles")
    alone = empty.join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return grouped.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(documents: DataFrame, width: int = 5) -> DataFrame:
    """The rows of documents that are kept, with all their columns; of repeated rows with one doc_id, each; and those without one."""
    gone = near_duplicates(documents, width).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")
