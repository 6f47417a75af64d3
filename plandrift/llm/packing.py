"""Vector bin packing of token sequences: tokens, segments and loss-bearing tokens are limited at once.

Each task packs the examples that it reads, so nothing is shuffled and memory is bounded by the open bins. Whole
runs of ``max_tokens`` fill a bin alone. What is left of an example goes to the open bin with the largest dot
product of its (tokens, segments, loss) vector with the bin's room, each as a share of its limit. If none has
room and OPEN bins are open, the example is cut to fill the fullest of them, which is then closed. At the end of
a task the open bins are emptied into sequences of 2 ** k tokens, which need no padding, so only a bin closed by
its limit on segments or loss is padded.

Cases: null text counts as empty and is the end-of-text id alone. Rows without doc_id are packed too. Repeated
rows are separate examples. An empty table gives no rows. Columns beside those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Bins that a task keeps open.
OPEN = 48
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces (key, start, length) of examples into bins; ``out`` gets (key, start, length, bin, offset)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first: int = 0):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.room = np.zeros((0, 3))
        self.bins: list[list[tuple]] = []
        self.next, self.out = first, []

    def close(self, k: int) -> None:
        at = 0
        for key, start, length, _ in self.bins[k]:
            self.out.append((key, start, length, self.next, at))
            at += length
        self.next += 1
        self.room = np.delete(self.room, k, 0)
        del self.bins[k]

    def put(self, k: int, key, start: int, length: int, loss: int) -> None:
        self.bins[k].append((key, start, length, loss))
        self.room[k] -= (length, 1, loss)
        if (self.room[k] <= 0).any():
            self.close(k)

    def add(self, key, start: int, length: int, loss: int) -> None:
        """loss: how many of the piece's last tokens bear loss."""
        need = np.array([length, 1, loss], float)
        fits = (self.room >= need).all(axis=1)
        if fits.any():
            score = np.where(fits, (self.room / self.limits) @ (need / self.limits), -1.0)
            return self.put(int(score.argmax()), key, start, length, loss)
        if len(self.bins) < OPEN and (need <= self.limits).all():
            self.room = np.vstack([self.room, self.limits])
            self.bins.append([])
            return self.put(len(self.bins) - 1, key, start, length, loss)
        if not self.bins:  # more than a bin holds
            self.room, self.bins = self.limits[None].copy(), [[]]
        k = int(self.room[:, 0].argmin())
        most = min(length, int(self.room[k, 0]), length - loss + int(self.room[k, 2]))
        self.put(k, key, start, most, max(0, most - (length - loss)))
        if most < length:
            self.add(key, start + most, length - most, min(loss, length - most))

    def finish(self) -> None:
        """Empties the open bins into sequences of a power of two of tokens, as far as the other limits allow."""
        rest = [piece for own in self.bins for piece in own]
        self.bins, self.room = [], np.zeros((0, 3))
        total, k = sum(p[2] for p in rest), 0
        while total:
            size, loss_room = min(int(self.limits[0]), 1 << (total.bit_length() - 1)), int(self.limits[2])
            own, at = [], 0
            while at < size and len(own) < self.limits[1]:
                key, start, length, loss = rest[k]
                most = min(length, size - at, length - loss + loss_room)
                if not most:
                    break
                bearing = max(0, most - (length - loss))
                own.append((key, start, most, bearing))
                at, loss_room = at + most, loss_room - bearing
                rest[k] = (key, start + most, length - most, loss - bearing)
                k += most == length
            self.bins, self.room = [own], np.ones((1, 3))
            self.close(0)
            total -= at

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(examples: DataFrame, encode: Callable[[], Callable[[list[str]], list[np.ndarray]]], max_tokens: int = 1024, max_segments: int = 256, max_loss: int | None = None, end_id: int = 0, prompt: str | None = None) -> DataFrame:
    """Pieces of the examples (doc_id, text[, prompt]) in sequences of at most max_tokens tokens, max_segments pieces and max_loss tokens that bear loss.

    encode: makes, in each task, a function from texts to their ids. With a column ``prompt``, its tokens come
    first and bear no loss; else all tokens do.
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    columns = [F.col("doc_id").cast("long"), "text", *([F.col(prompt).alias("prompt")] if prompt else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encoded = Packer(*limits, first=TaskContext.get().partitionId() << 33), encode()
        waiting: dict[int, list] = {}
        n = 0

        def rows() -> pa.RecordBatch:
            found = []
            for key, start, length, at, offset in packer.taken():
                own = waiting[key]
                doc, ids = own[0], own[1]
                found.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), at, offset))
                own[2] -= length
                if not own[2]:
                    del waiting[key]
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*found)) or [[]] * len(names)], names)

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            before = encoded([t or "" for t in batch.column(2).to_pylist()]) if prompt else [np.zeros(0, "<u4")] * len(texts)
            for doc, head, ids in zip(batch.column(0).to_pylist(), before, encoded(texts)):
                ids = np.concatenate([head, ids, [end_id]]).astype("<u4")
                free = len(head)
                waiting[n] = [doc, ids, len(ids)]
                start = 0
                while len(ids) - start >= max_tokens and limits[2] >= max_tokens:
                    packer.out.append((n, start, max_tokens, packer.next, 0))
                    packer.next += 1
                    start += max_tokens
                if start < len(ids):
                    packer.add(n, start, len(ids) - start, len(ids) - max(start, free))
                n += 1
            yield rows()
        packer.finish()
        yield rows()

    return examples.select(*columns).mapInArrow(tidy(run), PIECES)


def byte_bpe(path: str, library: str = "tiktoken") -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Ids of a byte-level BPE vocabulary. The string of a special token in a text is ordinary text, as a document must
    not be able to end itself.

    library "tokenizers" reads the .json at path; "tiktoken" reads the same vocabulary's rank file beside it, gives
    the same ids and takes a sixth of the time.
    """

    def made():
        if library == "tokenizers":
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            return lambda texts: [np.array(e.ids, "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        import base64

        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [np.array(own.encode_ordinary(t), "<u4") for t in texts]

    return made
