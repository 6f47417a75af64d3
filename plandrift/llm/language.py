"""Language identification: averaged embeddings of hashed subwords with a linear softmax.

Subwords are the byte n-grams of the lower-cased text, white space made one space. Each is hashed to one of
2 ** HASH_BITS vectors of DIMENSION numbers; a text's vector is their mean and a linear softmax over it gives the
languages. Vectors and softmax are trained by stochastic gradient descent in numpy on at most ``max_fit`` labelled
rows. As the mean is linear, a language's score for each subword is looked up at prediction, so whole texts of any
length cost a few lookups a byte. Held-back fitting rows set the temperature of the softmax, and the score below
which a text is rejected: that of the lowest ``reject`` share of them.

Cases: null text, empty text and text without a letter are ``und`` with score 0. Rows without doc_id are never
fitted on and count as not held out. Repeated rows get the same answer. An empty table gives no rows; without any
labelled row all is ``und``. Equal scores go to the language that sorts first. Rows to fit on with one hash are taken
in the order of their text's and lang's. Other columns are ignored; ``accepted`` leaves them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, portions, release, tidy

HASH_BITS, DIMENSION, GRAMS = 16, 16, (2, 4)
#: Labelled rows to fit on, at most.
MAX_FIT = 2500
#: Passes over them, more where they are few, so that there are STEPS at least.
EPOCHS, STEPS, RATE = 4, 2500, 0.5
UNKNOWN = "und"


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' n-grams, and the text of each."""
    clean = [b" " + b" ".join(t.lower().split()) + b" " for t in texts]
    flat = np.frombuffer(b"".join(clean), np.uint8).astype(U64)
    sizes = np.array([len(c) for c in clean])
    out, owner = [], []
    text = np.repeat(np.arange(len(clean), dtype=np.int32), sizes)
    for n in GRAMS:
        if len(flat) < n:
            continue
        gram = sum(flat[k : len(flat) - n + 1 + k] << U64(8 * k) for k in range(n))
        inside = text[: len(gram)] == text[n - 1 :]
        out.append(((gram + U64(n << 40)) * U64(0x9E3779B97F4A7C15) >> U64(64 - HASH_BITS)).astype(np.int64)[inside])
        owner.append(text[: len(gram)][inside])
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate(owner) if owner else np.zeros(0, np.int32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    #: For each subword, its share of each language's logit.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        grams, owner = subwords(texts)
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        sums = [np.bincount(owner, weights=own[grams], minlength=len(texts)) for own in self.weights.T]
        return np.stack(sums, 1) / n[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if known:
            raw = [texts[k].encode("utf-8", "surrogatepass") for k in known]
            p = softmax(np.concatenate([self.logits(raw[own]) for own in portions(raw)]) / self.temperature)
            best = p.argmax(axis=1)
            score[known] = p[np.arange(len(known)), best]
            for k, b in zip(known, best):
                named[k] = self.languages[b]
        return named, score

    def rejects(self, named: list[str], score: np.ndarray) -> list[bool]:
        return [x == UNKNOWN or bool(s < self.least) for x, s in zip(named, score)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], reject: float = 0.001, seed: int = 1) -> Model:
    """Fits on the rows given, in their order; each fifth is held back for temperature and rejection."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << HASH_BITS, 0)), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])
    rows = [subwords([t.encode("utf-8", "surrogatepass")])[0].astype(np.uint16) for t in texts]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << HASH_BITS, DIMENSION))
    head, bias = np.zeros((DIMENSION, len(languages))), np.zeros(len(languages))
    fitted = [k for k in range(len(rows)) if k % 5 != 4 and len(rows[k])]
    epochs = max(EPOCHS, -(-STEPS // max(1, len(fitted))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(fitted):
            own = rows[k]
            mean = vectors[own].mean(axis=0)
            slope = softmax((mean @ head + bias)[None])[0]
            slope[y[k]] -= 1
            back = head @ slope
            head -= rate * np.outer(mean, slope)
            bias -= rate * 0.1 * slope
            np.add.at(vectors, own, -rate * back / len(own) * 8)
    model = Model(languages, vectors @ head, bias)
    back = [k for k in range(len(rows)) if k % 5 == 4 and len(rows[k])]
    if back:
        raw = [texts[k].encode("utf-8", "surrogatepass") for k in back]
        logits = np.concatenate([model.logits(raw[own]) for own in portions(raw)])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(back)), y[back]], 1e-12)).mean()
        model.temperature = min((2.0 ** (k / 4) for k in range(-16, 17)), key=loss)
        model.least = min(0.5, float(np.quantile(softmax(logits / model.temperature).max(axis=1), reject)))
    return model


def fit(documents: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """Fits on at most max_fit rows with text, lang and a doc_id with crc32(doc_id) mod 3 not 1: those of the smallest hash."""
    known = F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    labelled = documents.filter(known).select(F.xxhash64("doc_id").alias("one"), F.xxhash64("text", "lang").alias("two"), "lang", "text")
    first = labelled.select("one", "two").orderBy("one", "two").limit(max_fit)
    last = first.agg(F.max(F.struct("one", "two"))).first()[0]
    rows = []
    if last is not None:  # fewer than max_fit rows come before the last one; of its repetitions, no more than that are read
        equal = (F.col("one") == last["one"]) & (F.col("two") == last["two"])
        before = (F.col("one") < last["one"]) | ((F.col("one") == last["one"]) & (F.col("two") < last["two"]))
        rows = labelled.filter(before).collect()
        rows += labelled.filter(equal).limit(max_fit - len(rows)).collect()
    chosen = [r for r in sorted(rows)[:max_fit] if has_letter(r["text"])]
    model = train([r["text"] for r in chosen], [r["lang"] for r in chosen])
    del rows, chosen
    release()
    return model


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of (doc_id, text)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            named, score = own.predict(batch.column(1).to_pylist())
            columns = [batch.column(0), batch.column(2), pa.array(named, pa.string()), pa.array(score), pa.array(own.rejects(named, score), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return documents.select(F.col("doc_id").cast("long"), "text", held.alias("held_out")).mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of documents whose language the model doesn't reject, with all their columns."""
    sent, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rejected = own.rejects(*own.predict(batch.column(at).to_pylist()))
            yield batch.filter(pa.array([not x for x in rejected], pa.bool_()))

    return documents.mapInArrow(tidy(run), documents.schema)
