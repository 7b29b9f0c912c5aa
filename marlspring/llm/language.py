"""Operator 3: language ID by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte 3-grams says on which
side a text lies (log-odds of the 3-grams under the languages with and without the bit). Decoding
takes the language whose codeword has the least loss, each bit weighted by how well it tells that
language in training, and flags a text as ambiguous where the second language is nearly as near.

Training counts all labelled rows given: tasks emit one count for each language and feature. Only the
bits' weights come from a bounded sample (``CALIBRATION_ROWS``, by the id's hash). The driver gets
languages x FEATURES counts, whatever the corpus size; the model is broadcast. No text is shuffled.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if no
labelled row is given; with one language, every text with a letter gets it; equal losses go to the
first language in order; a null id is never learned from and counts as held out; repeated rows give
repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from marlspring.llm.common import lean, slices

#: Hashed features, and rows (in expectation) that weigh the bits.
FEATURES = 1 << 13
CALIBRATION_ROWS = 20_000
#: Loss below which two languages count as too near to tell.
AMBIGUOUS = 0.15
#: Score under which the filter drops an ambiguous text.
DOUBTFUL = 0.5
#: Log-odds at which a bit is nearly sure.
SURE = 8.0
UNKNOWN = "und"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Texts whose feature counts a task holds at once.
_ROWS = 256


def folded(text: str | None) -> bytes:
    """A text for counting: lower case, everything ASCII but letters as single spaces."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_FOLD).split())


def features(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte 3-grams, a row for each text."""
    raw = np.frombuffer(b" " + b"  ".join(texts) + b"  ", dtype=np.uint8).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
    who = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])[: len(slot)]
    keep = (raw[1:-1] != 32) | ((raw[:-2] != 32) & (raw[2:] != 32))
    keep = keep[: len(who)]
    flat = np.bincount(who[keep] * FEATURES + slot[: len(who)][keep], minlength=len(texts) * FEATURES)
    return flat.reshape(len(texts), FEATURES)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(0, len(texts), _ROWS):
        yield k, features(texts[k : k + _ROWS])


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all distinct two-way splits for few languages, else the widest of random codes."""
    if n <= 6:
        bits = [[1 if k == 0 or (split >> (k - 1)) & 1 else -1 for k in range(n)] for split in range((1 << max(0, n - 1)) - 1)]
        return np.array(bits, dtype=float).T.reshape(n, len(bits))
    random, best, width = np.random.default_rng(7), None, max(24, int(np.ceil(10 * np.log2(n))))
    for _ in range(200):
        code = random.choice([-1.0, 1.0], size=(n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (len(code.T) - code @ code.T)[~np.eye(n, dtype=bool)].min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def bits(self, counts: np.ndarray) -> np.ndarray:
        """How far each bit of each row is set, from -1 to 1."""
        return np.tanh(counts.astype(np.float32) @ self.weights / SURE)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each row."""
        if len(self.languages) == 1:
            return np.zeros(len(counts), int), np.ones(len(counts)), np.zeros(len(counts), bool)
        f = self.bits(counts)
        loss = np.exp(-f[:, None, :] * self.code[None]) * self.trust[None]
        loss = loss.sum(axis=2)
        best = loss.argmin(axis=1)
        two = np.partition(loss, 1, axis=1)
        return best, np.clip((np.e - two[:, 0]) / (np.e - 1 / np.e), 0, 1), two[:, 1] - two[:, 0] < AMBIGUOUS


def train(labelled: DataFrame) -> Model | None:
    """A model from the columns text and lang of all given rows (doc_id only deals out the calibration sample)."""
    rows = labelled.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                languages = np.array(part.column(2).to_pylist(), dtype=object)
                for k, counts in blocks([folded(t) for t in part.column(1).to_pylist()]):
                    some = languages[k : k + len(counts)]
                    for name in set(some):
                        held[name] = held.get(name, 0) + counts[some == name].sum(axis=0)
                        docs[name] = docs.get(name, 0) + int((some == name).sum())
        for name, total in held.items():
            at = np.flatnonzero(total)
            slot, n = np.append(at, -1), np.append(total[at], docs[name])  # slot -1: the number of documents
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot)), pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "slot", "n"])

    summed = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    if not len(summed):
        return None
    languages = sorted(summed["lang"].unique())
    number = {name: k for k, name in enumerate(languages)}
    total = np.zeros((len(languages), FEATURES))
    body = summed[summed["slot"] >= 0]
    total[body["lang"].map(number).to_numpy(dtype=int), body["slot"].to_numpy(dtype=int)] = body["n"]
    share = (total + 0.5) / (total + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.stack([np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) for c in code.T], axis=1).astype(np.float32) if code.size else np.zeros((FEATURES, 0), np.float32)
    model = Model(languages, code, weights, np.ones_like(code) / max(1, code.shape[1]))
    if len(languages) > 1:
        every = max(1, int(summed[summed["slot"] < 0]["n"].sum()) // CALIBRATION_ROWS)
        model.trust = _trust(rows.where(F.expr(f"pmod(xxhash64(doc_id), {every}) = 0")), model)
    return model


def _trust(sample: DataFrame, model: Model) -> np.ndarray:
    """For each language, its bits' weights (sum 1): the share of its texts whose bit came out right, above chance."""
    shared = sample.sparkSession.sparkContext.broadcast(model)
    width = model.code.shape[1]

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        right, seen = np.zeros(m.code.shape), np.zeros(len(m.languages))
        number = {name: k for k, name in enumerate(m.languages)}
        for batch in batches:
            for part in slices(batch, "text"):
                own = np.array([number[x] for x in part.column(2).to_pylist()])
                for k, counts in blocks([folded(t) for t in part.column(1).to_pylist()]):
                    c = own[k : k + len(counts)]
                    np.add.at(right, c, np.sign(m.bits(counts)) == m.code[c])
                    np.add.at(seen, c, 1)
        flat = np.concatenate([right.ravel(), seen])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "n"])

    summed = sample.mapInArrow(count, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas().sort_values("at")["n"].to_numpy()
    if not len(summed):
        return model.trust
    right, seen = summed[: model.code.size].reshape(model.code.shape), summed[model.code.size :]
    above = np.maximum((right + 1) / (seen[:, None] + 2) - 0.5, 1e-3)
    shared.unpersist()
    return above / above.sum(axis=1, keepdims=True) if width else model.trust


def predict(docs: DataFrame, model: Model | None, *keep: str, with_text: bool = False) -> DataFrame:
    """The columns to keep (and the text), and lang_pred, score, ambiguous for each row; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col("text").cast("string").alias("text"), *keep)
    first = 0 if with_text else 1

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(0).to_pylist()
                names = np.full(len(texts), UNKNOWN, dtype=object)
                score, unsure = np.zeros(len(texts)), np.ones(len(texts), bool)
                lettered = np.array([i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))], dtype=int) if m else np.zeros(0, int)
                for k, counts in blocks([folded(texts[i]) for i in lettered]):
                    at = lettered[k : k + len(counts)]
                    best, score[at], unsure[at] = m.decode(counts)
                    names[at] = [m.languages[b] for b in best]
                yield pa.RecordBatch.from_arrays([*part.columns[first:], pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], [*part.schema.names[first:], "lang_pred", "score", "ambiguous"])

    schema = StructType([*kept.schema.fields[first:], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])
    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every whole text; learns from the rows not held out."""
    flagged = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(flagged.where(~F.col("held_out")))
    return predict(flagged, model, "doc_id", "held_out")


def language_filter(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose language is known and not both ambiguous and doubtful."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*[F.col(c) for c in others]).alias("_others"))
    known = predict(rows, model, "_others", with_text=True).where(f"lang_pred <> '{UNKNOWN}' AND NOT (ambiguous AND score < {DOUBTFUL})")
    return known.select(*[F.col("text") if c == "text" else F.col(f"_others.{c}") for c in docs.columns])
