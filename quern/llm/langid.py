"""Language identification with blended-spectrum string kernels.

A text is described by which byte sequences of one to SPECTRUM bytes occur in it (presence, not counts, of the whole
lower-cased text, with each run of anything but letters as one space). The kernel of two texts is the number of
sequences of the learnt universe that both have, divided by the geometric mean of how many each has. A sample of
labelled texts gives the universe; some of them are landmarks, and a text's kernel values with these, multiplied by the
inverse root of the landmarks' own kernel matrix (Nystroem), are its features. One ridge regression per language (one
versus rest) on these features is kernel ridge regression in that approximation. Scoring is two matrix products per batch.

The sample takes at most PER_LANGUAGE texts of each language, those with the smallest key hashes; the bound is a
parameter. All languages are learnt. Every whole text is scored.

Defined cases: a text that is null or has no letter is 'und' with score 0, as is every text if nothing could be learnt;
null languages are not learnt; equal scores go to the language that sorts first; rows with equal keys are
predicted alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import broadcast_if_small, checkpointed, remainder

SPECTRUM = 3
PER_LANGUAGE, LANDMARKS = 256, 128
#: Texts of a batch whose presence matrix is held at once, and bytes looked up at a time.
ROWS, STEP = 64, 1 << 20
#: Anything but letters; in the byte pattern, letters are ASCII letters and everything outside ASCII.
GAPS = re.compile(rb"[^a-z\x80-\xff]+")


def clean(text: str) -> bytes:
    return b" " + GAPS.sub(b" ", text.lower().encode()) + b" "


def sequences(data: np.ndarray, length: int) -> np.ndarray:
    key = data[: max(0, len(data) - length + 1)].astype(np.int64)
    for k in range(1, length):
        key = key << 8 | data[k : k + len(key)]
    return key + (1 << 8 * length)


def present(text: bytes) -> np.ndarray:
    """The distinct sequences of a text; each length has codes of its own."""
    data = np.frombuffer(text, np.uint8)
    return np.unique(np.concatenate([np.unique(sequences(data[a : a + STEP + length - 1], length)) for length in range(1, SPECTRUM + 1) for a in range(0, max(1, len(data)), STEP)]))


@dataclass
class Classifier:
    """universe: sorted codes; landmarks: presence by code (codes x landmarks); weights: landmarks x languages."""

    universe: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    languages: list[str]
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def presence(self, texts: list[bytes]) -> np.ndarray:
        """Rows of 0 and 1: which codes of the universe each text has."""
        if self.table is None:
            # Codes of up to three bytes address a table directly.
            self.table = np.full(1 << (8 * SPECTRUM + 1), len(self.universe), np.int32)
            self.table[self.universe] = np.arange(len(self.universe))
        out = np.zeros((len(texts), len(self.universe) + 1), np.float32)
        for row, text in zip(out, texts, strict=True):
            data = np.frombuffer(text, np.uint8)
            for a in range(0, len(data), STEP):
                for length in range(1, SPECTRUM + 1):
                    row[self.table[sequences(data[a : a + STEP + length - 1], length)]] = 1
        return out[:, :-1]

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        return presence @ self.landmarks / np.sqrt(np.maximum(presence.sum(axis=1), 1))[:, None] / self.sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        here = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for a in range(0, len(here), ROWS):
            rows = here[a : a + ROWS]
            # One-versus-rest values are near 1 for the language and near 0 for others; their softmax is a share.
            values = (self.kernel(self.presence([clean(texts[k]) for k in rows])) @ self.weights).astype(np.float64) * 8
            shares = np.exp(values - values.max(axis=1, keepdims=True))
            shares /= shares.sum(axis=1, keepdims=True)
            for k, share in zip(rows, shares, strict=True):
                best = int(share.argmax())
                names[k], scores[k] = self.languages[best], float(share[best])
        return names, scores


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Classifier:
    """The classifier from (language, codes present) of each text of the sample."""
    sample = sorted(((lang, codes) for lang, codes in sample if len(codes)), key=lambda x: x[0])
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return Classifier(np.empty(0, np.int64), np.empty((0, 0)), np.empty(0), np.empty((0, 0)), [])
    codes, texts = np.unique(np.concatenate([c for _, c in sample]), return_counts=True)
    # A sequence of one text of the sample says nothing about others.
    universe = codes[texts > 1] if (texts > 1).any() else codes

    def presence(rows: list[int]) -> np.ndarray:
        out = np.zeros((len(rows), len(universe)), np.float32)
        for row, k in zip(out, rows, strict=True):
            c = sample[k][1]
            at = np.searchsorted(universe, c)
            at, c = at[at < len(universe)], c[at < len(universe)]
            row[at[universe[at] == c]] = 1
        return out

    # Landmarks in turn from each language.
    by = {lang: [k for k, (x, _) in enumerate(sample) if x == lang] for lang in languages}
    turns = sorted((n, lang, k) for lang, rows in by.items() for n, k in enumerate(rows))
    chosen = [k for _, _, k in turns[: max(landmarks, len(languages))]]
    marks = presence(chosen)
    out = Classifier(universe, np.ascontiguousarray(marks.T), np.sqrt(np.maximum(marks.sum(axis=1), 1)), np.empty((0, 0)), languages)
    # Only the landmarks' presence is held whole; that of the sample is made and multiplied some rows at a time.
    kernel = np.vstack([out.kernel(presence(list(range(a, min(a + ROWS, len(sample)))))) for a in range(0, len(sample), ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    target = np.array([[lang == x for x in languages] for lang, _ in sample], np.float64)
    # Each language weighs the same, however many texts of it there are.
    weight = 1 / target.sum(axis=0)[[languages.index(lang) for lang, _ in sample]]
    left = (features * weight[:, None]).T @ features + ridge * np.eye(features.shape[1])
    out.weights = (root @ np.linalg.solve(left, (features * weight[:, None]).T @ target)).astype(np.float32)
    return out


def learn(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = PER_LANGUAGE) -> Classifier:
    """A classifier from rows whose crc32 of doc_id has another remainder than held; docs: doc_id, text, lang."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(remainder("doc_id", folds) != held)
    counts = checkpointed(known.groupBy("lang").agg(F.count("*").alias("n")))
    # Keys that hash below a bound hold about four times what is asked for; with fewer rows than that, all keys do.
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    narrow = known.select("doc_id", "lang").join(broadcast_if_small(counts), "lang").filter(spread <= (1 << 30) * F.least(F.lit(1.0), 4 * per_language / F.col("n")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(spread, "doc_id"))
    few = checkpointed(narrow.distinct().withColumn("nth", nth).filter(F.col("nth") <= per_language).select("doc_id", "lang"))
    # Of rows with equal keys only those of the sampled language are learnt.
    taken = known.select("doc_id", "lang", "text").join(broadcast_if_small(few), ["doc_id", "lang"], "left_semi")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [present(clean(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int64()))], ["lang", "codes"])

    sample = taken.select("lang", "text").mapInArrow(take, "lang string, codes array<bigint>").toArrow()
    return fit([(lang, codes.values.to_numpy()) for lang, codes in zip(sample.column("lang").to_pylist(), sample.column("codes"), strict=True)])


def predict(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, folds, held))
    rows = docs.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                names, scores = model.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
