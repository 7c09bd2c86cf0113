"""Language identification by sparse multinomial logistic regression.

Texts become TF-IDF weights of hashed character n-grams of one to three characters, letters
in lower case and all else as one blank.  Document frequencies count every document that
may be learned from.  The classifier is fitted with follow-the-regularised-leader and an
elastic net on a sample of about ``PER_LABEL`` documents of each language, a fifth of which
sets the temperature of the probabilities instead.  It has one weight for each feature and
language and goes out with the tasks.

Documents whose ``crc32(id as text) mod 5`` is 0 are held out, and so are those with a null
language or id from learning.  The prediction reads the text only.  A text that is null or
has no letter is ``und`` with score 0, as is every text if nothing could be learned.
Repeated rows are predicted each; further columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .frames import modest_batches, pieces_of

FEATURES, PER_LABEL, LABELS = 1 << 15, 600, 1000
PENALTY, EPOCHS = ftrl.Penalty(alpha=3.0, beta=1.0, l1=0.003, l2=0.01), 4
#: Characters of a text that are counted at once.
PART = 1 << 20
_SHIFT = np.uint64(64 - 15)
_letters: list[np.ndarray] = []


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, those of no letter as blanks and blanks in a row as one."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters[0][points], points, np.uint32(32))
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == 32) & (points[:-1] == 32)
    return points[~again]


def counts(text: str) -> np.ndarray | None:
    """How often each feature occurs; None for a text without a letter."""
    total, letters = np.zeros(FEATURES, np.int64), False
    before = np.array([32], np.uint64)  # texts begin and end with a blank
    for at in range(0, len(text) + 1, PART):
        part = characters(text[at : at + PART] + ("" if at + PART <= len(text) else " ")).astype(np.uint64)
        if len(part) and part[0] == 32 == before[-1]:
            part = part[1:]
        letters |= bool((part != 32).any())
        points = np.concatenate((before, part))
        h = np.zeros(len(points), np.uint64)
        for n in range(1, min(3, len(points)) + 1):
            h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
            own = h[max(0, len(before) - n + 1) :]  # those that end in this part
            total += np.bincount(((own * np.uint64(0x9E3779B97F4A7C15)) >> _SHIFT).astype(np.int64), minlength=FEATURES)
        before = points[-2:]
    return total if letters else None


def weighted(count: np.ndarray, idf: np.ndarray) -> ftrl.Row:
    """The features of a text and their weights, of length one."""
    at = np.flatnonzero(count)
    x = (1 + np.log(count[at])) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        count = counts(text) if text and self.labels else None
        if count is None:
            return "und", 0.0
        at, x = weighted(count, self.idf)
        p = ftrl.softmax((x @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the documents that may be learned from."""
    modest_batches(docs.sparkSession)
    known = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(LABELS + 1).collect()}
    if len(sizes) > LABELS:
        raise ValueError(f"more than {LABELS} languages")
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros((FEATURES + 1, 0)), np.ones(FEATURES), 1.0)

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if (c := counts(text)) is not None:
                    total += c > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, FEATURES)), pa.array(np.append(total[at], n))], ["feature", "n"])

    df = np.zeros(FEATURES + 1, np.int64)
    for r in known.select("text").mapInArrow(frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # a row for each feature
        df[r["feature"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang, part in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "part")), strict=True):
                if (c := counts(text)) is not None:
                    at, x = weighted(c, idf)
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([part], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["lang", "part", "at", "x"])

    share = F.create_map(*[F.lit(v) for k in labels for v in (k, PER_LABEL / sizes[k])])
    drawn = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col("lang")]
    sample = known.where(drawn).select("id", "text", "lang", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(5)).cast("int").alias("part"))
    sample = sample.mapInArrow(features, "lang string, part int, at binary, x binary").limit(2 * PER_LABEL * len(labels)).collect()  # PER_LABEL of each on average
    sample.sort(key=lambda r: (r["lang"], r["at"], r["x"]))
    rows = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(np.float64)) for r in sample]
    target = np.eye(len(labels))[[labels.index(r["lang"]) for r in sample]].reshape(len(sample), len(labels))
    part = np.array([r["part"] for r in sample], int)
    train, rest = np.flatnonzero(part > 0), np.flatnonzero(part == 0)
    weights = ftrl.fit([rows[i] for i in train], target[train], FEATURES, PENALTY, EPOCHS, many=True)
    heat = ftrl.temperature(ftrl.scores([rows[i] for i in rest], weights), target[rest])
    return Model(labels, weights.astype(np.float32), idf.astype(np.float32), heat)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns and ``lang_pred`` and ``score``."""
    modest_batches(docs.sparkSession)
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    text = own[names.index(text_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text):
            found = [model.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*own, "lang_pred", "score"])

    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(own, docs.schema, strict=True))
    return docs.toDF(*own).mapInArrow(run, f"{kinds}, lang_pred string, score double").toDF(*names, "lang_pred", "score")
