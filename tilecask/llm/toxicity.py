"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another, from the particular to the general; each
model reads hashed words, beginnings of words and the probabilities of the categories before it.  While
training, those probabilities come from models that have not seen the row: every category
is fitted on ``FOLDS`` - 1 folds at a time and predicts the fold left out.

Labelled rows are drawn for training by a hash of their id, about ``POSITIVE`` toxic and
``NEGATIVE`` other ones; all other work covers all rows.  The last category is the label
itself; those before it are ``KINDS`` kinds of toxic rows, which are learned too: the toxic rows of the sample
are clustered by the features that toxic rows have more often than others.

A text without words, null and empty ones included, has probabilities of 0, as has every
text if there are no labelled rows of both kinds.  A row labelled more than once is toxic if one label
says so; null labels are none.  Repeated rows are scored each; columns other than id and
text are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .frames import modest_batches, pieces_of, utf8
from .shingles import LOWER, POWERS, words_of

FEATURES, FOLDS, POSITIVE, NEGATIVE = 1 << 18, 5, 1500, 3000
#: Texts of the sample that a feature must occur in.
LEAST = 4
PENALTY, EPOCHS = ftrl.Penalty(alpha=0.3, beta=1.0, l1=2.0, l2=0.1), 3
#: Bytes of a word's beginning that are features too, for inflected and compound words.
HEADS = (4, 5, 6, 7, 8)
#: Kinds of toxic rows that are categories of their own, and rounds of clustering.
KINDS, ROUNDS = 2, 20
#: Every ASCII byte that is no letter or digit parts words.
PARTED = bytes(32 if b < 128 and not chr(b).isalnum() else LOWER[b] for b in range(256))


def word_features(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct hashed words and beginnings of words of each text."""
    words, first = words_of(texts, PARTED, HEADS)
    at = (words >> np.uint64(64 - 18)).astype(np.int64)
    return [np.unique(at[a:b]) for a, b in zip(first, first[1:], strict=False)]


@dataclass
class Chain:
    categories: list[str]
    words: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """Of rows of word scores, a column for each category."""
        p = np.zeros_like(z)
        for k in range(z.shape[1]):
            if np.isfinite(self.bias[k]):  # else there was nothing to learn from
                p[:, k] = ftrl.sigmoid(z[:, k] + self.bias[k] + p[:, :k] @ self.earlier[k, :k])
        return p


def train_chain(rows: list[np.ndarray], targets: np.ndarray, categories: list[str], features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Models of each category on the words and on out-of-fold probabilities of those before it."""
    n, k = targets.shape
    fold = np.arange(n) % folds
    earlier, words, links, bias = np.zeros((n, k)), np.zeros((features, k)), np.zeros((k, k)), np.zeros(k)
    for c in range(k):
        extra = features + np.arange(c)
        own = [(np.append(at, extra), np.append(np.ones(len(at)), earlier[i, :c])) for i, at in enumerate(rows)]
        target = targets[:, c : c + 1]
        for f in range(folds) if c + 1 < k else ():
            seen, left = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w = ftrl.fit([own[i] for i in seen], target[seen], features + c, PENALTY, EPOCHS, many=False)
            earlier[left, c] = ftrl.sigmoid(ftrl.scores([own[i] for i in left], w)[:, 0])
        w = ftrl.fit(own, target, features + c, PENALTY, EPOCHS, many=False)[:, 0]
        words[:, c], links[c, :c], bias[c] = w[:features], w[features:-1], w[-1]
    return Chain(categories, words, links, bias)


def kinds_of(rows: list[np.ndarray], toxic: np.ndarray, kinds: int = KINDS, features: int = FEATURES, seed: int = 3) -> np.ndarray:
    """A column for each kind: spherical clusters of the toxic rows on telling features, weighted by how much more often toxic rows have them."""
    own = np.flatnonzero(toxic)
    seen = [np.bincount(np.concatenate([rows[i] for i in some] or [np.zeros(0, np.int64)]), minlength=features) for some in (own, np.flatnonzero(~toxic))]
    odds = np.log((seen[0] + 0.5) / (len(own) + 1)) - np.log((seen[1] + 0.5) / (len(rows) - len(own) + 1))
    telling = np.flatnonzero((odds > 1) & (seen[0] >= LEAST))
    slot = np.full(features, -1)
    slot[telling] = np.arange(len(telling))
    x = np.zeros((len(own), len(telling)))
    for k, i in enumerate(own):
        at = slot[rows[i]]
        x[k, at[at >= 0]] = odds[telling][at[at >= 0]]
    x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(own), size=1)]
    while len(centres) < kinds:  # the row that is least like those chosen is the next
        centres = np.vstack((centres, x[(x @ centres.T).max(1).argmin()]))
    for _ in range(ROUNDS):
        of = (x @ centres.T).argmax(1)
        centres = np.stack([x[of == k].sum(0) if (of == k).any() else centres[k] for k in range(kinds)])
        centres /= np.maximum(np.sqrt((centres * centres).sum(1)), 1e-12)[:, None]
    out = np.zeros((len(rows), kinds), bool)
    out[own, of] = True
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """A chain for the labelled rows of ``docs``."""
    modest_batches(docs.sparkSession)
    categories = [*(f"kind_{k + 1}" for k in range(KINDS)), label_col]
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return Chain(categories, np.zeros((FEATURES, len(categories))), np.zeros((len(categories),) * 2), np.full(len(categories), -np.inf))
    share = F.when(F.col("toxic") == 1, POSITIVE / sizes[1]).otherwise(NEGATIVE / sizes[0])
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    drawn = drawn.limit(2 * (POSITIVE + NEGATIVE))  # a bound on what is broadcast; half of it is expected

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", keep=POWERS):
            own = [a.astype("<u4").tobytes() for a in word_features(utf8(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("toxic"), pa.array(own, pa.binary())], ["id", "toxic", "at"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(drawn), "id").select("id", "text", "toxic").mapInArrow(features, "id string, toxic int, at binary").limit(2 * (POSITIVE + NEGATIVE)).collect()
    sample.sort(key=lambda r: (r["id"], r["at"]))
    rows = [np.frombuffer(r["at"], "<u4").astype(np.int64) for r in sample]
    toxic = np.array([r["toxic"] == 1 for r in sample])
    seen = np.bincount(np.concatenate(rows), minlength=FEATURES)
    rows = [at[seen[at] >= LEAST] for at in rows]
    return train_chain(rows, np.column_stack((kinds_of(rows, toxic), toxic)).astype(float), categories)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(id, a probability for each category, is_toxic)``; the last category decides."""
    modest_batches(docs.sparkSession)
    used = np.flatnonzero((chain.words != 0).any(1))
    slot = np.full(FEATURES, -1)
    slot[used] = np.arange(len(used))
    weights, names = chain.words[used], [f"p_{c}" for c in chain.categories]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", keep=POWERS):
            words, first = words_of(utf8(batch.column("text")), PARTED, HEADS)
            at = slot[(words >> np.uint64(64 - 18)).astype(np.int64)]
            word, column = np.nonzero(at >= 0)
            row = np.searchsorted(first, word, side="right") - 1
            key = np.unique(row * len(used) + at[word, column])
            z = np.zeros((batch.num_rows, len(names)))
            np.add.at(z, key // max(1, len(used)), weights[key % max(1, len(used))])
            p = chain.probabilities(z)
            p[first[1:] == first[:-1]] = 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold)], ["id", *names, "is_toxic"])

    schema = f"id {kind}, {', '.join(f'`{n}` double' for n in names)}, is_toxic boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
