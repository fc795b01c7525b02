"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts, one of the words that toxic texts hold
more often than ordinary ones, one of ordinary text's words. A window is one word (lower case,
outer ASCII marks off, at most WORD characters), written REPEAT times because zstandard stores
what it can't shorten as it is. Its compressed lengths under both dictionaries fall into a cell;
the cell's weight is calibrated on labelled texts against dictionaries of others: the log ratio of the
shares of toxic and of ordinary texts with such a window. A text's score is a logistic function
of its largest weights. Lengths are kept per word, so a word is compressed once per worker.

Every word of a text counts. Null and empty texts have no window and get the score of none.
Without labelled rows of both classes every score is 0. Label rows that repeat an id count once
(toxic if any says so); null labels or ids are left out. Only text is an input of the score.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

WORD, REPEAT, LEVEL, TOP = 40, 3, 3, 4
#: Words whose weights a worker keeps.
MAX_WORDS = 100_000
#: Labelled rows per class that the model is fitted on, the first by a hash of their id.
SAMPLE = 3_000
THRESHOLD = 0.7
FOLDS, OVER = 4, 3.0
#: Words of the two dictionaries at most.
DICTIONARY, ORDINARY = 6_000, 60_000
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def words(text: str | None) -> list[str]:
    out = []
    for w in (text or "").lower().split():
        w = w.strip(_MARKS)
        if len(w) <= WORD:
            out.append(w)
        else:
            out += [w[i : i + WORD] for i in range(0, len(w), WORD)]
    return out


def _family(found: list[str]) -> int:
    """The same for most near copies of a text: its least hashed run of three words."""
    return min((zlib.crc32(" ".join(found[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(found) - 2))), default=0)


@dataclass
class Model:
    """Dictionaries, cell weights and coefficients; what the workers get."""

    toxic: bytes = b""
    ordinary: bytes = b""
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    coef: list[float] = field(default_factory=list)


class Scorer(dict):
    """Maps a word to the weight of its window."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.sides = model, []
        for data in (model.toxic, model.ordinary):
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            own.precompute_compress(compression_params=params)
            self.sides.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params))

    def cell(self, word: str) -> tuple[int, int]:
        data = f" {word} ".encode("utf-8", "replace") * REPEAT
        return len(self.sides[0].compress(data)), len(self.sides[1].compress(data))

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_WORDS:
            self.clear()
        got = self[word] = self.model.weights.get(self.cell(word), 0.0)
        return got

    def features(self, found: list[str]) -> list[float]:
        top = np.zeros(TOP)
        if found:
            w = np.fromiter(map(self.__getitem__, found), float, len(found))
            best = np.sort(w[np.argpartition(-w, TOP)[:TOP]] if len(w) > TOP else w)[::-1]
            top[: len(best)] = np.maximum(best, 0)
        return [1.0, *top.tolist(), math.log1p(len(found))]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(words(text)), self.model.coef))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


_last: list[tuple[bytes, Scorer]] = []


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of a model; the last one is kept."""
    key = hashlib.sha256(model.toxic + b"\0" + model.ordinary + repr((sorted(model.weights.items()), model.coef)).encode()).digest()
    if not _last or _last[0][0] != key:
        _last[:] = [(key, Scorer(model))]
    return _last[0][1]


def _model(toxic: Counter, n_toxic: int, plain: Counter, n_plain: int, frequency: Counter, dictionary_words: int, ordinary_words: int) -> Model:
    """Dictionaries from the counts of families that hold a word, toxic and plain ones, and the words' frequency in plain ones."""
    over = {w: (c / n_toxic) / ((plain[w] + 0.5) / n_plain) for w, c in toxic.items() if c >= 2}
    chosen = sorted((w for w, r in over.items() if r >= OVER), key=lambda w: (-toxic[w] * math.log(over[w]), w))[:dictionary_words]
    common = [w for w, c in sorted(frequency.items(), key=lambda x: (-x[1], x[0]))[:ordinary_words] if c > 0 and over.get(w, 0) < OVER]
    # zstandard reaches the end of a dictionary most cheaply
    join = lambda ws: (" " + " ".join(reversed(ws)) + " ").encode("utf-8", "replace")
    return Model(join(chosen), join(common))


def fit(texts: Iterable[str | None], toxic: Iterable[int], dictionary_words: int = DICTIONARY, ordinary_words: int = ORDINARY) -> Model:
    """A model of labelled texts, on the driver.

    The toxic dictionary holds at most `dictionary_words` words, the most telling ones, the
    ordinary one at most `ordinary_words`, the most frequent ones: zstandard's dictionaries are
    of bounded size. A word in neither still has its lengths and thereby a weight.

    Near copies form a family (see _family) and count once. The cells are calibrated on FOLDS
    folds of families, each against dictionaries of the other folds; then all make the dictionaries.
    """
    same: dict[str, str] = {}  # one string object per distinct word
    rows = [([same.setdefault(w, w) for w in words(t)], int(y)) for t, y in zip(texts, toxic, strict=True)]
    families: dict[tuple[int, int], Counter] = {}
    for found, y in rows:
        families.setdefault((_family(found), y), Counter()).update(found)
    n = [Counter(f % FOLDS for f, y in families if y == k) for k in (0, 1)]
    if min(len(n[0]), len(n[1])) < 2:
        return Model()
    df = {(k, y): Counter() for k in range(FOLDS) for y in (0, 1)}
    frequency = [Counter() for _ in range(FOLDS)]
    for (f, y), found in families.items():
        df[f % FOLDS, y].update(found.keys())
        if not y:
            frequency[f % FOLDS].update(found)
    total = [sum((df[k, y] for k in range(FOLDS)), Counter()) for y in (0, 1)]
    whole, size = sum(frequency, Counter()), [sum(n[y].values()) for y in (0, 1)]
    scorers, seen = [], [Counter(), Counter()]
    for k in range(FOLDS):
        left = [total[y] - df[k, y] for y in (0, 1)]
        scorer = Scorer(_model(left[1], max(1, size[1] - n[1][k]), left[0], max(1, size[0] - n[0][k]), whole - frequency[k], dictionary_words, ordinary_words))
        cells = {w: scorer.cell(w) for w in df[k, 0].keys() | df[k, 1].keys()}
        for (f, y), found in families.items():
            if f % FOLDS == k:
                seen[y].update({cells[w] for w in found})
        scorers.append((scorer, cells))
    weights = {}
    for c in seen[0].keys() | seen[1].keys():
        weights[c] = math.log((seen[1][c] + 1) / (seen[0][c] / size[0] * size[1] + 1))
    for scorer, cells in scorers:
        scorer.update({w: weights[c] for w, c in cells.items()})
    x = np.array([scorers[_family(found) % FOLDS][0].features(found) for found, _ in rows])
    model = _model(total[1], size[1], total[0], size[0], whole, dictionary_words, ordinary_words)
    model.weights = weights
    model.coef = _logistic(x, np.array([y for _, y in rows], float)).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients by Newton's method, classes weighted as in the sample."""
    b, own = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    own[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + own, x.T @ (y - p) - own @ b)
    return b


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, training: str = "true") -> DataFrame:
    """(text, toxic) of at most `per_class` labelled documents of each class, the first by a hash of doc_id."""
    once = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(training).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for y in (0, 1):
        part = once.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    # at most 2 * per_class rows
    texts = docs.select("doc_id", "text").join(F.broadcast(ids.withColumnRenamed("toxic", "_y")), "doc_id")
    one = Window.partitionBy("doc_id").orderBy("text")
    return texts.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("doc_id", "text", F.col("_y").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, training: str = "true") -> Model:
    rows = sorted(training_rows(docs, labels, per_class, training).toLocalIterator(), key=lambda r: r.doc_id, reverse=True)
    toxic = [r.toxic for r in reversed(rows)]
    return fit((rows.pop().text for _ in toxic), toxic)  # a text is let go once its words are taken


def add_scores(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with the toxicity score in [0, 1] of a text column."""
    if not model.coef:
        return df.withColumn(out, F.lit(0.0))
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded words

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(sent.value)
        for s in batches:
            yield s.map(scorer.score, na_action=None).astype(float)
        scorer.clear()  # the next task may be another operator's

    return df.withColumn(out, score(F.col(text)))
