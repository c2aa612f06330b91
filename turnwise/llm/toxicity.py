"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into
windows of words; each window is compressed with either dictionary, and the bytes that the toxic one
saves are its distance. The largest distance, the windows beyond the calibrated one and the sum are
turned into a score by a calibrated logistic curve.

Words enter the compressor as fixed-width codes, so that a match is always a whole known word, and
dictionaries are trained on the words that are much more frequent in their class than in the other:
what both share costs the same in both and would only add noise.
"""
import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import whole

CODE = 16  # bytes of a word's code
WINDOW = 32  # words of a window
DICTIONARY = 4096  # bytes
PER_CLASS = 3000  # labelled documents of a class that are read to fit
MAX_CHARS = 50_000  # of a longer document the fit reads PIECES pieces, spread evenly from its start to its end; scoring reads whole texts
PIECES = 20
LIKELIER = (2.0, 8.0)  # times as frequent as in the other class: ordinary, toxic words
WORDS = re.compile(r"[^\W\d_]+")
FOLDS = 4
CACHED = 200_000


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    beyond: float  # windows with more saved bytes count
    weights: tuple[float, ...]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_codes: dict[str, bytes] = {}


def _code(word: str) -> bytes:
    code = _codes.get(word)
    if code is None:
        if len(_codes) >= CACHED:
            _codes.clear()
        code = _codes[word] = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=CODE).digest()
    return code


@lru_cache(maxsize=2)  # a model's two
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    made = zstandard.ZstdCompressionDict(dictionary)
    made.precompute_compress(level=3)
    return zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


def distances(text: str, ordinary: bytes, toxic: bytes) -> list[int]:
    """Bytes that the toxic dictionary saves against the ordinary one, by window of the whole text."""
    plain, bad = _compressor(ordinary), _compressor(toxic)
    coded = b"".join(map(_code, WORDS.findall(text.lower())))
    step = WINDOW * CODE
    return [len(plain.compress(part)) - len(bad.compress(part)) for part in (coded[i:i + step] for i in range(0, len(coded), step))]


def _features(saved: list[int], beyond: float) -> list[float]:
    over = [x for x in saved if x > beyond]
    return [1.0, max(saved, default=0) / 10, math.log1p(len(over)), math.log1p(sum(over)), math.log1p(len(saved))]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the distinct codes themselves where there is too little to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=2 * CODE, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        codes = Counter(s[i:i + CODE] for s in samples for i in range(0, len(s), CODE))
        return b"".join(c for c, _ in sorted(codes.items(), key=lambda x: (x[1], x[0]))[-DICTIONARY // CODE:])


def _distinct(texts: list[str]) -> list[tuple[str, list[str]]]:
    """Texts with their words, without near copies of an earlier one: copies would make their rare words look typical.

    A word that many texts hold is one object: the fit runs on the driver, where a string for each of its places takes most of the memory.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        found = WORDS.findall(text.lower())
        grams = {zlib.crc32(" ".join(found[i:i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(found) - 4))}
        marks = {(k, min(g * k & 0xFFFFFFFF for g in grams)) for k in (2654435761, 2246822519)}
        if not marks & seen:
            out.append((text, list(map(sys.intern, dict.fromkeys(found)))))
        seen |= marks
    return out


def _dictionaries(lists: list[list[list[str]]]) -> tuple[bytes, bytes]:
    """Of the ordinary and the toxic word lists, each of the words typical of its class."""
    found = [Counter(w for doc in docs for w in doc) for docs in lists]
    rate = lambda c, w: (found[c][w] + 0.5) / max(1, len(lists[c]))
    out = []
    for c in (0, 1):
        least = max(min(3, len(lists[c])), 0.01 * len(lists[c]))
        typical = {w for w, n in found[c].items() if n >= least and rate(c, w) >= LIKELIER[c] * rate(1 - c, w)}
        out.append(_dictionary([b"".join(_code(w) for w in doc if w in typical) for doc in lists[c]]))
    return out[0], out[1]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.05)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * b
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        b = b - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return b


def train(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model:
    """Dictionaries from all texts; threshold and curve from what dictionaries of the other folds say of a fold."""
    if not toxic or not ordinary:
        level = math.log((toxic_share + 0.01) / (1 - toxic_share + 0.01))
        return Model(b"", b"", 0.0, (level, 0.0, 0.0, 0.0, 0.0))
    docs = [_distinct(ordinary), _distinct(toxic)]
    saved: list[list[list[int]]] = [[], []]
    for fold in range(FOLDS):
        made = _dictionaries([[w for i, (_, w) in enumerate(d) if i % FOLDS != fold] for d in docs])
        for c in (0, 1):
            saved[c] += [distances(t, *made) for i, (t, _) in enumerate(docs[c]) if i % FOLDS == fold]
    beyond = float(max(3, np.quantile([x for doc in saved[0] for x in doc] or [0], 0.995)))
    x = np.array([_features(s, beyond) for texts in saved for s in texts])
    y = np.repeat([0.0, 1.0], [len(s) for s in saved])
    share = min(max(toxic_share, 0.001), 0.999)
    weight = np.where(y == 1, share / len(saved[1]), (1 - share) / len(saved[0])) * len(y)
    return Model(*_dictionaries([[w for _, w in d] for d in docs]), beyond, tuple(float(b) for b in _logistic(x, y, weight)))


def score_text(text: str | None, model: Model) -> float:
    at = float(np.dot(_features(distances(text or "", model.ordinary, model.toxic), model.beyond), model.weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))


def fit_text(max_chars: int, text: str = "text", pieces: int = PIECES) -> Column:
    """What the fit reads of a text: all of it up to ``max_chars``, else that much in pieces of whole words, spread evenly."""
    n, size = F.char_length(text), max(1, max_chars // pieces)
    starts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.floor(i * (n - size) / max(1, pieces - 1)).cast("int") + 1)
    cut = F.transform(starts, lambda at: F.regexp_replace(F.substring(F.col(text), at, F.lit(size)), r"^\S*\s|\s\S*$", ""))
    return F.when(n <= max_chars, F.col(text)).otherwise(F.array_join(cut, " "))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """Learn from at most ``per_class`` labelled documents of either class that are not held out.

    The sample is chosen by hash from the narrow label table, so documents are neither shuffled nor
    gathered; what reaches the driver is bounded by ``per_class`` and ``max_chars`` (see ``fit_text``). Rows without a text or doc_id
    and labels other than 0 and 1 teach nothing; of labels that disagree the higher counts; equal texts count once; without rows of
    both classes every text gets one score, the share of toxic labels.
    """
    known = (labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("_h", F.xxhash64("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("toxic") == c).orderBy("_h", "doc_id").limit(per_class) for c in (0, 1)]
    rows = (documents.select("doc_id", "text").where(F.col("text").isNotNull())
            .join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("toxic", fit_text(max_chars).alias("text"), "_h", "doc_id").collect())
    texts = {c: list(dict.fromkeys(r["text"] for r in sorted(rows, key=lambda r: (r["_h"], r["doc_id"], r["text"])) if r["toxic"] == c)) for c in (0, 1)}
    return train(texts[1], texts[0], counts.get(1, 0) / max(1, sum(counts.values())))


def scores(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or above).

    A null text scores as an empty one. Equal texts score the same; rows are scored one by one, so
    repeated rows, extra columns and empty tables need no care. Columns named ``score`` and ``predicted`` are replaced.
    """
    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, model) for t in text], dtype="float64")

    return documents.withColumn("score", scored(whole())).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``documents`` scored by a model fitted to ``labels``; nulls, ties, repeated rows, empty tables and clashing names as in ``fit`` and ``scores``."""
    return scores(documents, fit(documents, labels), threshold)
