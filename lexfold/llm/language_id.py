"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of the sampled texts into hash buckets, per
language.  The smoothed log-probabilities form a matrix of fixed width
(buckets) with a column for each language, which is broadcast; a batch of texts is
scored at once, as the product of its sparse counts with the matrix: the rows of
all its n-grams are gathered and summed per text.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so
is every text if nothing could be learned; a null language is never learned
from; equal scores go to the language that sorts first; repeated rows
repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfold.llm.common import over_batches, small_batches

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Labelled texts of each language that are learned from, about; where there are more, a hash of the text and the id chooses.
TRAINING_TEXTS = 4000
#: Added to every count.
SMOOTHING = 0.5
#: A classifier for more languages than this is refused, as its matrix is broadcast.
MOST_LANGUAGES = 500
#: A text is foreign if each of its n-grams has, on average, less than this share of the log-odds over chance that learned n-grams have,
FLUENT_SHARE = 1 / 3
#: and if that is no chance of a short text: the odds against it in nats.
FOREIGN_NATS = 14.0
#: Characters scored at once.
PIECE = 1 << 17
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_IS_LETTER: list[np.ndarray] = []


def characters(text: str) -> np.ndarray | None:
    """Code points of the lower-cased text, each run of other characters than letters one space; None without a letter."""
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _IS_LETTER[0][points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[32], np.where(letter, points, 32)[keep]]).astype(np.uint32)


def features(points: np.ndarray, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all n-grams of each order."""
    out = []
    for n in orders:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(16))
    found = np.concatenate(out) if out else np.zeros(0, np.uint32)
    return found % np.uint32(buckets) if buckets != 1 << 16 else found


def bucket_counts(text: str, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> np.ndarray | None:
    points = characters(text)
    if points is None:
        return None
    counts = np.zeros(buckets, np.int64)
    for k in range(0, len(points), PIECE):
        # n-grams that begin in the piece
        for n in orders:
            counts += np.bincount(features(points[k : k + PIECE + n - 1], (n,), buckets), minlength=buckets)
    return counts


@dataclass
class Classifier:
    """log_p: [bucket, language] log-probabilities; log_prior: [language]; typical: [language] mean log-probability of a learned n-gram."""

    languages: list[str]
    log_p: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...] = ORDERS
    typical: np.ndarray | None = None

    def totals(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[text, language]: the log-probabilities of all n-grams of each text, as the product of the batch's sparse counts with the matrix.

        ``points`` are the characters of all texts, ``sizes`` their numbers.
        """
        buckets, n_texts = len(self.log_p), len(sizes)
        out = np.tile(self.log_prior.astype(np.float64), (n_texts, 1))
        ends = np.cumsum(sizes)
        at_once = max(1, min(PIECE, (PIECE << 5) // max(1, len(self.languages))))
        for k in range(0, len(points), at_once):
            first, last = np.searchsorted(ends, (k, min(k + at_once, len(points)) - 1), side="right")
            inside = ends[first : last + 1]
            for n in self.orders:
                found = features(points[k : k + at_once + n - 1], (n,), buckets)
                text = np.repeat(np.arange(first, last + 1), np.diff(np.minimum(inside - k, len(found)), prepend=0))
                whole = np.arange(k + n, k + n + len(found)) <= ends[text]  # not across the end of a text
                found, text = found[whole], text[whole]
                if not len(found):
                    continue
                if text[0] == text[-1] and len(found) > 4096:  # of one text each bucket's row is taken once
                    counts = np.bincount(found, minlength=buckets)
                    seen = np.nonzero(counts)[0]
                    out[text[0]] += counts[seen] @ self.log_p[seen].astype(np.float64)
                    continue
                begin = np.nonzero(np.concatenate([[True], text[1:] != text[:-1]]))[0]
                out[text[begin]] += np.add.reduceat(self.log_p[found].astype(np.float64), begin, axis=0)
        return out

    def scores(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """The likeliest language of each text and its posterior probability."""
        return ((lang, score) for lang, score, _ in self.judged(texts))

    def judged(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """The likeliest language of each text, its posterior probability, and whether the text is foreign to that language as well.

        The posterior only weighs the learned languages against each other, and is 1 for any long text.  Foreign
        means that even the likeliest language explains the n-grams hardly better than equally likely buckets do.
        """
        points = [characters(t) if t and self.languages else None for t in texts]
        lettered = [p for p in points if p is not None]
        if lettered:
            sizes = np.array([len(p) for p in lettered])
            total = self.totals(np.concatenate(lettered), sizes)
            best = np.argmax(total, axis=1)
            foreign = np.zeros(len(best), bool)
            if self.typical is not None:
                chance = np.log(len(self.log_p))
                n = sum(np.maximum(0, sizes - k + 1) for k in self.orders)
                explained = total[np.arange(len(best)), best] - self.log_prior[best] + n * chance
                foreign = explained < FLUENT_SHARE * n * (self.typical[best] + chance) - FOREIGN_NATS
            away = total - total[np.arange(len(best)), best][:, None]
            score = 1 / np.exp(np.clip(away, -700, 0)).sum(axis=1)
            found = zip((self.languages[b] for b in best.tolist()), score.tolist(), foreign.tolist())
        for p in points:
            yield (UNDETERMINED, 0.0, True) if p is None else next(found)


def train(df: DataFrame, label: str = "lang", text: str = "text", id: str = "doc_id", training_texts: int = TRAINING_TEXTS, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> Classifier:
    """Fit on the labelled rows of ``df``, at most about ``training_texts`` of each language."""
    small_batches(df.sparkSession)
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r.label: r.n for r in rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Classifier([], np.zeros((buckets, 0), np.float32), np.zeros(0), orders)
    share: Column = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, training_texts / sizes[k])))])[F.col(label)]
    chosen = rows.where(F.pmod(F.xxhash64(F.col(id), F.col(text)), F.lit(1 << 20)) < share * (1 << 20)).select(F.col(label).alias("label"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = bucket_counts(t, orders, buckets)
                if found is not None:
                    if lang in counts:
                        counts[lang] += found
                    else:
                        counts[lang] = found
        for lang, x in counts.items():
            seen = np.nonzero(x)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(x[seen])], names=["label", "bucket", "n"])

    total = over_batches(chosen, run, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    # at most MOST_LANGUAGES * buckets numbers
    table = total.groupBy("label").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    matrix = np.zeros((buckets, len(languages)))
    for r in table.toLocalIterator():
        matrix[np.array(r.b, np.int64), languages.index(r.label)] = r.n
    log_p = (np.log(matrix + SMOOTHING) - np.log(matrix.sum(axis=0) + SMOOTHING * buckets)).astype(np.float32)
    prior = np.array([sizes[k] for k in languages], float)
    typical = (matrix * log_p).sum(axis=0) / np.maximum(1, matrix.sum(axis=0))
    return Classifier(languages, log_p, np.log(prior / prior.sum()), orders, typical)


def predict(df: DataFrame, model: Classifier, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its text alone."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.log_prior, model.orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Classifier(*shared.value)
        for b in batches:
            found = list(held.scores(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[id, "lang_pred", "score"])

    picked = df.select(id, text)
    return over_batches(picked, run, f"`{id}` {picked.schema[0].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Classifier, least: float, text: str = "text") -> DataFrame:
    """The rows of ``df``, whole, whose language is determined with a score of ``least`` or more and that are not foreign to it."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.log_prior, model.orders, model.typical))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Classifier(*shared.value)
        for b in batches:
            yield b.filter(pa.array([not foreign and p >= least for _, p, foreign in held.judged(b.column(at).to_pylist())], pa.bool_()))

    return over_batches(df, run, df.schema)
