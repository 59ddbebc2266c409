"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text becomes its letters in lower case with one separator wherever other signs stood, and its n-grams of one to three
signs are hashed to `BUCKETS` numbers. Fitting adds up n-gram counts per language over a bounded seeded sample of labelled
rows: of `fit_rows` rows every language gives the same number, or all it has if they are fewer, whose rest goes to the others.
Priors come from all labelled rows; a language without an n-gram in the sample is not predicted. The smoothed log-probabilities form one matrix of buckets by languages, which is broadcast. Scoring adds
matrix rows per text in numpy.

Bounds: the matrix has BUCKETS x languages cells of four bytes and at most `MOST_LANGUAGES` languages (more raise an error,
because they are then not languages). Texts of any length are scored whole, `PIECE` signs at a time.

Defined cases: NULL text or a text without a letter is `und` with score 0; ties go to the first label in order; repeated rows
count each time; without a labelled row every text is `und`; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MOST_LANGUAGES = 256
PIECE = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Of every code point whether it is a letter; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def signs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Signs of all texts behind one another, and the number of the text each belongs to."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(t + "\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lowered)), sizes + 1)
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                      # one separator behind each run of letters
    first = np.r_[0, np.cumsum(sizes + 1)[:-1]].astype(np.int64)
    keep[first[first < len(keep)]] |= letter[first[first < len(keep)]]
    return np.where(letter, codes, 32)[keep], owner[keep]


def grams(code: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, owner) of all n-grams inside one text, at most PIECE starts at a time."""
    for start in range(0, len(code), PIECE):
        for n in ORDERS:
            stop = min(start + PIECE, len(code) - n + 1)
            if stop <= start:
                continue
            h = np.full(stop - start, n, np.uint32)
            for k in range(n):
                h = (h ^ code[start + k:stop + k].astype(np.uint32)) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            own = owner[start:stop]
            inside = own == owner[start + n - 1:stop + n - 1]
            yield (h % np.uint32(BUCKETS))[inside], own[inside]


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows of about PIECE signs."""
    texts = batch.column(column).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


class Model:
    """Labels and the matrix log P(bucket | label), with log priors."""

    def __init__(self, labels: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.labels, self.matrix, self.prior = labels, matrix, prior

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.labels:
            return ["und"] * len(texts), [0.0] * len(texts)
        code, owner = signs(texts)
        total = np.tile(self.prior, (len(texts), 1))
        for bucket, own in grams(code, owner):
            if len(own):
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[starts]] += np.add.reduceat(self.matrix[bucket], starts, axis=0, dtype=np.float64)
        best = total.argmax(1)
        share = np.exp(total - total.max(1, keepdims=True))
        score = share.max(1) / share.sum(1)
        some = np.bincount(owner, minlength=len(texts)) > 0
        return ([self.labels[b] if s else "und" for b, s in zip(best, some)], np.where(some, score, 0.0).tolist())


def level(counts: list[int], rows: int) -> float:
    """The number of rows of each language, or all of a smaller one, that makes `rows` together; at least 1."""
    left = float(rows)
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) > left:
            return max(1.0, left / (len(counts) - i))
        left -= n
    return float(max(counts, default=1))


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *,
        fit_rows: int = 60_000, smoothing: float = 0.5, seed: int = 3) -> Model:
    """A model of the rows for which `learn` holds, from about `fit_rows` of them at most, drawn per language (`level`) by a
    hash of the id, or of the text where the id is NULL."""
    spark = docs.sparkSession
    rows = docs.filter(learn & F.col(lang).isNotNull())
    own = F.xxhash64(F.col(doc_id), F.lit(seed), F.when(F.col(doc_id).isNull(), F.col(text)))
    d = rows.filter(F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), own.bitwiseAND(F.lit((1 << 31) - 1)).alias("h"))
    labelled = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"), F.count(F.col(text)).alias("texts")).limit(MOST_LANGUAGES + 1).collect()
    if len(labelled) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    labelled = sorted((r for r in labelled if r["texts"]), key=lambda r: r["lang"])
    labels = [r["lang"] for r in labelled]
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    each = level([r["texts"] for r in labelled], fit_rows)
    below = F.create_map(*[F.lit(x) for r in labelled for x in (r["lang"], int(min(1.0, each / r["texts"]) * (1 << 31)))])
    number = {v: i for i, v in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(len(labels) * BUCKETS, np.int64)
        for batch in batches:
            langs = np.array([number[v] for v in batch.column("lang").to_pylist()], np.int64)
            for start, texts in _pieces(batch, "text"):
                for bucket, own in grams(*signs(texts)):
                    cells += np.bincount(langs[start + own] * BUCKETS + bucket, minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

    sample = d.filter(F.col("h") < F.element_at(below, F.col("lang"))).select("lang", "text")
    counted = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = counted.toPandas()                     # at most one row per cell of the matrix
    cells = np.zeros(len(labels) * BUCKETS)
    cells[got["cell"].to_numpy(np.int64)] = got["n"]
    cells = cells.reshape(len(labels), BUCKETS)
    seen = cells.any(1)
    cells = cells[seen] + smoothing
    prior = np.array([r["n"] for r in labelled], float)[seen]
    return Model([v for v, s in zip(labels, seen) if s], np.log(cells / cells.sum(1, keepdims=True)).T.astype(np.float32).copy(), np.log(prior / prior.sum()))


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every row, lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels: list[str] = []
            scores: list[float] = []
            for _, texts in _pieces(batch, "_text"):
                a, b = sent.value.score(texts)
                labels += a
                scores += b
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(score, f"{schema}, lang_pred string, score double")
