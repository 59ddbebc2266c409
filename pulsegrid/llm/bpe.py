"""Byte-pair encoding and decoding over a table of distinct words.

A word is a run of signs without white space; the tokenizers this is for never let a token span white space, so the ids of
a text are the ids of its words in order. A word of plain letters is taken in lower case and without the points behind it,
which such a tokenizer encodes on their own. Every distinct word is encoded once:

* the most frequent words of a bounded sample (`HOT_WORDS`) are encoded first and broadcast; they cover most positions,
* every text is split once, into the numbers of its frequent words and a list of its other words, and dealt by document,
* the other words go from there, once for each document, as (word, document, number), to the task of their word, where a run of
  equal words is encoded once; their ids travel back to the document and are joined in by that number.

Both steps behind the split read one exchange, which Spark reuses; were it not reused, only time would be lost. So neither a frequent word nor a long tail of rare ones meets in one place. Decoding looks every id up in the id-to-piece
table, which is as long as the vocabulary.

Bounds: the broadcast has at most `HOT_WORDS` words of at most `HOT_LENGTH` signs; which words it holds changes the work,
never the result. A worker remembers up to `MEMO` written forms. Texts are encoded whole; what is shuffled of them are packed word numbers
and other words. Ids are put together for documents of `CODES` bytes of word numbers at a time, or one longer document.

Defined cases: NULL text is empty and has no ids; documents are told apart by id and, if any id stands more than once, a 64-bit hash of
their text, so repeated ids and repeated rows are right; ties between equally frequent words go to the smaller one and change no result; special tokens inside a text are found as the library finds them; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer


HOT_WORDS = 1 << 19
HOT_LENGTH = 40
SAMPLE_ROWS = 15_000
RARE = bytes(1)
MEMO = 100_000
ROWS = 1000     # rows handled at a time
CODES = 1 << 19
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

_made: dict[int, Tokenizer] = {}
_known: dict[str, Known] = {}


def _library(spec: str) -> Tokenizer:
    """One per worker."""
    key = hash(spec)
    if key not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # tasks are the threads here
        _made.clear()
        _made[key] = Tokenizer.from_str(spec)
    return _made[key]


def _encoded(spec: str, words: list[str], kind: str) -> list[bytes]:
    """Ids of distinct words as bytes of `kind`."""
    return [np.array(e.ids, kind).tobytes() for e in _library(spec).encode_batch_fast(words, add_special_tokens=False)]


def units(word: str) -> tuple[str, str]:
    """The word that is encoded for a written form, and the points encoded behind it."""
    m = PLAIN.fullmatch(word)
    return (m[1].lower(), m[2]) if m else (word, "")


def numbers(n: int) -> list[bytes]:
    """1 to n, below 2^21, seven bits a byte, so that frequent words, whose numbers are small, take one or two."""
    one, two = min(n, 127), min(n, 16383)
    return ([bytes((i,)) for i in range(1, one + 1)] + [bytes((i & 127 | 128, i >> 7)) for i in range(128, two + 1)]
            + [bytes((i & 127 | 128, i >> 7 & 127 | 128, i >> 14)) for i in range(16384, n + 1)])


class Known:
    """Codes of written forms by the broadcast words: the number of the word from 1, 0 for a rare one; a word with points behind
    it has two. A written form that is its own word has the code of that word, so one table holds both."""

    def __init__(self, hot: list[bytes]):
        self.forms, self.room = dict(zip(hot, numbers(len(hot)))), MEMO

    def codes(self, text: bytes) -> tuple[bytes, list[bytes]]:
        """Codes of a text, and its rare words in order."""
        forms = text.split()        # bytes are split at the white space of WORD
        parts = list(map(self.forms.get, forms))
        rare = []
        for i in [i for i, p in enumerate(parts) if p is None]:
            word, points = (x.encode() for x in units(forms[i].decode()))
            behind = self.forms.get(points) if points else b""
            if behind is None:
                word, behind = forms[i], b""
            own = self.forms.get(word)
            if own is None:
                rare.append(word)
                parts[i] = RARE + behind
            else:
                parts[i] = own + behind
                if self.room:
                    self.room -= 1
                    self.forms[forms[i]] = parts[i]
        return b"".join(parts), rare


def _known_of(key: str, hot) -> Known:
    """One per worker; `key` names the broadcast words `hot`."""
    if key not in _known:
        _known.clear()
        _known[key] = Known(hot.value)
    return _known[key]


def pack(codes: bytes, rare: list[bytes], by: zstandard.ZstdCompressor) -> bytes:
    return by.compress(len(codes).to_bytes(8, "little") + codes + b" ".join(rare))


def unpack(packed: bytes, by: zstandard.ZstdDecompressor) -> tuple[bytes, bytes]:
    """Codes and rare words, with a blank between them."""
    raw = by.decompress(packed)
    end = 8 + int.from_bytes(raw[:8], "little")
    return raw[8:end], raw[end:]


def unnumbered(codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in the codes, and where the last byte of each stands."""
    b = np.frombuffer(codes, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.r_[0, last[:-1] + 1][:len(last)]
    out = (b[first] & 127).astype(np.int32)
    for k in (1, 2):
        more = np.flatnonzero(last - first >= k)
        out[more] |= (b[first[more] + k] & 127).astype(np.int32) << 7 * k
    return out, last


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every run, one run after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _put_together(codes: list[bytes], words: list[list[bytes]], fills: list[list[bytes]], hot: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes]:
    """Ids of documents, by their codes, their rare words, the numbered ids of these and the ids and ends of the frequent ones."""
    ids, ends = hot
    number, last = unnumbered(b"".join(codes))
    # of each document the first code, and one more
    at = np.searchsorted(last, np.cumsum([0, *map(len, codes)]))
    holes, rare = np.flatnonzero(number == 0), []
    for own, found in zip(words, fills):
        given = {int.from_bytes(f[:4], "little"): f[4:] for f in found or ()}
        number_of = {w: k for k, w in enumerate(dict.fromkeys(own))}
        if len(given) != len(number_of):
            raise ValueError("ids of some words did not come back")
        rare += [given[number_of[w]] for w in own]
    begin, size = ends[number - 1], ends[number] - ends[number - 1]
    size[holes] = np.array([len(r) // ids.itemsize for r in rare], np.int64)
    begin[holes] = len(ids) + np.cumsum(size[holes]) - size[holes]
    whole = np.concatenate([ids, np.frombuffer(b"".join(rare), ids.dtype)])[_runs(begin, size)].astype("<u4")
    cut = np.r_[0, np.cumsum(size)][at].tolist()
    return (whole[a:b].tobytes() for a, b in zip(cut, cut[1:]))


def check_tokenizer(spec: str) -> None:
    """Refuse tokenizers whose tokens may span white space or whose decoder is not a join of pieces."""
    told = json.loads(spec)
    spans = "".join(json.dumps(told.get(k)) for k in ("pre_tokenizer", "normalizer"))
    if told.get("decoder") is not None or '"invert": true' not in spans or "Metaspace" in spans or any(t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
        raise ValueError("words of this tokenizer are not its own units, or it has a decoder")


def pieces(spec: str) -> list[str]:
    """The id-to-piece table."""
    told = json.loads(spec)
    named = {**told["model"]["vocab"], **{t["content"]: t["id"] for t in told["added_tokens"]}}
    out = [""] * (max(named.values()) + 1)
    for piece, i in named.items():
        out[i] = piece
    return out


def hot_words(docs: DataFrame, rows: int, text: str, spec, kind: str, n: int = HOT_WORDS, sample_rows: int = SAMPLE_ROWS) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray]]:
    """The most frequent words of about `sample_rows` of the `rows` documents, with their ids: these one after the other, and where
    those of each word end, after a 0."""
    share = min(1.0, sample_rows / max(1, rows))
    picked = docs.filter(F.xxhash64(F.col(text)).bitwiseAND(F.lit((1 << 31) - 1)) < F.lit(int(share * (1 << 31))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter()
            for x in batch.column(0).to_pylist():
                n.update(WORD.findall(x))
            out = Counter()
            for form, k in n.items():
                for word in units(form):
                    if 0 < len(word) <= HOT_LENGTH:
                        out[word] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["word", "n"])

    words = picked.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.col("n").desc(), "word").limit(n).select("word")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(_encoded(spec.value, words, kind), pa.binary())], ["word", "ids"])

    got = top.repartition(8).mapInArrow(encode, "word string, ids binary").toArrow()
    coded = got.column("ids").to_pylist()
    ends = np.cumsum([0, *map(len, coded)]) // np.dtype(kind).itemsize
    return got.column("word").cast(pa.binary()).to_pylist(), (np.frombuffer(b"".join(coded), kind), ends)


def _tag(text: bytes) -> int:
    """A hash of the text in 64 bits."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _no_tag(text: bytes) -> int:
    return 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def encode(docs: DataFrame, tokenizer: str, keep: list[str], doc_id: str = "doc_id", text: str = "text", *,
           hot: int = HOT_WORDS, sample_rows: int = SAMPLE_ROWS, ids: bool = True, digests: bool = False) -> DataFrame:
    """Columns `keep` and ids (binary, little-endian unsigned 32 bits) of every row; with `digests` also n_tokens, ids_sha256
    and decoded_sha256, made where the ids are. Without `ids` these are not moved.

    `tokenizer`: path of a tokenizer file on the driver; its content is broadcast.
    """
    with open(tokenizer, encoding="utf-8") as f:
        text_of = f.read()
    check_tokenizer(text_of)
    if hot >= 1 << 21:
        raise ValueError("word numbers are packed in 21 bits")
    sc = docs.sparkSession.sparkContext
    spec, names_of_ids = sc.broadcast(text_of), pieces(text_of)
    kind = "<u2" if len(names_of_ids) <= 1 << 16 else "<u4"
    whole_number = isinstance(docs.schema[doc_id].dataType, T.IntegralType)
    own = F.coalesce(F.col(doc_id).cast("long") if whole_number else F.xxhash64(F.col(doc_id)), F.xxhash64(F.col(text)))
    d = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], own.alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = [f"_k{i}" for i in range(len(keep))]
    rows, keys = d.agg(F.count("*"), F.count_distinct("_id")).first()
    # an id that stands once needs no more to tell its document
    tag_of = _tag if keys < rows else _no_tag
    words, coded = hot_words(d, rows, "_text", spec, kind, hot, sample_rows)
    words, coded = sc.broadcast(words), sc.broadcast(coded)
    key = uuid.uuid4().hex

    def known_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by = _known_of(key, words), zstandard.ZstdCompressor(3)
        for batch in _slices(batches):
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            packed = [pack(*known.codes(x), by) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names) + 1], pa.array(map(tag_of, texts), pa.int64()), pa.array(packed, pa.binary())],
                                             [*names, "_id", "_tag", "_packed"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.select(*names).schema)
    first = d.mapInArrow(known_codes, f"{kinds}_id long, _tag long, _packed binary")

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            # of equal rows one asks for its words
            batch = batch.filter(pc.equal(batch.column("_nth"), 1))
            lists = [list(dict.fromkeys(unpack(x, by)[1].split())) for x in batch.column("_packed").to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            row, tag = (np.repeat(batch.column(c).to_numpy(), n) for c in ("_id", "_tag"))
            at = _runs(np.zeros(len(n), np.int64), n).astype(np.int32)
            word = pa.array([w for x in lists for w in x], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([word, pa.array(row, pa.int64()), pa.array(tag, pa.int64()), pa.array(at, pa.int32())], ["word", "id", "tag", "at"])

    def rare_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, b""
        for batch in batches:
            runs = batch.column("word").to_pylist()
            coded = iter(_encoded(spec.value, [w for w, v in zip(runs, [last, *runs]) if w != v], kind))
            out = []
            for w, at in zip(runs, batch.column("at").to_pylist()):
                if w != last:
                    last, ids = w, next(coded)
                out.append(at.to_bytes(4, "little") + ids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(out, pa.binary())], ["id", "tag", "fill"])

    # all columns of `first` are read here and in the join below, and both need it dealt by document: one exchange
    nth = F.row_number().over(Window.partitionBy("_id", "_tag").orderBy("_tag"))
    rare = (first.withColumn("_nth", nth).mapInArrow(missing, "word string, id long, tag long, at int")
            .repartition("word").sortWithinPartitions("word").mapInArrow(rare_ids, "id long, tag long, fill binary"))
    fills = rare.groupBy("id", "tag").agg(F.collect_list("fill").alias("fills"))

    added = "ids binary" + ", n_tokens long, ids_sha256 string, decoded_sha256 string" * digests

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            out, codes, rare, fills, held = [], [], [], [], 0
            for packed, found in zip(batch.column("_packed").to_pylist(), batch.column("fills").to_pylist()):
                known, others = unpack(packed, by)
                codes.append(known)
                rare.append(others.split())
                fills.append(found)
                held += len(known)
                if held >= CODES:
                    out += _put_together(codes, rare, fills, coded.value)
                    codes, rare, fills, held = [], [], [], 0
            out += _put_together(codes, rare, fills, coded.value)
            columns = [pa.array(out, pa.binary())]
            if digests:
                columns += [pa.array([len(b) // 4 for b in out], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in out], pa.string()),
                            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts_of(out, names_of_ids)], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], *columns], [*names, *[c.split()[0] for c in added.split(", ")]])

    def packed_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches):
            yield batch.drop_columns(["ids"])

    whole = first.join(fills.hint("merge"), (F.col("_id") == F.col("id")) & (F.col("_tag") == F.col("tag")), "left").select(*names, "_packed", "fills")
    done = whole.mapInArrow(joined, kinds + added) if ids else whole.mapInArrow(packed_only, kinds + added.partition(", ")[2])
    return done.select(*[F.col(a).alias(b) for a, b in zip(names, keep)], *[c for c in done.columns if c not in names])


def texts_of(ids: list[bytes], table: list[str]) -> Iterator[str]:
    """Decoded texts: the pieces of the ids, by the id-to-piece table."""
    for packed in ids:
        yield " ".join(map(table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def decode(rows: DataFrame, tokenizer: str, keep: list[str]) -> DataFrame:
    """Columns `keep` and decoded, the text of `ids`."""
    with open(tokenizer, encoding="utf-8") as f:
        text_of = f.read()
    check_tokenizer(text_of)
    table = rows.sparkSession.sparkContext.broadcast(pieces(text_of))
    d = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("ids").alias("_ids"))
    names = [f"_k{i}" for i in range(len(keep))]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = list(texts_of(batch.column("_ids").to_pylist(), table.value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names, "decoded"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.select(*names).schema)
    return d.mapInArrow(back, f"{kinds}decoded string").select(*[F.col(a).alias(b) for a, b in zip(names, keep)], "decoded")
