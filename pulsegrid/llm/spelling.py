"""Spelling variants: words that differ by one sign, found with a bit-sliced position index.

The index of a block of words has, for every (position, letter), the set of words with that letter there, as bits of one
integer; words are numbered by falling count, so the lowest bit of a set is its most frequent word. A word is looked up by
reading its letters in turn. Four sets are carried along, for all words of the block at once: no error so far, one letter
replaced, one letter more in the indexed word (positions shifted by one forth) and one letter less (shifted by one back).

    replaced'  = replaced & index[i, c]  |  exact & ~index[i, c]
    longer'    = (longer | exact) & index[i + 1, c]      (exact before letter i: the further letter stands at i)
    shorter'   = shorter & index[i - 1, c]  |  exact     (letter i is the one that is missing)
    exact'     = exact & index[i, c]

What is left at the end and has the right length differs by exactly one sign.

Blocks. A pair of lengths m and m or m + 1 that differs by one sign agrees in its first m // 2 letters or in its last
m - m // 2. Every word goes to the blocks of its beginning and of its end, for m its length and its length less one, so that all
pairs meet, and what two blocks could both see is counted by the block of the beginning alone. Only what the words of a block do
not share is indexed. No pair is emitted: a word leaves a block with one row, how many words are near and the first of them.

Bounds: a block of more than `BLOCK` words is cut into tiles by a hash of the word; each tile indexes its own words and looks
up all words of the block, so the index of a task has at most about `BLOCK` words of any vocabulary. Counting keeps at most
`HELD` distinct words a task before it hands them on. Following forms to their roots takes as many joins as the logarithm of
the longest chain can need: counts double from form to form, so 6 joins are enough for all 64-bit counts.

Defined cases: NULL and empty texts have no words; a NULL doc_id is written as the empty text in front of the colon; repeated
rows count again (each row's words are drawn by its own doc_id); ties of the form go to the smaller word in code points; texts
are read whole, in pieces of `PIECE` bytes cut between words, so long ones need little memory; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.base import written

LEAST_LENGTH, LEAST_COUNT = 5, 3
DRAWN = 97          # one run in so many loses a letter
BLOCK = 1 << 15     # words indexed at a time
HELD = 200_000      # distinct words kept while counting
PIECE = 1 << 20

# letters of a run in Latin-1, which has all of them: A-Z in lower case, the others kept, every other sign a blank
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: bytes | None) -> Iterator[list[bytes]]:
    """Lower-cased runs of a UTF-8 text, in Latin-1 (one byte a letter), a piece of the text at a time."""
    if not text:
        return
    # signs outside Latin-1 become "?", which is no letter
    plain = text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def drawn(head: bytes, run: bytes) -> bytes:
    """The run, less one letter if the check sum of id and run says so. head: UTF-8 of the id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(head))
    if h % DRAWN:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """word and n, its occurrences in all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(n: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

        held: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for i, x in zip(batch.column("id"), batch.column("text")):
                head = ((i.as_py() or "") + ":").encode()
                for part in runs(x.as_py()):
                    for run, k in Counter(part).items():
                        word = drawn(head, run)
                        if len(word) >= least_length:
                            held[word] += k
                    if len(held) > HELD:
                        yield out(held)
                        held.clear()
        yield out(held)

    d = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("binary").alias("text"))
    return d.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """Bit sets over some words: per (position, letter) those that have it there, per length those that have it."""

    def __init__(self, words: list[str]):
        at, length = defaultdict(list), defaultdict(list)
        for k, w in enumerate(words):
            length[len(w)].append(k)
            for i, c in enumerate(w):
                at[i, c].append(k)
        self.all = (1 << len(words)) - 1
        self.at = {key: _bits(ks) for key, ks in at.items()}
        self.length = {n: _bits(ks) for n, ks in length.items()}

    def near(self, word: str) -> tuple[int, int, int, int]:
        """Sets of words at one replaced letter, one letter more, one letter less, and of those that begin with `word`."""
        at, none = self.at, 0
        exact, replaced, longer, shorter = self.all, 0, 0, 0
        for i, c in enumerate(word):
            here = at.get((i, c), none)
            longer = (longer | exact) & at.get((i + 1, c), none)
            shorter = shorter & at.get((i - 1, c), none) | exact
            replaced = replaced & here | exact & ~here
            exact &= here
            if not (exact | longer | shorter | replaced):
                return 0, 0, 0, 0
        n, length = len(word), self.length
        return (replaced & length.get(n, 0), (longer | exact) & length.get(n + 1, 0), shorter & length.get(n - 1, 0), exact)


def _bits(numbers: list[int]) -> int:
    """The integer with these bits; numbers rise."""
    if len(numbers) < 16:
        out = 0
        for k in numbers:
            out |= 1 << k
        return out
    b = bytearray(numbers[-1] // 8 + 1)
    for k in numbers:
        b[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(b, "little")


def _rest(word: str, m: int, end: bool) -> str:
    """What a word does not share with its block: all behind the first m // 2 letters, or all before the last m - m // 2."""
    return word[:len(word) - (m - m // 2)] if end else word[m // 2:]


class Block:
    """Words that share a beginning or an end, indexed by what they do not share. `own` come by falling count and rising spelling.

    Pairs have lengths m and m, or m and m + 1: a word of m letters is paired with both, one of m + 1 only with the shorter."""

    def __init__(self, m: int, end: bool, own: list[tuple[str, int]]):
        self.m, self.end, self.own = m, end, own
        self.index = Index([_rest(w, m, end) for w, _ in own])

    def row(self, word: str) -> list[tuple[str, int, int, str]]:
        """(word, near words, count and spelling of the first of them), or nothing. What shares its beginning too is left to
        the block of the beginning."""
        rest = _rest(word, self.m, self.end)
        replaced, longer, shorter, begins = self.index.near(rest)
        if len(word) == self.m:
            found = replaced | (longer & ~begins if self.end else longer)
        elif self.end and shorter:
            found = shorter & ~self.index.near(rest[:self.m // 2])[3]
        else:
            found = shorter
        if not found:
            return []
        first, n = self.own[(found & -found).bit_length() - 1]
        return [(word, found.bit_count(), n, first)]


def _rows(at: list | None, own: list[tuple[str, int]], looked_up: Block | None) -> list[tuple[str, int, int, str]]:
    """Rows of a tile's own words, if they are still to come."""
    if looked_up is not None or len(own) < 2:
        return []
    b = Block(*at[:2], own)
    return [r for w, _ in own for r in b.row(w)]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, near (struct n, word: the near word of largest n, ties to the smallest) of every word that has near ones.

    words: word, n, distinct."""
    m = F.col("m")
    sides = F.array(*[F.struct((F.length("word") - F.lit(d)).alias("m"), F.lit(e).alias("end")) for d in (0, 1) for e in (False, True)])
    shared = F.when(F.col("end"), F.right("word", m - F.floor(m / 2).cast("int"))).otherwise(F.left("word", F.floor(m / 2).cast("int")))
    placed = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.m", "s.end").withColumn("part", shared)
    key = ["m", "end", "part"]
    large = placed.groupBy(*key).agg(F.count("*").alias("size")).filter(F.col("size") > block)
    tiled = (placed.join(large, key, "left").withColumn("tiles", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int"))
             .select(*key, "word", "n", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
             .withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")) == F.col("tile")))
    whole = [*key, "tile"]
    sorted_ = tiled.repartition(*whole).sortWithinPartitions(*whole, F.col("own").desc(), F.col("n").desc(), "word")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            w, k, n, first = zip(*rows) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.string())],
                                              ["word", "n_near", "near_n", "near"])

        at, own, block_, rows = None, [], None, []
        for batch in batches:
            for word, n, mine, *key_ in zip(*(batch.column(c).to_pylist() for c in ["word", "n", "own", *whole])):
                if key_ != at:
                    rows += _rows(at, own, block_)
                    at, own, block_ = key_, [], None
                if mine:
                    own.append((word, n))
                elif own:
                    if block_ is None:      # own words come first
                        rows += _rows(at, own, None)
                        block_ = Block(*at[:2], own)
                    rows += block_.row(word)
                if len(rows) >= 10_000:
                    yield out(rows)
                    rows = []
        yield out(rows + _rows(at, own, block_))

    found = sorted_.select(*whole, "word", "n", "own").mapInArrow(search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.struct((-F.col("b.less")).alias("n"), F.col("b.word").alias("word")).alias("near"))


def roots(forms: DataFrame, doublings: int) -> DataFrame:
    """word and root of every word with a form: the end of its chain. forms: word, form. After k doublings chains of 2^k steps
    are followed."""
    steps = forms.select("word", F.col("form").alias("root"))
    for _ in range(doublings):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return steps


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_COUNT, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form (its near word of largest n if that is at least twice as frequent), form_n, root of every word of at
    least `least` occurrences."""
    words = written(word_counts(docs, doc_id, text).filter(F.col("n") >= least), "words")
    near = near_words(words, block)
    better = F.col("near.n") >= 2 * F.col("n")
    formed = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("near.word")).alias("form"), F.when(better, F.col("near.n")).alias("form_n")), "forms")
    most = formed.agg(F.max("form_n")).first()[0]
    # counts at least double from step to step, so a chain has at most log2(most / least) steps
    steps = 0 if most is None else max(1, (most // max(1, least)).bit_length())
    ends = roots(formed.filter("form IS NOT NULL").select("word", "form"), max(0, (steps - 1).bit_length()))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "n_near", "form", "form_n", "root")
