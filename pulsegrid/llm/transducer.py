"""Token counts by a compiled finite-state transducer, without encoding.

Merges of a byte-pair tokenizer decide locally which tokens may stand side by side: two tokens are neighbours in an encoding
exactly if encoding their joined text gives the same two. Every prefix of a word therefore has one last token, and what the
rest of the word can still do to it depends on a finite state: the suffixes of the prefix with which some token begins, each
with the token before it. `Transducer` compiles these states on first use into a deterministic transducer whose transitions
carry the change in the number of tokens (it may fall when a longer token takes over). States are kept up to a bound and then
compiled again, and so are whole words, which act as one transition.

A text is cut into chunks of `CHUNK` code points. White space leads every state to the start state, so the map of a chunk is
its open head, a count for what is closed, and its open tail; a chunk without white space is all open. Maps compose
associatively: the composition is a prefix scan over the chunks of a text, which finds the words that cross chunks.

Bounds: chunks are spread over tasks; a word that spans chunks is put together in one row, as it was before. Compiled states
and words are bounded per worker.

Defined cases: NULL text is empty and has no tokens; equal rows count each on their own; words longer than a chunk are
counted right; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

CHUNK = 1 << 15
MOST_STATES = 250_000
MOST_WORDS = 400_000
MOST_PAIRS = 400_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
# letters whose lower case is one letter of their own and which no tokenizer here splits from one another
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(i) for i in range(0xDF, 0x100) if i != 0xF7)
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class State:
    __slots__ = ("suffix", "open", "next")

    def __init__(self, suffix: str, open_: tuple):
        self.suffix, self.open, self.next = suffix, open_, {}


class Transducer(dict):
    """Maps a word (no white space) to its number of tokens; transitions are made when first needed."""

    def __init__(self, spec: str):
        super().__init__()
        told = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        model = told["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("a byte-pair model with merges in order is needed")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = set(model["vocab"])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.made_of = {a + b: (a, b) for a, b in pairs}
        if len(self.made_of) < len(pairs):
            raise ValueError("a token is merged in two ways")
        self.edges: tuple[dict, dict] = ({}, {})
        bare = [t[:-len(self.end)] if self.end and t.endswith(self.end) else t for t in self.vocab]
        self.begins = {t[:i] for t in bare for i in range(1, len(t))}
        special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.neighbours: dict[tuple[str, str], bool] = {}
        # letters as the byte alphabet spells them, for words that need no further look
        self.spelt = {ord(c): self.split(c)[0] for c in LETTERS}
        self.points: dict[str, int] = {"": 0}
        self.restart()

    def restart(self) -> None:
        self.start = State("", ((0, None, 0),))
        self.states = {("", self.start.open): self.start}

    def edge(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The parts that stand at one edge of a token while it is merged, from the whole down to one symbol, each with the
        rank of the merge that takes it up."""
        known = self.edges[right].get(token)
        if known is None:
            known, part, taken = [], token, float("inf")
            while part is not None:
                known.append((part, taken))
                pair = self.made_of.get(part)
                part, taken = (pair[right], self.rank[pair]) if pair else (None, taken)
            self.edges[right][token] = known
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether two tokens stay side by side: no merge across their border comes before those inside them. Of equal
        merges the one further left comes first. A part is older than every merge that takes it up."""
        pair = (left, right)
        known = self.neighbours.get(pair)
        if known is None:
            if len(self.neighbours) >= MOST_PAIRS:
                self.neighbours.clear()
            rank = self.rank.get
            known = self.neighbours[pair] = not any(
                m is not None and m < taken_a and m <= taken_b
                for a, taken_a in self.edge(left, True) for b, taken_b in self.edge(right, False) for m in (rank((a, b)),))
        return known

    def compile(self, state: State, symbol: str) -> tuple[State, int]:
        """The transition of a state on a symbol, and the change in the count of tokens."""
        text = state.suffix + symbol
        for size, before, n in state.open:
            token = text[len(state.suffix) - size:]
            if token in self.vocab and (before is None or self.fits(before, token)):
                change, last = n + 1, token
                break
        else:
            raise ValueError(f"no token ends at {symbol!r}: the vocabulary lacks a byte")
        still = tuple((size + 1, before, n - change) for size, before, n in state.open if text[len(state.suffix) - size:] in self.begins)
        opened = (*still, (0, last, 0))
        suffix = text[len(text) - opened[0][0]:] if opened[0][0] else ""
        target = self.states.get((suffix, opened))
        if target is None:
            if len(self.states) >= MOST_STATES:
                self.restart()
            target = self.states[suffix, opened] = State(suffix, opened)
        found = state.next[symbol] = (target, change)
        return found

    def run(self, piece: str) -> int:
        """Tokens of one pre-token."""
        state, total = self.start, 0
        for symbol in [*piece[:-1], piece[-1] + self.end]:
            state, change = state.next.get(symbol) or self.compile(state, symbol)
            total += change
        return total

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text in the byte alphabet."""
        clean = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(clean) if p]

    def plain(self, text: str) -> int:
        return sum(map(self.run, self.split(text)))

    def simple(self, letters: str, points: str) -> int:
        """Tokens of a word of plain letters with points behind it."""
        n = self.points.get(points)
        if n is None:
            n = self.plain(points)
            if len(self.points) < MOST_WORDS:
                self.points[points] = n
        return n + self.run(letters.lower().translate(self.spelt))

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        easy = PLAIN.fullmatch(word)
        if easy:
            n = self.simple(easy[1], easy[2])
        elif self.special is not None and "<" in word:
            ends = [0, *[x for m in self.special.finditer(word) for x in m.span()], len(word)]
            n = len(ends) // 2 - 1 + sum(self.plain(word[a:b]) for a, b in zip(ends[::2], ends[1::2]) if a < b)
        else:
            n = self.plain(word)
        if len(word) <= 64:
            self[word] = n
        return n

    def chunk(self, text: str) -> tuple[int, str | None, str | None]:
        """(closed count, head, tail) of a chunk; no tail: the chunk is open at both ends."""
        words = WORD.findall(text)
        if len(words) == 1 and len(words[0]) == len(text):
            return 0, text, None
        head = words.pop(0) if words and text[0] not in SPACES else ""
        tail = words.pop() if words and text[-1] not in SPACES else ""
        return sum(map(self.__getitem__, words)), head, tail


_made: dict[int, Transducer] = {}


def _transducer(spec: str) -> Transducer:
    """One per worker."""
    key = hash(spec)
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(spec)
    return _made[key]


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row. `tokenizer`: path of a tokenizer file on the driver; its content is broadcast."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(spec.value)
        for batch in batches:
            done = [t.chunk(x) for x in batch.column("piece").to_pylist()]
            n, head, tail = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(n, pa.int64()), pa.array(head, pa.string()), pa.array(tail, pa.string())],
                ["row", "doc_id", "k", "bytes", "n", "head", "tail"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(spec.value)
        for batch in batches:
            n = [t[w] if w else 0 for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), batch.column("doc_id"), batch.column("bytes"), pa.array(n, pa.int64())],
                                             ["row", "n", "doc_id", "bytes", "more"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = F.when(F.length("text") <= chunk, F.array("text")).otherwise(
        F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % chunk), F.lit(0)))
    pieces = d.select("row", "doc_id", F.posexplode(cut).alias("k", "piece")).select("row", "doc_id", "k", F.octet_length("piece").cast("long").alias("bytes"), "piece")
    m = pieces.mapInArrow(maps, f"row long, doc_id {id_type}, k int, bytes long, n long, head string, tail string")
    # the scan: how many chunks before this one lead to a known state
    order = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("g", F.coalesce(F.sum(F.col("tail").isNotNull().cast("int")).over(order), F.lit(0)))
    zero = F.lit(0).cast("long")
    ends = F.array(
        F.struct(F.col("g"), F.lit(0).alias("side"), F.col("head").alias("part"), F.col("n").alias("n"), F.col("bytes").alias("bytes")),
        F.struct((F.col("g") + 1).alias("g"), F.lit(1).alias("side"), F.col("tail").alias("part"), zero.alias("n"), zero.alias("bytes")))
    e = m.select("row", "doc_id", "k", F.inline(ends)).filter("part IS NOT NULL")
    words = e.groupBy("row", "g").agg(
        F.sort_array(F.collect_list(F.struct("k", "side", "part"))).alias("parts"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.first("doc_id").alias("doc_id"))
    closed = words.select("row", "n", "doc_id", "bytes", F.array_join("parts.part", "").alias("word")).mapInArrow(
        close, f"row long, n long, doc_id {id_type}, bytes long, more long")
    return closed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("bytes").alias("n_bytes"), F.sum(F.col("n") + F.col("more")).alias("n_tokens")).drop("row")
