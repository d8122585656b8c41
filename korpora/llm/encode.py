"""Encoding texts with a public byte-level BPE tokenizer.

The pre-tokenizer's words come from the JVM (``regexp_extract_all``), Arrow
dictionary-encodes the words of a batch, and only the batch's distinct words
are encoded in Python, in a byte trie that is walked depth first: a node keeps
the last token of the encoding of the prefix it stands for, so a prefix that
many words share is encoded once. A prefix's last token is the only token t
that ends it and that stays apart from the last token before t when the two are
joined; the whole encoding follows by going back from last token to last token.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabularies; every function takes another as a parameter.
TOKENIZER_DIR = os.environ.get("KORPORA_TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# White space by Unicode's property, as Java's \s is ASCII only,
# and the pre-tokenizer's pattern over it.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)"
    r"| ?\p{L}+"
    r"| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])"
    rf"|[{_SPACE}]+"
)

#: Entries of a worker's memory of words; it starts anew beyond that.
WORD_MEMORY = 400_000


class PrefixBPE:
    """Encodings of byte strings by last-token propagation in a trie."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        #: Lengths of the tokens that end in two given bytes, longest first.
        tails: dict[bytes, set[int]] = {}
        for t in self.rank:
            if len(t) > 1:
                tails.setdefault(t[-2:], set()).add(len(t))
        self.tails = {k: (*sorted(v, reverse=True), 1) for k, v in tails.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}

    def merged(self, piece: bytes, below: int | None = None) -> list[int]:
        """Plain merging by rank, with merges of a rank under ``below`` only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens that the merge making ``t`` joins; None for a byte."""
        if t not in self.halves:
            two = self.merged(self.token[t], t) if len(self.token[t]) > 1 else []
            self.halves[t] = (two[0], two[1]) if len(two) == 2 else None
        return self.halves[t]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two again.

        Their merges are undone, the latest first. At each step the parts next
        to the seam lie side by side until ``until``; a merge over the seam of
        an earlier rank would have come first.
        """
        a, b, until = left, right, len(self.rank) + 1
        while True:
            over = self.rank.get(self.token[a] + self.token[b])
            if over is not None and over < until:
                return False
            of_a, of_b = self.split(a), self.split(b)
            if of_a and (a > b or not of_b):
                a, until = of_a[1], a
            elif of_b:
                # Of equal ranks the leftmost merges first: the seam before b's own.
                b, until = of_b[0], b + 1
            else:
                return True

    def encode_all(self, words: list[bytes]) -> list[list[int]]:
        """The token ids of each word (words are distinct and not empty).

        Sorted words are the trie in depth-first order: the state of a prefix
        is kept as long as the next word shares it.
        """
        out: list[list[int]] = [[]] * len(words)
        rank, apart, tails, single = self.rank, self.apart, self.tails, (1,)
        if len(apart) > 4 * WORD_MEMORY:
            apart.clear()
        last: list[int] = [-1]  # last[i]: last token of the first i bytes
        width: list[int] = [0]
        before = b""
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            shared = len(commonprefix((before, word)))
            del last[shared + 1 :], width[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for size in tails.get(word[end - 2 : end], single) if end > 1 else single:
                    start = end - size
                    if start < 0:
                        continue
                    t = rank.get(word[start:end])
                    if t is None:
                        continue
                    if start:
                        pair = (last[start], t)
                        ok = apart.get(pair)
                        if ok is None:
                            ok = apart[pair] = self.stays_apart(*pair)
                        if not ok:
                            continue
                    last.append(t)
                    width.append(size)
                    break
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= width[end]
            ids.reverse()
            out[at] = ids
            before = word
        return out


_encoders: dict[str, tuple[PrefixBPE, dict[str, list[int]]]] = {}


def vocabulary_file(spark: SparkSession, tokenizer_dir: str | None = None, vocabulary: str = VOCABULARY) -> str:
    """Path of a vocabulary on the driver, sent to all executors once per application.

    Workers read what was sent; of two files of one name only the first is, and
    the other one is read at its path.
    """
    path = f"{tokenizer_dir or TOKENIZER_DIR}/{vocabulary}"
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_korpora_files", {})
    if os.path.basename(path) not in sent:
        sent[os.path.basename(path)] = path
        context.addFile(path)
    return path if sent[os.path.basename(path)] != path else os.path.basename(path) + "@" + path


def encoder(path: str) -> tuple[PrefixBPE, dict[str, list[int]]]:
    """The encoder of a vocabulary file and its memory of words, once per worker."""
    if path not in _encoders:
        name, _, own = path.rpartition("@")
        local = SparkFiles.get(name) if name else own
        _encoders[path] = PrefixBPE(local if os.path.exists(local) else own), {}
    return _encoders[path]


def encode_distinct(words: list[str], path: str) -> list[list[int]]:
    """Token ids of distinct words, encoding only those not met before."""
    bpe, memory = encoder(path)
    fresh = [w for w in words if w not in memory]
    if len(memory) + len(fresh) > WORD_MEMORY:
        memory.clear()
        fresh = words
    memory.update(zip(fresh, bpe.encode_all([w.encode() for w in fresh])))
    return [memory[w] for w in words]


def words_of(text: Column) -> Column:
    """The pre-tokenizer's words; an empty array for an empty or null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0), F.array().cast("array<string>"))


class WordBatch:
    """Words of a batch as codes into its distinct words, with their token ids."""

    def __init__(self, words: pa.ListArray, path: str):
        self.rows = len(words)
        self.starts = np.asarray(words.offsets) - (words.offsets[0].as_py() if self.rows else 0)
        coded = words.flatten().dictionary_encode()
        self.codes = np.asarray(coded.indices)
        self.distinct = coded.dictionary.to_pylist()
        encoded = encode_distinct(self.distinct, path)
        self.sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.flat = np.fromiter((t for ids in encoded for t in ids), np.int32, int(self.sizes.sum()))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.word_sizes = self.sizes[self.codes]
        self.word_ends = np.concatenate([[0], np.cumsum(self.word_sizes)])
        #: First token of each row, and one past the last row's.
        self.token_starts = self.word_ends[self.starts] if self.rows else np.zeros(1, np.int64)

    def spread(self, flat: np.ndarray) -> np.ndarray:
        """Values per token of the distinct words, laid out for all words."""
        at = np.repeat(self.first[self.codes] - self.word_ends[:-1], self.word_sizes)
        return flat[at + np.arange(len(at))]

    def counts(self) -> np.ndarray:
        return np.diff(self.token_starts).astype(np.int32)


def _batches(work, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bounded slices: a batch of long texts would hold gigabytes of words.
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays(work(part), columns)

    return run


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str | None = None, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(id, ids): token ids of every row's text, without special tokens.

    An empty or null text gives an empty list; text that looks like a control
    token is ordinary text. Rows are kept one to one (also repeated or null
    ids); columns other than the two named are ignored, whatever their names.
    Nothing is shuffled.
    """
    path = vocabulary_file(docs.sparkSession, tokenizer_dir, vocabulary)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        batch = WordBatch(part.column(1), path)
        ids = pa.ListArray.from_arrays(pa.array(batch.token_starts.astype(np.int32)), pa.array(batch.spread(batch.flat)))
        return [part.column(0), ids]

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    return chosen.mapInArrow(_batches(work, ["id", "ids"]), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str | None = None, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(id, n_tokens): as ``encode``, but only the number of tokens."""
    path = vocabulary_file(docs.sparkSession, tokenizer_dir, vocabulary)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        return [part.column(0), pa.array(WordBatch(part.column(1), path).counts())]

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    return chosen.mapInArrow(_batches(work, ["id", "n_tokens"]), f"id {kind}, n_tokens int").withColumnRenamed("id", id_col)
