"""Splitting long texts at natural boundaries, sizes in tokens.

Each token of a text becomes one letter that says how strong the boundary after
it is. A single regular expression with bounded quantifiers then cuts the string
of letters: its alternatives are ordered by the strength of the boundary they
end in and each takes as much as the limit allows, down to the fallback to any
whole character. SQL array functions turn the lengths of the matches into
pieces; a piece looks back ``overlap`` tokens into the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpora.llm.encode import VOCABULARY, WordBatch, encoder, vocabulary_file, words_of

# Boundary letters, the strongest first: paragraph, line, sentence, clause,
# word, joint of a word and punctuation, inside a word, inside a character.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, JOINT, INSIDE, BYTE = b"PLSCWjxb"
NATURAL = "PLSCW"

_SENTENCE_ENDS = ".!?…。！？"
_CLAUSE_ENDS = ",;:)]}–—、，"
_CLOSERS = "\"'”’»)]}*_"


def _word_traits(word: str) -> tuple[int, int, int]:
    """(newlines in a word of white space or -1, kind of end 0 to 2, whether it starts with white space)."""
    if word.isspace():
        return word.count("\n") + word.replace("\r\n", "\n").count("\r"), 0, 1
    core = word.rstrip(_CLOSERS)
    end = 2 if core and core[-1] in _SENTENCE_ENDS else 1 if word[-1] in _CLAUSE_ENDS else 0
    return -1, end, int(word[0].isspace())


def _inside(bpe, ids: list[int]) -> tuple[bytes, bytes]:
    """Per token of a word: the letter for a cut within the word, and (as int32) the bytes of the characters that are complete after it."""
    data, letters, ends, at = b"".join(bpe.token[t] for t in ids), bytearray(), [], 0
    for t in ids:
        at += len(bpe.token[t])
        whole = at
        while whole < len(data) and (data[whole] & 0xC0) == 0x80:
            whole -= 1
        letters.append(INSIDE if whole == at else BYTE)
        ends.append(whole)
    return bytes(letters), np.array(ends, np.int32).tobytes()


#: Bytes of the blocks that texts are held in, so that a piece copies its own blocks alone.
BLOCK = 4096
#: Words kept in a worker's memory of traits.
SHAPE_MEMORY = 200_000
_shapes: dict[str, tuple] = {}


def _shapes_of(batch: WordBatch, bpe) -> list[tuple]:
    """(newlines, kind of end, starts with white space, letters, ends, bytes) of the distinct words of a batch."""
    fresh = [k for k, w in enumerate(batch.distinct) if w not in _shapes]
    if len(_shapes) + len(fresh) > SHAPE_MEMORY:
        _shapes.clear()
        fresh = range(len(batch.distinct))
    for k in fresh:
        word = batch.distinct[k]
        _shapes[word] = (*_word_traits(word), *_inside(bpe, batch.flat[batch.first[k] : batch.first[k + 1]].tolist()), len(word.encode()))
    return [_shapes[w] for w in batch.distinct]


def _letters(batch: WordBatch, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Per token of the batch: its boundary letter, and the bytes of its text up to its end."""
    shapes = _shapes_of(batch, encoder(path)[0])
    if not shapes:
        return np.zeros(0, np.uint8), np.zeros(0, np.int32)
    traits = list(zip(*shapes))
    newlines, ends, starts, lengths = (np.array(traits[k], np.int32)[batch.codes] for k in (0, 1, 2, 5))
    follows = np.append(starts[1:], 1)
    next_newlines = np.append(newlines[1:], -1)
    last_of_row = np.zeros(len(batch.codes), bool)
    row_ends = batch.starts[1:][np.diff(batch.starts) > 0] - 1
    last_of_row[row_ends] = True
    next_newlines[last_of_row] = -1
    before = np.append(-1, newlines[:-1])
    before[batch.starts[:-1][np.diff(batch.starts) > 0]] = -1
    at_line = (newlines > 0) & (next_newlines <= 0)
    at_paragraph = at_line & ((newlines > 1) | (before > 0))
    word = np.select(
        [at_paragraph, at_line, (ends == 2) & (follows == 1), (ends == 1) & (follows == 1), (follows == 1) | (newlines >= 0)],
        [PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD], JOINT,
    ).astype(np.uint8)
    word[last_of_row] = PARAGRAPH  # the end of a text is as strong as any
    letters = batch.spread(np.frombuffer(b"".join(traits[3]), np.uint8))
    letters[batch.word_ends[1:] - 1] = word
    # Bytes: those of the words before in the same text, and those within the word.
    so_far = np.cumsum(lengths, dtype=np.int64) - lengths
    per_row = np.diff(batch.starts)
    in_row = so_far - np.repeat(so_far[batch.starts[:-1][per_row > 0]], per_row[per_row > 0])
    done = batch.spread(np.frombuffer(b"".join(traits[4]), np.int32)) + np.repeat(in_row, batch.word_sizes)
    return letters, done.astype(np.int32)


def _blocks(text: pa.StringArray) -> pa.ListArray:
    """Each text as a list of blocks of bytes; the texts are not null."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    count = -(-np.diff(offsets) // BLOCK)
    ends = np.append(0, np.cumsum(count))
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], count)
    starts = np.append(np.repeat(offsets[:-1], count) + within * BLOCK, offsets[-1]).astype(np.int32)
    blocks = pa.Array.from_buffers(pa.binary(), int(ends[-1]), [None, pa.py_buffer(starts.tobytes()), text.buffers()[2]])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), blocks)


def boundary_strings(
    docs: DataFrame, longer_than: int, id_col: str, text_col: str, tokenizer_dir: str | None = None, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(id, blocks, letters, byte_ends) of the texts with more than ``longer_than`` tokens."""
    path = vocabulary_file(docs.sparkSession, tokenizer_dir, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                batch = WordBatch(part.column(2), path)
                keep = batch.counts() > longer_than
                if not keep.any():
                    continue
                letters, ends = _letters(batch, path)
                offsets = pa.py_buffer(batch.token_starts.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), _blocks(part.column(1)),
                        pa.StringArray.from_buffers(batch.rows, offsets, pa.py_buffer(letters.tobytes())),
                        pa.ListArray.from_arrays(pa.array(batch.token_starts.astype(np.int32)), pa.array(ends)),
                    ],
                    ["id", "blocks", "letters", "byte_ends"],
                ).filter(pa.array(keep))

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), words_of(F.col(text_col)).alias("words"))
    # A token has a byte at least, so shorter texts need not be looked at.
    return chosen.where(F.octet_length("text") > longer_than).mapInArrow(run, f"id {kind}, blocks array<binary>, letters string, byte_ends array<int>")


def _choices(most: int, overlap: int) -> str:
    """Alternatives for the next ``most`` new tokens, the preferred first."""
    # The piece after this one starts ``overlap`` tokens before the cut; that must not be within a character.
    whole = f"(?<!b.{{{overlap}}})" if overlap else ""
    least, half = min(overlap + 1, most), max(min(overlap + 1, most), most // 2)
    wanted = [(half, c) for c in "PLS"] + [(least, c) for c in "PLS"] + [(half, "C"), (half, "W"), (least, "C"), (least, "W"), (least, "j"), (least, "[^b]")]
    cuts = [f".{{{low - 1},{most - 1}}}{letter}{whole}" for low, letter in wanted]
    return "|".join([f".{{1,{most}}}$", *cuts, f".{{1,{most}}}"])


def cut_pattern(limit: int, overlap: int) -> str:
    """The expression whose matches are the new tokens of each piece."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and under the limit")
    return f"(?s)^(?:{_choices(limit, overlap)})|(?:{_choices(limit - overlap, overlap)})"


def _cuts(parts: str) -> Column:
    """[0, end of the first piece, end of the second, ...] in tokens, from the letters of each piece's new tokens."""
    lengths = F.transform(parts, F.octet_length)
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _pieces(parts: str, cuts: str, profile: str, overlap: int) -> Column:
    """One struct per piece; texts are cut as blocks of bytes, at the ends of characters, so that no cut goes through a whole text."""

    def piece(letters: Column, i: Column) -> Column:
        new, end = F.element_at(cuts, i + 1), F.element_at(cuts, i + 2)
        start = F.greatest(new - overlap, F.lit(0))
        first = F.when(start > 0, F.element_at("byte_ends", F.greatest(start, F.lit(1)))).otherwise(0)
        last = F.element_at("byte_ends", end)
        at, to = F.floor(first / BLOCK).cast("int"), F.floor(F.greatest(last - 1, F.lit(0)) / BLOCK).cast("int")
        held = F.aggregate(F.slice("blocks", at + 1, F.greatest(to - at + 1, F.lit(0))), F.lit(b""), lambda acc, block: F.concat(acc, block))
        return F.struct(
            F.lit(profile).alias("profile"), i.alias("piece_no"), start.alias("start_token"), (end - start).alias("n_tokens"),
            (new - start).alias("shared"), F.right(letters, F.lit(1)).alias("boundary"), F.substr(held, first - at * BLOCK + 1, last - first).cast("string").alias("text"),
        )

    return F.transform(parts, piece)


def split(
    docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    tokenizer_dir: str | None = None, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(profile, id, piece_no, start_token, n_tokens, shared, boundary, text) of every text over its profile's limit.

    ``profiles`` holds a few rows (profile, piece_limit, overlap); a profile
    without a positive limit is left out, a null overlap is 0 and none reaches
    the limit. Pieces follow
    each other from piece_no 0; each but the first repeats the last ``shared`` =
    ``overlap`` tokens of the one before, and none has more than ``piece_limit``
    tokens. ``boundary`` is the letter of the cut that ends the piece (see the
    constants above). A break from paragraph to sentence is taken where the
    limit leaves one, in the later half if it has one there, then a clause or a
    word of the later half, then those of the earlier one; only text without any break is cut between characters. Texts within
    the limit, empty and null texts give no rows; repeated rows and null ids
    come out as often as they occur.
    """
    shared = F.greatest(F.least(F.coalesce("overlap", F.lit(0)), F.col("piece_limit") - 1), F.lit(0)).alias("overlap")
    limits = [tuple(r) for r in profiles.where("piece_limit > 0").select("profile", "piece_limit", shared).distinct().orderBy("profile", "piece_limit").collect()]
    kind = docs.schema[id_col].dataType.simpleString()
    if not limits:
        return docs.sparkSession.createDataFrame(
            [], f"profile string, {id_col} {kind}, piece_no int, start_token int, n_tokens int, shared int, boundary string, text string"
        )
    marked = boundary_strings(docs, min(limit for _, limit, _ in limits), id_col, text_col, tokenizer_dir, vocabulary)
    for k, (_, limit, overlap) in enumerate(limits):
        parts = F.regexp_extract_all("letters", F.lit(cut_pattern(limit, overlap)), 0)
        marked = marked.withColumn(f"parts{k}", F.when(F.octet_length("letters") > limit, parts))
    marked = marked.withColumns({f"cuts{k}": _cuts(f"parts{k}") for k in range(len(limits))})
    pieces = [_pieces(f"parts{k}", f"cuts{k}", p, overlap) for k, (p, _, overlap) in enumerate(limits)]
    one = F.explode(F.flatten(F.array_compact(F.array(*pieces)))).alias("piece")
    return marked.select(F.col("id").alias(id_col), one).select(
        "piece.profile", id_col, *(f"piece.{c}" for c in ("piece_no", "start_token", "n_tokens", "shared", "boundary", "text"))
    )
