"""Problem 7: cut oversized texts into pieces under a token limit.

Method: a recursive separator hierarchy.  A text is split into sections; whole sections are packed
greedily into a piece while they fit.  A section that does not fit into a piece of its own is split
into paragraphs, which are packed in the same way, a paragraph into sentences, a sentence into
words, a word into characters.  So a piece is cut at a lower level only where no boundary of a
higher one lies in it.  Each piece begins with the last ``overlap`` tokens of the piece before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.tokens import DEFAULT_VOCABULARY, encoder
from lexivec.session import spread_out

LEVELS = ("section", "paragraph", "sentence", "word", "character")
SECTION, PARAGRAPH, SENTENCE, WORD, CHARACTER = range(5)

#: The rest of a line break whose first character, of two or one, was matched.
_BREAK = r"(?:(?<=\r)\n|(?<=\n))"

#: A cut is where a match begins, for sentences where it ends, but before a line break.
#: Each pattern begins with a set of characters, which the matcher looks for first.
SEPARATORS = (
    re.compile(
        rf"[\f\r\n](?:(?<=\f)|{_BREAK}(?:(?:\r?\n)*(?=#{{1,6}} )|[ \t]*(?:\r?\n[ \t]*){{2,}}"
        r"|(?:\r?\n)*(?=[-=*_]{3,}[ \t]*\r?\n)))"
    ),
    re.compile(rf"[\r\n]{_BREAK}[ \t]*(?:\r?\n[ \t]*)+"),
    re.compile(
        "[.!?…;。！？；\\n](?:(?<=\\n)|(?<=[。！？；])[\"'”’»」）]*|(?<=[.!?…;])[\"'”’»)\\]]*(?=\\s))"
    ),
    re.compile(r"\s+"),
)

#: A heading is a part of the paragraph after it.
HEADING = re.compile(r"#{1,6} ")

#: Characters a separator is looked for beyond the piece's end, so that it is seen whole.
BEYOND = 4096

PIECES = (
    "piece_no int, start_char int, end_char int, overlap_tokens int, n_tokens int, cut string, piece string"
)

_ARROW = (*[pa.int32()] * 5, pa.string(), pa.string())


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str) -> np.ndarray:
    """The number of bytes of each token."""
    e = encoder(vocabulary)
    out = np.zeros(e.max_token_value + 1, dtype=np.int64)
    for t in e.token_byte_values():
        out[e.encode_single_token(t)] = len(t)
    return out


def part_ends(text: str, level: int, lo: int, reach: int, start: int | None = None) -> Iterator[int]:
    """Where the parts of ``text[lo:]`` at ``level`` end, in order, as far as ``reach``; from ``start`` on where given."""
    for m in SEPARATORS[level].finditer(text, lo if start is None else start, reach + BEYOND):
        at = m.end() if level == SENTENCE and text[m.start()] != "\n" else m.start()
        if at > reach:
            return
        if at > lo and not (level == PARAGRAPH and HEADING.match(text, text.rfind("\n", 0, at) + 1)):
            yield at


def last_end(text: str, level: int, lo: int, reach: int) -> int:
    """The last of ``part_ends``, or ``lo``; the end of the stretch is looked through first."""
    width = 1024
    while True:
        start = max(lo, reach - width)
        while start > lo and start < reach and text[start].isspace():
            start += 1  # a separator that began before is seen whole or not at all
        at = lo
        for at in part_ends(text, level, lo, reach, start):
            pass
        if at > lo or start == lo:
            return at
        width *= 8


def fill_piece(text: str, lo: int, reach: int, level: int = SECTION) -> tuple[int, int]:
    """Where the piece whose own text begins at ``lo`` is cut, at most at ``reach``, and the cut's level.

    Whole parts of ``level`` are packed while they fit; a first part that does not fit is split at the next level.
    """
    if level == CHARACTER:
        return max(lo + 1, reach), level
    at = last_end(text, level, lo, reach)
    return (at, level) if at > lo else fill_piece(text, lo, reach, level + 1)


def split_text(text: str, limit: int, overlap: int, vocabulary: str = DEFAULT_VOCABULARY) -> list[tuple]:
    """The pieces of one text, or none if it has at most ``limit`` tokens.

    Each is ``(piece_no, start_char, end_char, overlap_tokens, n_tokens, cut, piece)``; ``cut`` is
    the level of the boundary that ends the piece, ``end`` for the last.  Without their overlaps
    the pieces, put together, are the text.  Where the first token of an overlap begins inside a
    character, the overlap begins at that character.  Only a window a little longer than a piece
    is tokenized at a time, so the work is linear in the text and the memory bounded.
    """
    encode = encoder(vocabulary).encode_ordinary
    sizes = token_bytes(vocabulary)
    out: list[tuple] = []
    lead = done = shared = 0  # where the piece begins; where its own text begins; tokens between
    per_token = 4.0
    while True:
        width = int(limit * per_token * 1.12) + 64
        while True:
            window = text[lead : lead + width]
            ids = encode(window)
            rest = lead + width < len(text)
            if not rest or len(ids) > limit + 16:
                break
            width = int(width * 1.5)
        if not rest and len(ids) <= limit:
            if out:
                out.append((len(out), lead, len(text), shared, len(ids), "end", window))
            return out
        data = np.frombuffer(window.encode("utf-8"), dtype=np.uint8)
        begins = (data & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(begins)))  # characters begun before each byte
        ends = np.cumsum(sizes[np.asarray(ids[:limit], dtype=np.int64)])
        whole = np.append(begins, True)[ends]  # tokens that end between characters
        char_end = before[ends] - ~whole
        own, reach = done - lead, int(char_end[-1])
        at, level = fill_piece(text, done, lead + reach)
        at -= lead
        k = int(np.searchsorted(char_end, at, side="right"))
        if level == CHARACTER or char_end[k - 1] != at or not whole[k - 1]:
            while len(used := encode(window[:at])) > limit:  # merges differ at the cut
                at = max(own + 1, at - max(1, (len(used) - limit)))
        else:
            used = ids[:k]
        out.append((len(out), lead, lead + at, shared, len(used), LEVELS[level], window[:at]))
        done = lead + at
        per_token = at / len(used)
        tail = int(sizes[np.asarray(used[-overlap:], dtype=np.int64)].sum()) if overlap else 0
        stop = int(np.searchsorted(before, at, side="left"))  # bytes before the cut
        stop = len(data) if stop > len(data) else stop
        while stop < len(data) and not begins[stop]:
            stop += 1
        first = stop - tail
        while first > 0 and not begins[first]:
            first -= 1
        shared = min(overlap, len(used))
        lead = lead + int(before[first]) if tail else done


def split_oversized(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    overlap: int = 64,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """One row per piece of every text over ``limit`` tokens: ``id_col`` and the columns of PIECES.

    A narrow operation: no shuffle.  Texts of at most ``limit`` bytes cannot have more than
    ``limit`` tokens and are dropped before Python sees them.  Null and empty texts have no
    pieces; a repeated row gives its pieces again; a null id stays null; other columns are ignored.
    """
    if overlap < 0 or limit < 4 * max(1, overlap):
        raise ValueError("limit must be at least four times the overlap")
    kind = df.schema[id_col].dataType.simpleString()
    names = [p.split()[0] for p in PIECES.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.schema([("id", batch.schema.field("id").type), *zip(names, _ARROW)])
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                rows = [
                    (key, *p)
                    for key, text in zip(part["id"].to_pylist(), part["text"].to_pylist())
                    for p in split_text(text, limit, overlap, vocabulary)
                ]
                if rows:
                    columns = zip(kinds, zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in columns], schema=kinds)

    long = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.octet_length("text") > limit
    )
    return spread_out(long).mapInArrow(pieces, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)
