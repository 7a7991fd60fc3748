"""Fill-in-the-middle: the pieces of a document are put in another order, with marks between them, by a piece table.

A document is a list of pieces (buffer, start, end) over two buffers that never change: its own bytes and the bytes of the
marks. Cutting splits pieces, an arrangement permutes them and puts pieces of the marks between, and the inverse
permutation of what is found behind each mark gives the text back. Bytes are copied once, when an output is written;
hashes take piece after piece from the buffers.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import bytes_of, chunks, with_results

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: In which order a form has prefix (0), suffix (1) and middle (2); each stands behind its mark.
ORDER = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
#: Where prefix, suffix and middle stand in the text.
IN_TEXT = (0, 2, 1)
TEXT, MARK = 0, 1

Piece = tuple[int, int, int]


def is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SPACE = is_space()


def draws(key: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers under 2^32 from the SHA-256 of ``seed:key``; a null key is empty."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()[:16])


def token_ends(data: np.ndarray) -> np.ndarray:
    """Where the tokens of a text end, as byte offsets: behind each word, and behind white space that ends the text."""
    space = SPACE[data]
    ends = np.append(space[1:], True) & ~space
    if len(data):
        ends[-1] = True
    return np.flatnonzero(ends) + 1


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def cut(pieces: list[Piece], *places: int) -> list[list[Piece]]:
    """The pieces between the places (ascending offsets into what the pieces spell), those across a place are split."""
    out: list[list[Piece]] = [[]]
    at, left = 0, list(places)
    for buffer, start, end in pieces:
        while left and at + end - start > left[0]:
            middle = start + left.pop(0) - at
            out[-1].append((buffer, start, middle))
            at, start = at + middle - start, middle
            out.append([])
        out[-1].append((buffer, start, end))
        at += end - start
    return [*out, *([] for _ in left)]


def arrange(parts: list[list[Piece]], form: str, marks: list[Piece]) -> list[Piece]:
    """Prefix, middle and suffix (as they stand in the text) in the order of the form, each behind its mark."""
    return [p for kind in ORDER[form] for p in (marks[kind], *parts[IN_TEXT[kind]])]


def undo(data: bytes, form: str, marks: list[bytes]) -> list[Piece]:
    """The pieces of an output that spell its text: what stands behind each mark, in the order of the text."""
    if form not in ORDER:
        return [(TEXT, 0, len(data))]
    kinds, found, at = ORDER[form], {}, 0
    for kind in kinds:
        start = data.index(marks[kind], at)
        found[kind] = (start, at := start + len(marks[kind]))
    ends = [found[k][0] for k in kinds[1:]] + [len(data)]
    parts = {k: (TEXT, found[k][1], end) for k, end in zip(kinds, ends, strict=True)}
    return [parts[k] for k in sorted(kinds, key=IN_TEXT.__getitem__)]


def digest(pieces: list[Piece], buffers: tuple) -> str:
    h = hashlib.sha256()
    for buffer, start, end in pieces:
        h.update(buffers[buffer][start:end])
    return h.hexdigest()


def spell(pieces: list[Piece], buffers: tuple) -> bytes:
    return b"".join([buffers[buffer][start:end] for buffer, start, end in pieces])


def text_array(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).view(pa.string())


def mark_pieces(marks: tuple[str, str, str]) -> tuple[bytes, list[Piece]]:
    """The buffer of the marks and a piece for each."""
    size = [len(m.encode()) for m in marks]
    return "".join(marks).encode(), [(MARK, sum(size[:i]), sum(size[: i + 1])) for i in range(3)]


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 50, spm_percent: int = 80, seed: int = 42, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Replace text by n (tokens), form, prefix_chars, middle_chars, output and output_sha256.

    A token is white space and the word behind it, or white space that ends the text. Two of four numbers drawn from key
    cut the text between tokens, one chooses percent of the documents, one spm_percent of these for the form spm; the
    others are psm. A text that is null (counted as empty), empty or has one of the marks stays as it is (form plain, no
    chars). Rows that repeat come out alike, null keys are drawn as empty, and columns that have one of the new names
    are replaced. A task holds the bytes of one text and of its output, or 1 MB of shorter ones.
    """
    new = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "output_sha256": "string"}
    docs = docs.drop(*[c for c in new if c not in (text, key)])
    buffer, pieces_of_marks = mark_pieces(marks)
    plain_marks = [m.encode() for m in marks]

    def row(data: np.ndarray, own: object) -> tuple:
        ends = token_ends(data)
        whole, own_text, n = [(TEXT, 0, len(data))], memoryview(data), len(ends)
        h1, h2, h3, h4 = draws(own, seed)
        raw = data.tobytes()
        if not n or h3 % 100 >= percent or any(m in raw for m in plain_marks):
            return n, "plain", None, None, raw, digest(whole, (own_text, buffer))
        form = "spm" if h4 % 100 < spm_percent else "psm"
        places = [int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
        parts = cut(whole, *places)
        out, buffers = arrange(parts, form, pieces_of_marks), (own_text, memoryview(buffer))
        chars = [characters(data[: places[0]]), characters(data[places[0] : places[1]])]
        return n, form, *chars, spell(out, buffers), digest(out, buffers)

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(text))
            keys = batch.column(key)
            for i, j in chunks(offsets):
                rows = [row(data[offsets[k] : offsets[k + 1]], keys[k].as_py()) for k in range(i, j)]
                arrays = [pa.array([r[c] for r in rows], kind) if names[c] != "output" else text_array([r[c] for r in rows]) for c, kind in enumerate(kinds)]
                yield with_results(batch.slice(i, j - i), [text], dict(zip(names, arrays, strict=True)))

    names = list(new)
    schema = docs.drop(text).withColumns({c: F.lit(None).cast(kind) for c, kind in new.items()}).schema
    return docs.mapInArrow(rearrange, schema)


def restore(found: DataFrame, output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Append restored and restored_sha256: the text that an output and its form were made of, from these two alone.

    Another form than psm or spm, or none, means that the output is the text; a null output is an empty one. An output
    without the marks of its form is an error.
    """
    found = found.drop("restored", "restored_sha256")
    plain_marks = [m.encode() for m in marks]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(output))
            forms = batch.column(form).to_pylist()
            for i, j in chunks(offsets):
                texts, hashes = [], []
                for k in range(i, j):
                    own = data[offsets[k] : offsets[k + 1]].tobytes()
                    pieces, buffers = undo(own, forms[k], plain_marks), (memoryview(own),)
                    texts.append(spell(pieces, buffers))
                    hashes.append(digest(pieces, buffers))
                yield with_results(batch.slice(i, j - i), [], {"restored": text_array(texts), "restored_sha256": pa.array(hashes, pa.string())})

    schema = found.withColumns({"restored": F.lit(None).cast("string"), "restored_sha256": F.lit(None).cast("string")}).schema
    return found.mapInArrow(rebuild, schema)
