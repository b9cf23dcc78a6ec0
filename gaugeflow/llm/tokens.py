"""Ids of whole texts from public tokenizer files, by pieces that no token crosses.

Two tokenizers side by side: a text may be cut before a single space that follows no
space and precedes a letter, digit or mark: the byte-level split pattern starts a new
part there, and no entry of the vocabularies used crosses such a place (the loader of
the second tokenizer checks it).

The byte-level one alone: its split pattern also starts a new part between words,
digits, marks and white space, so most pieces are single words or marks (``cuts``).
The distinct pieces of a slice are found by Arrow and looked up once each, the ids of
the slice are put together by numpy.

So the ids of a text are those of its pieces, and a worker remembers short
pieces in a table of bounded bytes. Everything else goes to the libraries as it is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Texts, slices

#: Pieces beyond this hardly recur and are not remembered.
SHORT = 64
#: What an entry of a table takes beside its own bytes.
ENTRY_BYTES = 200
TABLE_BYTES = 96_000_000
#: Text that is encoded in one go; more of it holds more repeated pieces.
ENCODED_BYTES = 5_000_000

# A character that no tokenizer takes for white space: printable ASCII, or a first
# byte of UTF-8 under which no white space is coded.
_SOLID = rb"[!-~\xc3-\xdf\xe4-\xff]"
_UNSAFE = re.compile(rb" (?!" + _SOLID + rb")")
_CUT = re.compile(rb"(?<! ) (?=" + _SOLID + rb")")


def pieces(text: bytes) -> list[bytes]:
    """The parts between the blanks at which a text may be cut; each but the first has lost its space."""
    if _UNSAFE.search(text):
        return _CUT.split(text)
    return text.split(b" ")


def spaced_pieces(text: bytes) -> list[bytes]:
    """As ``pieces`` for a text that is given one more space in front, which the first piece has lost too."""
    return pieces(text) if text[:1] != b" " else [p if i else p[1:] for i, p in enumerate(_CUT.split(b" " + text))]


def load_byte_bpe(path: str, plain_specials: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


def byte_symbols() -> dict[str, int]:
    """The byte behind each symbol of a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Pieces that go to a library in one call, as one text.
JOINED = 1024
_JOINABLE = re.compile(_SOLID + rb"[^ ]*")


def joinable(missing: list[bytes]) -> Iterator[list[bytes]]:
    """Pieces in blocks that may stand in one text with a space before each: ``JOINED`` of them, or one of its own."""
    block: list[bytes] = []
    for p in missing:
        if not _JOINABLE.fullmatch(p):
            yield [p]
            continue
        block.append(p)
        if len(block) == JOINED:
            yield block
            block = []
    if block:
        yield block


# Classes of bytes, for the places where the byte-level split pattern surely starts a new part.
_OTHER, _SPACE, _LINE, _LETTER, _DIGIT, _MARK, _QUOTE, _FIRST = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
for _kind, _members in (
    (_SPACE, b" "),
    (_LINE, b"\t\n\r"),
    (_MARK, bytes(range(0x21, 0x7F))),
    (_LETTER, bytes(b for b in range(0x41, 0x7B) if chr(b).isalpha())),
    (_DIGIT, b"0123456789"),
    (_QUOTE, b"'"),
    (_FIRST, bytes([*range(0xC3, 0xE0), *range(0xE4, 0x100)])),
):
    _CLASS[list(_members)] = _kind
_WHITE, _VISIBLE = np.isin(range(8), (_SPACE, _LINE)), np.isin(range(8), (_LETTER, _DIGIT, _MARK, _QUOTE, _FIRST))
# Words, digits and marks never share a part, and none goes on in white space. A quote may
# belong to the marks or the letters after it ('s), so only what comes before it ends.
_ENDS = np.zeros((8, 8), bool)
for _kind in (_LETTER, _DIGIT, _MARK):
    _ENDS[_kind, [k for k in (_SPACE, _LINE, _LETTER, _DIGIT, _MARK) if k != _kind]] = True
_ENDS[_LETTER, _QUOTE] = _ENDS[_DIGIT, _QUOTE] = _ENDS[_QUOTE, _SPACE] = _ENDS[_QUOTE, _LINE] = True
_ENDS = _ENDS.ravel()


def cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that stand one after the other in ``data``; ``edges`` are where texts begin.

    Of white space before a visible character the last is a part of its own, or, if a
    space, of the part that follows; the pattern takes those before it together.
    """
    size = len(data)
    starts = np.zeros(size + 1, bool)
    starts[edges] = True
    kinds = _CLASS[data]
    # Letters of two bytes from C3 on, all but the signs of multiplication and division.
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[((data[second] & 0xC0) == 0x80) & ((data[second] & 0xDF) != 0x97) & ~starts[second]]
    kinds[second] = _LETTER
    white = np.flatnonzero(_WHITE[kinds])
    white = white[white < size - 1]
    white = white[_VISIBLE[kinds[white + 1]] & ~starts[white + 1]]
    starts[1:size] |= _ENDS[kinds[:-1] * np.uint8(8) + kinds[1:]]
    starts[white] = True
    starts[white[kinds[white] == _LINE] + 1] = True
    return np.flatnonzero(starts[:size])


def runs(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begins`` on, as many as ``lengths`` says."""
    ends = np.cumsum(lengths)
    size = int(ends[-1]) if len(ends) else 0
    # Small numbers where they do: this is the largest array of a slice.
    kind = np.int32 if size + int(begins.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((begins - (ends - lengths)).astype(kind), lengths)
    out += np.arange(size, dtype=kind)
    return out


# Pieces that may stand in one text, a line each: visible characters, perhaps after a space.
_LINEABLE = re.compile(r" ?[^\s\u180e]+")


class ByteBpe:
    """Little-endian 32-bit ids of whole texts by a byte-level BPE file.

    Short pieces are remembered in two tables. The newer takes what is met; over half of
    ``table_bytes`` (about the bytes of keys, values and entries) it becomes the older,
    whose pieces are forgotten unless they are met again, so frequent ones stay.
    """

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        self.tokenizer = load_byte_bpe(path)
        self.specials = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.table: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held, self.table_bytes = 0, table_bytes

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[bytes]) -> list[bytes]:
        """Ids of pieces that the tables lack."""
        texts = [p.decode("utf-8", "replace") for p in missing]
        alone = [i for i, t in enumerate(texts) if not _LINEABLE.fullmatch(t)]
        apart = set(alone)
        lines = [i for i in range(len(texts)) if i not in apart] if apart else range(len(texts))
        out = [b""] * len(texts)
        for at in range(0, len(lines), JOINED):
            block = lines[at : at + JOINED]
            ids = self._encode(["\n".join([texts[i] for i in block])])[0]
            stops = np.flatnonzero(ids == self.line)
            flat, begin = ids.tobytes(), 0
            for i, stop in zip(block, [*(4 * stops).tolist(), len(flat)], strict=True):
                out[i] = flat[begin:stop]
                begin = stop + 4
        for i, ids in zip(alone, self._encode([texts[i] for i in alone]), strict=True):
            out[i] = ids.tobytes()
        return out

    def _find(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces; the short ones are remembered."""
        if self.held > self.table_bytes // 2:
            self.table, self.older, self.held = {}, self.table, 0
        out = list(map(self.table.get, distinct))
        lacking = [i for i, ids in enumerate(out) if ids is None]
        for i in lacking:
            out[i] = self.older.get(distinct[i])
        unknown = [i for i in lacking if out[i] is None]
        for i, ids in zip(unknown, self._learn([distinct[i] for i in unknown]), strict=True):
            out[i] = ids
        kept = [(distinct[i], out[i]) for i in lacking if len(distinct[i]) <= SHORT]
        self.table.update(kept)
        self.held += sum(len(p) + len(ids) + ENTRY_BYTES for p, ids in kept)
        return out

    def ids(self, data: np.ndarray, off: np.ndarray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts between the offsets ``off`` of ``data``, each followed by ``end``, and where each text's begin and end."""
        edges = off[:-1][off[1:] > off[:-1]]
        special = np.zeros((0, 2), np.int64)
        if self.specials.search(data):
            # The library parts a text at special tokens before anything else.
            special = np.array([m.span() for i, j in pairwise(off.tolist()) for m in self.specials.finditer(data, i, j)], np.int64).reshape(-1, 2)
            edges = np.concatenate([edges, special.ravel()])
        starts = cuts(data, edges)
        inside = np.zeros(len(data), bool)
        inside[runs(special[:, 0] + 1, special[:, 1] - special[:, 0] - 1)] = True
        starts = starts[~inside[starts]]
        bounds = np.append(starts, len(data))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        found = [*self._find(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), end]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # Pieces of the texts in order, the end after each text's.
        after = np.searchsorted(starts, off[1:])
        order = np.insert(coded.indices.to_numpy(), after, len(found) - 1)
        own = lengths[order]
        flat = np.frombuffer(b"".join(found), "<u4")[runs((np.cumsum(lengths) - lengths)[order], own)]
        ends = np.concatenate([[0], np.cumsum(own)])
        return flat, ends[np.concatenate([[0], after + np.arange(1, len(off))])]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        flat, bounds = self.ids(np.frombuffer(b"".join(texts), np.uint8), off)
        return [flat[i:j].tobytes() for i, j in pairwise(bounds.tolist())]


_loaded: dict[tuple, ByteBpe] = {}


def byte_bpe(path: str, table_bytes: int = TABLE_BYTES) -> ByteBpe:
    """One encoder for each worker process and file; its table outlives a task."""
    key = (path, table_bytes)
    if key not in _loaded:
        _loaded[key] = ByteBpe(*key)
    return _loaded[key]


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, load=byte_bpe) -> DataFrame:
    """doc_id, ids (little-endian 32-bit ids of the whole text, then ``end_id``), row by row in the order of the input.

    Null texts count as empty. Other columns are not used.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                texts = Texts(part.column("text"))
                flat, bounds = encoder.ids(texts.data, texts.off, end)
                ids = pa.Array.from_buffers(pa.large_binary(), texts.n, [None, pa.py_buffer(4 * bounds), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")
