"""SentencePiece encoding and decoding with a table of distinct chunks.

In a model whose pieces never hold a whitespace marker behind another character, no merge can cross the
start of a run of markers. A marked text is then a sequence of chunks (a run of markers and the characters
up to the next run) that are segmented independently: each task segments every distinct chunk once, keeps
it in a table, and puts the ids back by position. The table is bounded; beyond the bound it starts anew,
which repeats work and changes no result. Texts pass through narrow tasks: nothing is shuffled, and a lost
executor costs the tasks that it ran.

A model without that property, or with another normalizer, is applied to whole texts instead.

Defined results: a null text counts as empty; an empty text has no ids and decodes to ""; texts and single
chunks may be of any length; rows are encoded one by one, so repeated rows and null or repeated ids come
back as they are; an empty table gives no rows; further columns pass through untouched unless they carry
the name of a result column, which replaces them. U+2581 in a text is a marker, as for the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Distinct chunks, and characters of them, that a task keeps from one slice to the next.
MAX_CHUNKS, MAX_CHARS = 400_000, 8_000_000
#: Rows of a batch are handled in slices of about so many characters.
SLICE_CHARS = 2_000_000
_CHUNK = re.compile(r" +[^ ]*")


class _Table(dict):
    """Chunk to row number; a chunk that isn't there yet gets the next one."""

    def __init__(self):
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return n

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new


class ChunkEncoder:
    """Encodes and decodes texts as the library does, by way of the chunk table."""

    def __init__(self, model: bytes, max_chunks: int = MAX_CHUNKS):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.max_chunks = max_chunks
        self._clear()
        self.marker = self.library.piece_to_id(MARK)
        self.splits = self._splits()

    def _splits(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        n = proto.normalizer_spec
        plain = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
        return plain and not proto.trainer_spec.treat_whitespace_as_suffix and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the offsets at which each text's begin."""
        if not self.splits:
            found = self.library.encode(texts, num_threads=1)
            return _joined(found)
        rows = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.table) > self.max_chunks or self.table.chars > MAX_CHARS:
            self._clear()
        # The join by position: each chunk's row of the table.
        at = np.fromiter(map(self.table.__getitem__, chain.from_iterable(rows)), np.int64)
        new = self.table.take_new()
        # The library puts a marker before every text it gets; a lone marker is the one chunk it can't be asked for.
        ids = [i or [self.marker] for i in self.library.encode([c[1:] for c in new], num_threads=1)]
        flat, ends = _joined(ids)
        self.starts = np.concatenate([self.starts, ends[:-1] + len(self.ids)])
        self.sizes = np.concatenate([self.sizes, np.diff(ends)])
        self.ids = np.concatenate([self.ids, flat])
        sizes = self.sizes[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        out = self.ids[np.repeat(self.starts[at] - before[:-1], sizes) + np.arange(before[-1])]
        return out, before[np.concatenate([[0], np.cumsum([len(row) for row in rows], dtype=np.int64)])]

    def _clear(self) -> None:
        self.table = _Table()
        self.ids = np.zeros(0, np.int32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(i) if i else "" for i in ids]


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    return np.fromiter(chain.from_iterable(lists), np.int32, count=ends[-1]), ends


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def _model_bytes(model: str) -> bytes:
    """The model file, read where the driver runs; tasks get its bytes (about a megabyte), not a path."""
    return Path(model).read_bytes()


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with ids, array<int>: the text as the library encodes it, without begin or end ids; and, if
    a name is given for decoded, with the string that the library decodes from those ids."""
    docs = docs.drop(ids, *([decoded] if decoded else []))
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    fields = [*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))

    names, model_bytes = [f.name for f in kept], _model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(model_bytes)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for a, b in _slices([len(t) for t in texts], SLICE_CHARS):
                flat, at = encoder.encode(texts[a:b])
                columns = {name: batch.column(name).slice(a, b - a) for name in names}
                columns[ids] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                if decoded:
                    columns[decoded] = pa.array(encoder.decode([flat[i:j].tolist() for i, j in zip(at, at[1:], strict=False)]), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, T.StructType(fields))


def decode(rows: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with decoded: the string that the library decodes from the ids (null or none: "")."""
    rows = rows.drop(decoded)
    model_bytes = _model_bytes(model)
    schema = T.StructType([*rows.schema.fields, T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(model_bytes)
        for batch in batches:
            strings = encoder.decode([i or [] for i in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | {decoded: pa.array(strings, pa.string())})

    return rows.mapInArrow(run, schema)
