"""Bounded-space online packing of token ids into fixed windows.

Method
    A task holds at most OPEN_WINDOWS open windows. A document's ids (with the end id) are cut at the window length;
    whole windows leave at once, and the rest goes to the open window that it fills best. When it fits in none and
    all are in use, the fullest is emitted. What is still open at a task's end is written with the other pieces and
    merged afterwards: the open windows of MERGE_TASKS neighbouring tasks, a bounded number, are packed again
    by decreasing length. Ids stay in the task that made them; only leftovers' lengths are dealt out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm.common import kept, map_batches, materialize, prepare, task_count, texts

WINDOW = 1024
OPEN_WINDOWS = 64
MERGE_TASKS = 8
END_ID = 0
#: Pre-tokenizer of the byte-level vocabulary (a fixed value of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids by the ranks of a byte-level BPE file (its ids follow the order of its merges).

    The file's added tokens are found in a text before anything else, whatever stands beside them, and have their own ids, as in
    the file's own library. Added tokens that would take in the space beside them, or stand for whole words only, are refused.
    """

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        spec, alphabet = json.loads(vocabulary), byte_alphabet()
        added = {t["content"]: t for t in spec["added_tokens"]}
        if odd := [c for c, t in added.items() if t["lstrip"] or t["rstrip"] or t["single_word"]]:
            raise ValueError(f"added tokens with rules for their surroundings: {odd}")
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.own = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={c: t["id"] for c, t in added.items()})

    def __call__(self, text: str) -> np.ndarray:
        return self.own.encode_to_numpy(text, allowed_special="all")


def encoder(vocabulary: bytes) -> Encoder:
    return kept(("encoder", zlib.crc32(vocabulary)), lambda: Encoder(vocabulary))


class _Counts:
    def __init__(self, vocabulary, name: str) -> None:
        self.vocabulary, self.name = vocabulary, name

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(self.vocabulary.value)
        counts = [len(encode(t)) + 1 for t in texts(batch)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, self.name])


def _vocabulary(spark: SparkSession, tokenizer: str):
    with open(tokenizer, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # a file of fixed size


def with_token_counts(docs: DataFrame, tokenizer: str, name: str) -> DataFrame:
    """docs with a column of the number of token ids of text, with the end id, as pack() makes them; null texts have 1."""
    spark = prepare(docs.sparkSession)
    return map_batches(docs, _Counts(_vocabulary(spark, tokenizer), name), StructType([*docs.schema.fields, StructField(name, LongType())]))


class OpenWindows:
    """Best fit among a fixed number of open windows."""

    def __init__(self, most: int, length: int) -> None:
        self.length, self.free, self.held = length, np.full(most, -1, np.int64), [[] for _ in range(most)]

    def place(self, size: int, piece: tuple) -> list[tuple] | None:
        """Puts a piece of size ids in a window; the pieces of the window that had to be emitted for it, if any."""
        out = None
        fits = np.where(self.free >= size, self.free, self.length + 1)
        k = int(np.argmin(fits))
        if fits[k] > self.length:
            if (unused := np.flatnonzero(self.free < 0)).size:
                k = int(unused[0])
            else:
                k = int(np.argmin(self.free))
                out = self.held[k]
            self.free[k], self.held[k] = self.length, []
        self.held[k].append((*piece, self.length - int(self.free[k])))
        self.free[k] -= size
        if self.free[k] == 0:  # nothing fits any more
            full, self.held[k], self.free[k] = self.held[k], [], -1
            return [*(out or []), None, *full] if out else full
        return out

    def rest(self) -> list[list[tuple]]:
        return [x for x in self.held if x]


class _Pack:
    def __init__(self, vocabulary, length: int, most: int) -> None:
        self.vocabulary, self.length, self.most = vocabulary, length, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, made = encoder(self.vocabulary.value), TaskContext.get().partitionId(), 0
        windows, rows = OpenWindows(self.most, self.length), []

        def emit(pieces: list[tuple | None], still_open: bool) -> None:
            nonlocal made
            for p in [None, *pieces]:
                if p is None:
                    made += 1
                else:
                    rows.append((*p[:5], (task << 32) + made, p[5], still_open, task))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = np.append(encode(text), END_ID).astype("<u4")
                for at in range(0, len(ids), self.length):
                    cut = ids[at : at + self.length]
                    piece = (doc_id, at, len(cut), zlib.crc32(cut.tobytes()), len(ids))
                    if len(cut) == self.length:
                        emit([(*piece, 0)], False)
                    elif out := windows.place(len(cut), piece):
                        emit(out, False)
            if rows:
                yield _pieces(rows)
                rows = []
        for out in windows.rest():
            emit(out, True)
        if rows:
            yield _pieces(rows)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "still_open", "task"]
    kinds = [pa.int64()] * 7 + [pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _Merge:
    """Rows sorted by group, longest first: pieces packed again, a group at a time."""

    def __init__(self, length: int) -> None:
        self.length = length

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, free, ids = None, [], 0
        for batch in batches:
            cols = batch.to_pydict()
            sequence, offset = [], []
            for g, size in zip(cols["merge_group"], cols["length"], strict=True):
                if g != group:
                    group, free, ids = g, [], (1 << 62) + (g << 32)
                k = min((i for i, f in enumerate(free) if f >= size), key=free.__getitem__, default=-1)
                if k < 0:
                    free.append(self.length)
                    k = len(free) - 1
                sequence.append(ids + k)
                offset.append(self.length - free[k])
                free[k] -= size
            yield pa.RecordBatch.from_pydict({**{c: pa.array(cols[c], pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}, "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row for each piece of docs (columns doc_id, text; others are ignored): PIECE.

    tokenizer: path of a byte-level BPE file. Its added tokens are found in texts. Null and empty texts are one piece, the end id. A repeated row is packed
    as often as it occurs; a null doc_id stays null. Texts of any length are cut at the window. A sequence's offsets
    have no gaps. An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    rows = materialize(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_Pack(_vocabulary(spark, tokenizer), window, open_windows), f"{PIECE}, still_open boolean, task bigint"), "pieces")
    columns = [c.split()[0] for c in PIECE.split(", ")]
    left = rows.where("still_open").withColumn("merge_group", F.expr(f"task div {MERGE_TASKS}"))
    left = left.repartition(task_count(spark), "merge_group").sortWithinPartitions("merge_group", F.desc("length"), "doc_id", "start", "task", "sequence_id", "offset")
    return rows.where("not still_open").select(columns).unionByName(left.mapInArrow(_Merge(window), PIECE))
