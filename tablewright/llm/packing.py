"""Packing tokenised documents into sequences by the sum-of-squares rule.

Every task packs its own documents online. A document fills whole sequences as long as it can; its remainder
goes to an open sequence of that fill level which leaves the smallest sum of squared counts of open sequences
per level (opening a new one is level 0). An array holds the counts, so a step looks at one array of at most
``capacity`` levels. What is still open when a task ends is closed by cutting its pieces into full sequences, so a
task leaves one short sequence at most. Nothing is shuffled and nothing passes through the driver.

Null and empty texts hold the end id only. Rows with equal ids are packed as separate documents.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from tablewright.llm.shared import id_and_text, slices

CAPACITY, END_ID = 1024, 0
SCHEMA = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
#: sequence ids of a task begin at its partition number times this
TASK_STRIDE = 1 << 40


class WordEncoder:
    """Token ids of texts, as little-endian 32-bit bytes.

    The vocabulary's ids are its merge order, so texts go through the faster of the two libraries that apply it. It knows
    no special tokens, and its pattern fails on runs of some hundred thousand blanks: such texts go through the other.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        # printable stand-ins of the byte-level alphabet: the printable bytes, then the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in self.special}
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:
            return self.whole(text)

    def __call__(self, texts: list) -> list[bytes]:
        return [self.one(t) for t in texts]


@lru_cache(4)
def encoder(path: str) -> WordEncoder:
    """One for the process, so that the tasks of a worker share its tables."""
    return WordEncoder(path)


class Packer:
    """Open sequences by fill level and the counts of them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity)]  # sequence numbers at each level
        self.next = 0
        self.begun: dict[int, list] = {}  # pieces of open sequences
        self.out: list[tuple] = []

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc: int, size: int) -> None:
        """All tokens of one document: whole sequences first, then the remainder by the rule."""
        at = 0
        while size - at >= self.capacity:
            self.out.append((doc, at, self.capacity, self.fresh(), 0))
            at += self.capacity
        rest = size - at
        if not rest:
            return
        # moving a sequence from level h to h + rest changes the sum of squares by 2·(N[h + rest] − N[h]) + 2
        room = self.capacity - rest
        change = 2 * (self.level[rest:] - self.level[:room + 1]) + 2
        change[-1] = 1 - 2 * self.level[room] if room else 0  # a full sequence is not counted any more
        change[1:][self.level[1:room + 1] == 0] = 1 << 60
        change[0] = 2 * self.level[rest] + 1 if room else 0
        # of equal changes the fullest sequence
        h = room - int(np.argmin(change[::-1]))
        if h:
            seq = self.open[h].pop()
            self.level[h] -= 1
        else:
            seq = self.fresh()
        pieces = self.begun.pop(seq, []) + [(doc, at, rest, seq, h)]
        if h + rest == self.capacity:
            self.out += pieces
        else:
            self.begun[seq] = pieces
            self.open[h + rest].append(seq)
            self.level[h + rest] += 1

    def close(self) -> None:
        """Open sequences, fullest first, filled up with cut pieces of the emptiest ones."""
        order = sorted(self.begun.items(), key=lambda x: (-sum(p[2] for p in x[1]), x[0]))
        queue = [p[:3] for _, pieces in order for p in pieces]
        seq, fill = self.fresh(), 0
        for doc, at, size in queue:
            while size:
                if fill == self.capacity:
                    seq, fill = self.fresh(), 0
                take = min(size, self.capacity - fill)
                self.out.append((doc, at, take, seq, fill))
                fill, at, size = fill + take, at + take, size - take
        self.begun = {}


def packed(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it begins there, its length and checksum, its sequence and place in it."""
    source = id_and_text(docs, id_col, text_col)
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    out = T.StructType([source.schema["doc_id"]] + T.StructType.fromDDL(SCHEMA).fields)
    arrow = to_arrow_schema(out)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(path)
        packer = Packer(capacity)
        base = TaskContext.get().partitionId() * TASK_STRIDE
        # ids of documents that still have pieces in open sequences; of their tokens only what is left
        held: dict[int, tuple] = {}
        number = 0

        def emit():
            rows = []
            for doc, at, size, seq, offset in packer.out:
                doc_id, data, skipped = held[doc]
                part = data[(at - skipped) * 4:(at - skipped + size) * 4]
                rows.append((doc_id, at, size, zlib.crc32(part), skipped + len(data) // 4, base + seq, offset))
            packer.out = []
            columns = list(zip(*rows)) if rows else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, data in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    data += end
                    held[number] = (doc_id, data, 0)
                    packer.add(number, len(data) // 4)
                    number += 1
                yield emit()
                waiting = {p[0]: p[1] for pieces in packer.begun.values() for p in pieces}
                held = {d: (held[d][0], held[d][1][(at - held[d][2]) * 4:], at) for d, at in waiting.items()}
        packer.close()
        yield emit()

    return source.mapInArrow(run, out)
