"""What several of the text operators need: batch mapping, label reading, folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.functions.columns import quoted
from tablewright.functions.lineage import cut_lineage

__all__ = ["Memory", "cut_lineage", "keep_texts", "map_texts", "held_out", "id_and_text"]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, under fixed names, so that no other column can clash."""
    return docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most_bytes`` of text, so that long texts do not add up in memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > most_bytes and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str) -> DataFrame:
    """(doc_id, what ``make()(texts)`` gives) for every row; one row in, one row out, no shuffle.

    ``make`` is called once per task and builds the function, so that tables and caches are built there.
    """
    base = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", base)] + T.StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(out)

    def run(batches):
        score = make()
        for batch in batches:
            for part in slices(batch, 1):
                found = score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(arrow.field(0).type)]
                    + [pa.array(found[f.name], type=f.type) for f in list(arrow)[1:]], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def keep_texts(docs: DataFrame, make: Callable[[], Callable[[list], list]], text_col: str = "text") -> DataFrame:
    """The rows, all columns untouched, for whose text ``make()(texts)`` says true; no join, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        verdict = make()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(verdict(part.column(at).to_pylist()), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text has this remainder; a null id counts as the text of an empty id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


#: characters that a memory holds for each word of its size; words of ordinary texts stay below
CHARS_A_WORD = 12


class Memory:
    """What a process has computed for words; it keeps those in use. It holds at most twice ``size`` words and twice
    ``size * CHARS_A_WORD`` characters, and what one call brings: texts without spaces are words of thousands of characters."""

    def __init__(self, size: int):
        self.size, self.young, self.old, self.chars = size, {}, {}, 0

    def missing(self, words) -> list:
        """The words without a value, each once; afterwards all others are in ``young``."""
        young, old = self.young, self.old
        unseen = {w for w in words if w not in young}
        if not unseen:
            return []
        chars = sum(map(len, unseen))
        if young and (len(young) + len(unseen) > self.size or self.chars + chars > self.size * CHARS_A_WORD):
            self.old, self.young, self.chars = young, {}, 0
            young, old = self.young, self.old
            unseen = set(words)
            chars = sum(map(len, unseen))
        self.chars += chars
        found = {w: old[w] for w in unseen if w in old}
        young.update(found)
        return [w for w in unseen if w not in found]
