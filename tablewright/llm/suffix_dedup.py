"""Removing passages that a document with a smaller id holds too, by sorting suffixes.

Every 50 bytes hold an anchor: a 28-byte string whose smallest 5-byte hash stands at one of its ends, a property
of the string alone. So equal passages have equal anchors, and only the surroundings of anchors that stand in two
documents have to be compared.

1. Documents are dealt into chunks. A chunk sends the anchors it holds, as sorted short hashes, to partitions of the
   hash range, which answer one bit each: is it in another document as well. A false yes costs work, no result.
2. For those, the chunk sends each distinct surrounding (22 bytes before, 50 from the anchor on) once, with the
   smallest id that has it. Per anchor, the suffixes are put in order by a mergesort whose comparisons find the common
   extension by binary search over prefix polynomial hashes; so are the reversed prefixes. Neighbours are
   verified byte by byte, a wrong order (a hash collision) is sorted again from the bytes. The common extensions of neighbours
   tell for every 50-byte window around the anchor which surroundings share it, and so its smallest id.
3. The chunk gets one bit for each window and removes what the windows cover.

A passage in very many documents is one surrounding in each chunk, so it makes no partition hot.

Null texts are empty. Rows with equal ids do not count against each other. Rows with a null id are left as they are
and remove nothing elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.functions.columns import quoted

LENGTH = 50
ANCHOR, CORE = 28, 5  # 2 * ANCHOR - CORE - 1 = LENGTH
BEFORE = LENGTH - ANCHOR
WIDTH = BEFORE + LENGTH
CHUNKS = 2
SLICE = 1 << 20
KEY_BITS = 40
BASE = 0x9E3779B97F4A7C15
_symbols = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of the ``size`` bytes from each place on."""
    h = np.zeros(max(0, len(data) - size + 1), np.uint64)
    for k in range(size):
        h = h * np.uint64(BASE) + _symbols[data[k:k + len(h)]]
    return h


def anchor_places(data: np.ndarray) -> np.ndarray:
    """Places of the anchors in these bytes."""
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    core = (mix(rolling(data, CORE)) >> np.uint64(32)).astype(np.uint32)
    least, span = core, 1  # over 24 neighbours: 16 and 8
    eight = None
    while span < 16:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
        eight = least if span == 8 else eight
    both = np.minimum(least[:n], eight[16:16 + n])
    return np.flatnonzero((both == core[:n]) | (both == core[ANCHOR - CORE:ANCHOR - CORE + n]))


class Chunk:
    """Texts of one chunk, looked at in slices of about a megabyte."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.data = [(t or "").encode("utf-8", "surrogatepass") if i is not None else b"" for i, t in zip(ids, texts)]
        self.groups, group, size = [], [], 0
        for i, d in enumerate(self.data):
            if len(d) >= LENGTH:
                group.append(i)
                size += len(d)
            if size >= SLICE or i == len(self.data) - 1:
                if group:
                    self.groups.append(np.array(group))
                group, size = [], 0
        #: anchors and their documents, slice by slice; looked for once
        self.anchors: list[tuple[np.ndarray, np.ndarray]] = []

    def slices(self):
        """(numbers of the documents, all bytes, first byte of each document and the end, anchors, document of each)."""
        for k, group in enumerate(self.groups):
            data = np.frombuffer(b"".join(self.data[g] for g in group), np.uint8)
            first = np.concatenate([[0], np.cumsum([len(self.data[g]) for g in group])])
            if k == len(self.anchors):
                at = anchor_places(data)
                doc = np.searchsorted(first, at, "right") - 1
                inside = at + ANCHOR <= first[doc + 1]
                self.anchors.append((at[inside].astype(np.uint32 if len(data) < 1 << 32 else np.int64), doc[inside].astype(np.uint32)))
            at, doc = (x.astype(np.int64) for x in self.anchors[k])
            yield group, data, first, at, doc

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Short hash and document of every anchor, in order."""
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for group, data, _, at, doc in self.slices():
            h = np.zeros(len(at), np.uint64)
            for k in range(ANCHOR):
                h = h * np.uint64(BASE) + _symbols[data[at + k]]
            keys.append(mix(h) >> np.uint64(64 - KEY_BITS))
            docs.append(group[doc])
        return np.concatenate(keys), np.concatenate(docs)

    def surroundings(self, shared: np.ndarray):
        """For the anchors marked as shared: surroundings (bytes before and from the anchor on, padded), usable bytes on
        either side, number of the document, place there."""
        seen = 0
        for group, data, first, at, doc in self.slices():
            use = shared[seen:seen + len(at)]
            seen += len(at)
            at, doc = at[use], doc[use]
            left = np.minimum(at - first[doc], BEFORE)
            right = np.minimum(first[doc + 1] - at, LENGTH)
            places = at[:, None] + np.arange(-BEFORE, LENGTH)[None, :]
            text = data[np.clip(places, 0, len(data) - 1)]
            text[(places < (at - left)[:, None]) | (places >= (at + right)[:, None])] = 0
            yield text, left.astype(np.uint8), right.astype(np.uint8), group[doc], at - first[doc]

    def distinct(self, shared: np.ndarray):
        """Distinct surroundings in a fixed order, the smallest id of each, and for every member its class and place."""
        parts = list(self.surroundings(shared))
        if not parts:
            parts = [(np.zeros((0, WIDTH), np.uint8), *(np.zeros(0, np.uint8),) * 2, *(np.zeros(0, np.int64),) * 2)]
        hashes = []
        for text, left, right, _, _ in parts:
            h = left.astype(np.uint64) * np.uint64(64) + right.astype(np.uint64)
            for k in range(WIDTH):
                h = h * np.uint64(BASE) + _symbols[text[:, k]]
            hashes.append(mix(h))
        text, left, right, doc, at = (np.concatenate(x) for x in zip(*parts))
        _, pick, cls = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        # equal hashes of unequal bytes: those members become classes of their own
        odd = np.flatnonzero((text != text[pick[cls]]).any(1))
        if len(odd):
            cls[odd] = len(pick) + np.arange(len(odd))
            pick = np.concatenate([pick, odd])
        ids = np.array([-1 if i is None else i for i in self.ids], np.int64)[doc]
        least = np.full(len(pick), np.iinfo(np.int64).max)
        np.minimum.at(least, cls, ids)
        return text[pick], left[pick], right[pick], least, cls, doc, at, ids


# -- suffix sort

class Suffixes:
    """Strings of one width with prefix polynomial hashes; common extensions by binary search."""

    def __init__(self, text: np.ndarray):
        self.text, self.width = text, text.shape[1]
        self.prefix = np.zeros((len(text), self.width + 1), np.uint64)
        for k in range(self.width):
            self.prefix[:, k + 1] = self.prefix[:, k] * np.uint64(BASE) + _symbols[text[:, k]]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning; prefixes are equal if their hashes are."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.width)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = self.prefix[a, middle] == self.prefix[b, middle]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        at = np.minimum(n, self.width - 1)
        return (n < self.width) & (self.text[a, at] < self.text[b, at])

    def order(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mergesort inside each group (sorted group numbers): the order, and the common extension with the row before (0
        for the first of a group)."""
        n = len(group)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begin, n))
        base, length = np.repeat(begin, sizes), np.repeat(sizes, sizes)
        order, place = np.arange(n), np.arange(n) - base
        width = 1
        while n and width < sizes.max():
            # every row looks for its place in the neighbouring run; rows of the right run go behind equal ones
            run = place // width
            other = (run ^ 1) * width
            has = other < length
            mine, low = np.flatnonzero(has), np.zeros(n, np.int64)
            high = np.where(has, np.minimum(width, length - other), 0)
            right = (run & 1).astype(bool)
            while True:
                mine = mine[low[mine] < high[mine]]
                if not len(mine):
                    break
                middle = (low[mine] + high[mine]) // 2
                them = order[base[mine] + other[mine] + middle]
                own = order[base[mine] + place[mine]]
                before = np.where(right[mine], ~self.less(own, them), self.less(them, own))
                low[mine] = np.where(before, middle + 1, low[mine])
                high[mine] = np.where(before, high[mine], middle)
            target = base + (run & ~1) * width + (place - run * width) + low
            moved = np.empty_like(order)
            moved[target] = order
            order = moved
            width *= 2
        common = np.zeros(n, np.int64)
        if n > 1:
            common[1:] = self.common(order[:-1], order[1:])
            common[begin] = 0
            order, common = self.verified(order, common, begin, sizes)
        return order, common

    def verified(self, order, common, begin, sizes):
        """Byte by byte: neighbours agree as far as the hashes say and the next byte is larger."""
        a, b = self.text[order[:-1]], self.text[order[1:]]
        differs = a != b
        real = np.where(differs.any(1), differs.argmax(1), self.width)
        at = np.minimum(real, self.width - 1)[:, None]
        rising = (real == self.width) | (np.take_along_axis(a, at, 1) < np.take_along_axis(b, at, 1))[:, 0]
        inner = np.ones(len(order), bool)
        inner[begin] = False
        wrong = np.flatnonzero(inner[1:] & ((real != common[1:]) | ~rising)) + 1
        for g in np.unique(np.searchsorted(begin, wrong, "right") - 1):
            rows = order[begin[g]:begin[g] + sizes[g]]
            rows = rows[np.lexsort(self.text[rows].T[::-1])]
            order[begin[g]:begin[g] + sizes[g]] = rows
            d = self.text[rows[:-1]] != self.text[rows[1:]]
            common[begin[g] + 1:begin[g] + sizes[g]] = np.where(d.any(1), d.argmax(1), self.width)
        return order, common


def window_bits(text, left, right, least) -> np.ndarray:
    """Bit o of a row: another row holds the window that begins o bytes before the anchor, with a smaller id."""
    bits = np.zeros(len(text), np.uint32)
    h = np.zeros(len(text), np.uint64)
    for k in range(BEFORE, BEFORE + ANCHOR):
        h = h * np.uint64(BASE) + _symbols[text[:, k]]
    by = np.argsort(h, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]])) if len(by) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cut, len(by)))
    # only anchors that several surroundings hold, whole anchors together in blocks of bounded size
    many = np.repeat(sizes > 1, sizes)
    by, group = by[many], np.repeat(np.arange(len(cut)), sizes)[many]
    start = 0
    while start < len(by):
        stop = min(len(by), start + 40_000)
        if stop < len(by):
            same = np.searchsorted(group, group[stop])
            stop = same if same > start else np.searchsorted(group, group[stop], "right")
        rows, g = by[start:stop], group[start:stop]
        start = stop
        t, l, r, ids = text[rows], left[rows], right[rows], least[rows]
        after, ahead = Suffixes(t[:, BEFORE:]).order(g)
        back, behind = Suffixes(t[:, :BEFORE][:, ::-1]).order(g)
        found = np.zeros(len(rows), np.uint32)
        head = np.concatenate([[True], g[1:] != g[:-1]])
        right_class, left_class = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for o in range(BEFORE + 1):
            use = np.flatnonzero((l >= o) & (r >= LENGTH - o))
            if len(use) < 2:
                continue
            right_class[after] = np.cumsum(head | (ahead < LENGTH - o))
            left_class[back] = np.cumsum(head | (behind < o))
            key = right_class[use] * (len(rows) + 1) + left_class[use]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            smallest = np.minimum.reduceat(ids[use][order], first)
            smallest = np.repeat(smallest, np.diff(np.append(first, len(key))))
            found[use[order]] |= (smallest < ids[use][order]).astype(np.uint32) << np.uint32(o)
        bits[rows] = found
    return bits


# -- the Spark side

def _bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    edges = np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def _table(rows: list, schema: pa.Schema) -> pa.Table:
    if not rows:
        return schema.empty_table()
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _kept(chunk: Chunk, found: tuple, bits: np.ndarray):
    """(number of the document, kept bytes, removed, spans) of every document that loses something; ``found`` is what
    ``chunk.distinct`` gave."""
    text, left, right, least, cls, doc, at, ids = found
    valid = np.zeros(len(text), np.uint32)
    for o in range(BEFORE + 1):
        valid |= ((left >= o) & (right >= LENGTH - o)).astype(np.uint32) << np.uint32(o)
    # another member of the same class with a smaller id covers every window
    mine = np.where(ids > least[cls], valid[cls], bits[cls])
    hit = np.flatnonzero(mine)
    order = hit[np.argsort(doc[hit], kind="stable")]
    cuts = np.flatnonzero(np.concatenate([[True], doc[order][1:] != doc[order][:-1]])) if len(order) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(order)) if len(order) else []):
        members = order[a:b]
        number = int(doc[members[0]])
        data = np.frombuffer(chunk.data[number], np.uint8)
        edge = np.zeros(len(data) + 1, np.int64)
        for o in range(BEFORE + 1):
            starts = at[members[(mine[members] >> np.uint32(o)) & 1 == 1]] - o
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        yield number, data[~gone].tobytes(), int(gone.sum()), spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """The documents with repeated passages cut out of the text; with ``digest`` the id, counts and a hash instead.

    A character of which a passage takes only some bytes goes altogether from the text (the digest keeps its bytes).
    """
    source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text")) if digest else docs
    names = ["doc_id", "text"] if digest else [id_col, text_col]
    chunks = max(1, CHUNKS * source.rdd.getNumPartitions())
    id_, text = quoted(names[0]), quoted(names[1])
    chunk_col = "chunk"  # a name that no column of the documents has
    while chunk_col.lower() in {c.lower() for c in source.columns}:
        chunk_col = "_" + chunk_col
    dealt = source.withColumn(chunk_col, F.pmod(F.xxhash64(id_, F.octet_length(text)), F.lit(chunks)).cast("int"))
    ddl = {"ask": "bucket int, chunk int, kind int, body binary, more binary", "answer": "chunk int, bucket int, kind int, body binary"}
    ask, answer = (to_arrow_schema(T.StructType.fromDDL(d)) for d in ddl.values())
    out = T.StructType([source.schema["doc_id"]] + T.StructType.fromDDL(SCHEMA).fields) if digest else docs.schema
    arrow = to_arrow_schema(out)

    def tools():
        return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

    def chunk_of(table: pa.Table) -> Chunk:
        return Chunk(table.column(names[0]).to_pylist(), table.column(names[1]).to_pylist())

    def ask_anchors(table: pa.Table) -> pa.Table:
        pack, _ = tools()
        number, chunk = table.column(chunk_col)[0].as_py(), chunk_of(table)
        keys, doc = chunk.keys()
        unique, first, cls = np.unique(keys, return_index=True, return_inverse=True)
        ids = np.array([-1 if i is None else i for i in chunk.ids], np.int64)[doc]
        twice = np.zeros(len(unique), bool)  # in two documents of this chunk
        twice[cls[ids != ids[first][cls]]] = True
        at = _bounds(unique, chunks, KEY_BITS)
        rows = []
        for b in range(chunks):
            part = unique[at[b]:at[b + 1]]
            if len(part):
                steps = np.diff(part, prepend=np.uint64(0))
                rows.append((b, number, 0, pack(steps.tobytes() if steps.max() >> np.uint64(32) else steps.astype("<u4").tobytes()),
                             int(len(part)).to_bytes(8, "little") + pack(np.packbits(twice[at[b]:at[b + 1]]).tobytes())))
        return _table(rows, ask)

    def shared_anchors(table: pa.Table) -> pa.Table:
        pack, unpack = tools()
        keys, twice = [], []
        for body, more in zip(table.column("body").to_pylist(), table.column("more").to_pylist()):
            n, raw = int.from_bytes(more[:8], "little"), unpack(body)
            keys.append(np.cumsum(np.frombuffer(raw, "<u8" if len(raw) == 8 * n else "<u4").astype(np.uint64)))
            twice.append(np.unpackbits(np.frombuffer(unpack(more[8:]), np.uint8), count=n))
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        shared = np.bincount(place, weights=1.0 + np.concatenate(twice)) > 1
        ends, rows = np.cumsum([len(k) for k in keys]), []
        for c, b, e, k in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), ends, keys):
            rows.append((c, b, 0, int(len(k)).to_bytes(8, "little") + pack(np.packbits(shared[place[e - len(k):e]]).tobytes())))
        return _table(rows, answer)

    def bits_of(x: bytes) -> np.ndarray:
        return np.unpackbits(np.frombuffer(tools()[1](x[8:]), np.uint8), count=int.from_bytes(x[:8], "little")).astype(bool)

    def shared_of(chunk: Chunk, by_key: np.ndarray) -> np.ndarray:
        """Is each anchor of the chunk shared; the bits come by sorted distinct hash, whatever the order of the rows."""
        return by_key[np.unique(chunk.keys()[0], return_inverse=True)[1]]

    def ask_surroundings(table: pa.Table, answers: pa.Table) -> pa.Table:
        pack, _ = tools()
        if not table.num_rows:
            return ask.empty_table()
        number, chunk = table.column(chunk_col)[0].as_py(), chunk_of(table)
        parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist()))
        by_key = np.concatenate([np.zeros(0, bool)] + [bits_of(x) for _, x in parts])
        text, left, right, least, *_ = chunk.distinct(shared_of(chunk, by_key))
        bucket = _bucket(text, chunks)
        rows = [(number, number, 1, pack(np.packbits(by_key).tobytes()), int(len(by_key)).to_bytes(8, "little"))]
        for b in np.unique(bucket):
            own = bucket == b
            rows.append((int(b), number, 2, pack(text[own].tobytes()),
                         pack(left[own].tobytes() + right[own].tobytes() + least[own].astype("<i8").tobytes())))
        return _table(rows, ask)

    def compare(table: pa.Table) -> pa.Table:
        pack, unpack = tools()
        rows, parts, who = [], [], []
        for c, b, kind, body, more in zip(*(table.column(f.name).to_pylist() for f in (ask.field(i) for i in (1, 0, 2, 3, 4)))):
            if kind == 1:
                rows.append((c, b, 1, more + body))
            else:
                text = np.frombuffer(unpack(body), np.uint8).reshape(-1, WIDTH)
                n, more = len(text), unpack(more)
                parts.append((text, np.frombuffer(more[:n], np.uint8), np.frombuffer(more[n:2 * n], np.uint8),
                              np.frombuffer(more[2 * n:], "<i8")))
                who.append((c, b, n))
        if parts:
            bits = window_bits(*(np.concatenate(x) for x in zip(*parts)))
            for (c, b, n), e in zip(who, np.cumsum([w[2] for w in who])):
                rows.append((c, b, 2, pack(bits[e - n:e].astype("<u4").tobytes())))
        return _table(rows, answer)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        _, unpack = tools()
        chunk = chunk_of(table)
        parts = list(zip(answers.column("bucket").to_pylist(), answers.column("kind").to_pylist(), answers.column("body").to_pylist()))
        shared = shared_of(chunk, bits_of(next(x for _, kind, x in parts if kind == 1)))
        found = chunk.distinct(shared)
        text = found[0]
        bucket = _bucket(text, chunks)
        bits = np.zeros(len(text), np.uint32)
        for b, kind, x in parts:
            if kind == 2:
                bits[bucket == b] = np.frombuffer(unpack(x), "<u4")
        whole = [(t or "").encode("utf-8", "surrogatepass") for t in table.column(names[1]).to_pylist()]
        kept = [(d, 0, 0) for d in whole]
        for number, data, removed, spans in _kept(chunk, found, bits):
            kept[number] = (data, removed, spans)
        if digest:
            columns = [table.column("doc_id"), [len(d) for d in whole], [k[1] for k in kept], [k[2] for k in kept],
                       [hashlib.sha256(k[0]).hexdigest() for k in kept]]
            return pa.Table.from_arrays([c.combine_chunks().cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, type=f.type)
                                         for c, f in zip(columns, arrow)], schema=arrow)
        old = table.column(text_col).to_pylist()
        new = [t if not k[1] else k[0].decode("utf-8", "ignore") for t, k in zip(old, kept)]
        table = table.select([f.name for f in arrow])
        return table.set_column(table.column_names.index(text_col), arrow.field(text_col), pa.array(new, type=pa.string()).cast(arrow.field(text_col).type)).cast(arrow)

    by_chunk = dealt.groupBy(chunk_col)
    first = dealt.groupBy(chunk_col).applyInArrow(ask_anchors, ddl["ask"]).groupBy("bucket").applyInArrow(shared_anchors, ddl["answer"])
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(ask_surroundings, ddl["ask"])
    bits = second.groupBy("bucket").applyInArrow(compare, ddl["answer"])
    return dealt.groupBy(chunk_col).cogroup(bits.groupBy("chunk")).applyInArrow(finish, out)


def _bucket(text: np.ndarray, buckets: int) -> np.ndarray:
    """By the anchor's bytes alone."""
    h = np.zeros(len(text), np.uint64)
    for k in range(BEFORE, BEFORE + ANCHOR):
        h = h * np.uint64(BASE) + _symbols[text[:, k]]
    return (mix(h) % np.uint64(buckets)).astype(np.int64)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: bytes, removed bytes, removed runs and the hash of what is left."""
    return without_repeats(docs, id_col, text_col, digest=True)
