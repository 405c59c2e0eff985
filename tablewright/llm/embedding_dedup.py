"""Near-duplicate vectors by an inverted multi-index.

A codebook for each half of the vectors makes a grid of cells, one for each pair of codewords. A vector is stored in the cell
of its two nearest codewords. As a query it goes to the cells of the multi-sequence traversal: for every codeword, a cost is how
far the vector would have to move to change to it, and the traversal reaches the cells whose sum of the two squares is at most
2 - 2 cos, the squared length of the longest link: a linked vector lies beyond the planes between the codewords, so none is
farther than that, whatever the directions in which the data differ. The search is exact. Pairs that meet are first bounded by
their dot product along few axes and the lengths of what is left of both, then verified by cosine in double precision.

Vectors link with vectors of their own length only; every length has its own codebooks and cells.

Equal vectors are one class from the start, with a key of its own: rows that share a vec_id and hold different vectors are
different vectors, each with its own links, and count as many; components are found over keys, ids are put in at the end.

Vectors are shuffled once. They lie in blocks, runs of cells of about ``NUMBERS`` numbers; a cell with a third of all vectors is
many blocks. Blocks are written to the shared checkpoint folder, and each pair of blocks is one task that reads the two from
there, so nothing that is shuffled or written grows with the pairs. Links are summed where they meet, without writing pairs out.

Null, empty and zero vectors and vectors with null or non-finite components link with nothing; very large and very small
components neither overflow nor vanish, because vectors are scaled by a power of two first. A null vec_id is returned with a null component and no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.functions.columns import quoted
from tablewright.llm.components import connected_components, roots_of, with_least
from tablewright.llm.shared import cut_lineage

COSINE, CODEWORDS = 0.95, 16
#: added to the limit of the traversal for the rounding of unit vectors and distances
ROUNDING = 1e-9
#: the same for bounds in single precision
COARSE = 1e-4
#: rows that the codebooks are fitted on, shared by the lengths; a length with at most FEW vectors is one cell
SAMPLE, FEW = 10_000, 64
#: numbers of the vectors of a block; less where that gives fewer than PARTS blocks, but not below LEAST
NUMBERS, PARTS, LEAST = 1 << 21, 8, 1 << 16
#: pairs that are bounded at once, and links that are held until they are added up
AREA, HELD = 1 << 19, 1 << 21
#: bits of the hash that place a vector inside its cell's share of the blocks
PLACES = 20
BLOCKS = "first long, n int, cells array<long>, ends array<long>, vectors binary, copies binary, rep binary, h binary"
LINKS_ARROW = pa.schema([(n, pa.int64()) for n in ("key", "links", "root")])


def fingerprint(v: Column) -> Column:
    """What rows find the class of their vector by; where two classes share it, they go by the vector itself."""
    return F.xxhash64(v)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; a power of two is taken out first, which changes no digit and keeps squares finite."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :], 0)


def codebook(x: np.ndarray, size: int, rounds: int = 15, seed: int = 2) -> np.ndarray:
    """Lloyd's k-means; words without vectors stay where they are."""
    distinct = np.unique(x, axis=0)
    words = distinct[np.random.default_rng(seed).permutation(len(distinct))[:size]].copy()
    for _ in range(rounds):
        near = squares(x, words).argmin(1)
        for k in range(len(words)):
            if (near == k).any():
                words[k] = x[near == k].mean(0)
    return words


class Index:
    def __init__(self, sample: np.ndarray, codewords: int = CODEWORDS, cosine: float = COSINE):
        half = sample.shape[1] // 2
        self.half = half
        self.books = [codebook(sample[:, :half], codewords), codebook(sample[:, half:], codewords)]
        self.limit = 2 - 2 * cosine + ROUNDING

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of every vector, and for every cell whether the vector goes there: cells after its own (by number) only."""
        costs, near = [], []
        for part, words in zip((x[:, :self.half], x[:, self.half:]), self.books):
            d = squares(part, words)
            own = d.argmin(1)
            gap = np.sqrt(squares(words, words))[own]
            # distance to the plane between the own codeword and the other one
            cost = np.where(gap > 0, (d - d.min(1, keepdims=True)) / (2 * np.maximum(gap, 1e-12)), 0.0) ** 2
            costs.append(cost)
            near.append(own)
        width = len(self.books[1])
        cell = near[0] * width + near[1]
        # for each codeword of the first half those of the second that are still within the limit
        reached = (costs[1][:, None, :] <= (self.limit - costs[0])[:, :, None]).reshape(len(x), -1)
        return cell, reached & (np.arange(reached.shape[1]) > cell[:, None])


def halves(u: np.ndarray) -> np.ndarray:
    """Unit vectors that can be cut in two."""
    return u if u.shape[1] > 1 else np.repeat(u, 2, 1) / np.sqrt(2)


def leading_axes(sample: np.ndarray, seed: int = 2) -> np.ndarray | None:
    """A quarter as many orthonormal axes as the vectors are long, near those of the most weight; none for short vectors."""
    n = sample.shape[1]
    if n < 32:
        return None
    return np.linalg.qr(sample.T @ (sample @ np.random.default_rng(seed).normal(size=(n, n // 4))))[0]


class Block:
    """Vectors of one length, ordered by cell."""

    def __init__(self, row: dict, kind: str, index: Index | None, axes: np.ndarray | None):
        self.vectors = unit(np.frombuffer(row["vectors"], kind).reshape(-1, row["n"]).astype(np.float64))
        self.copies = np.frombuffer(row["copies"], "<i8")
        self.first, size = row["first"], len(self.vectors)
        self.starts, self.ends = [0, *row["ends"][:-1]], row["ends"]
        self.cells, self.index = row["cells"], index
        self.cell = np.repeat(self.cells, np.diff([0, *self.ends]))
        self.keys = self.first + np.arange(size)
        self.bounds = None
        if axes is not None:
            head = self.vectors @ axes
            tail = np.sqrt(np.maximum(1 - (head * head).sum(1, keepdims=True), 0))
            self.bounds = np.hstack([head, tail]).astype(np.float32)

    def visitors(self) -> np.ndarray | None:
        return None if self.index is None else self.index.place(halves(self.vectors))[1]


class Links:
    """Links and components of ``size`` vectors, added up as pairs come; memory does not grow with the pairs."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.n = copies, len(copies)
        self.links, self.root = np.zeros(self.n), np.arange(self.n)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.pairs = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.held.append((left, right))
        self.pairs += len(left)
        if self.pairs >= HELD:
            self.close()

    def close(self) -> None:
        if self.held:
            left, right = (np.concatenate(x) for x in zip(*self.held))
            self.links += np.bincount(left, weights=self.copies[right], minlength=self.n)
            self.links += np.bincount(right, weights=self.copies[left], minlength=self.n)
            joined = np.flatnonzero(self.root != np.arange(self.n))
            self.root = roots_of(self.n, np.concatenate([left, joined]), np.concatenate([right, self.root[joined]]))
            self.held, self.pairs = [], 0


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a mask with few hits holds, as places in its flat form: eight at a time are looked at first."""
    flat = mask.ravel()
    even = len(flat) // 8 * 8
    some = (8 * np.flatnonzero(flat[:even].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([some[flat[some]], even + np.flatnonzero(flat[even:])])


def _near(a: Block, rows: np.ndarray, b: Block, start: int, end: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of some rows of ``a`` with a run of rows of ``b`` whose cosine is large enough."""
    for low in range(start, end, AREA // 64):
        high = min(end, low + AREA // 64)
        step = max(64, AREA // (high - low))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            if a.bounds is not None:
                hit = _places(a.bounds[some] @ b.bounds[low:high].T >= cosine - COARSE)
                if not len(hit):
                    continue
                if 8 * len(hit) < len(some) * (high - low):
                    i, j = some[hit // (high - low)], low + hit % (high - low)
                    found = np.einsum("ij,ij->i", a.vectors[i], b.vectors[j]) >= cosine
                    yield i[found], j[found]
                    continue
            i, j = np.nonzero(a.vectors[some] @ b.vectors[low:high].T >= cosine)
            yield some[i], low + j


def _links(a: Block, b: Block, cosine: float, first: int) -> pa.RecordBatch:
    """Links of the vectors of ``a`` with those of ``b``, a block that comes after it or the same; ``first`` is the number of the length's first cell."""
    same = a.first == b.first
    shift = 0 if same else len(a.keys)
    keys, copies = (a.keys, a.copies) if same else (np.concatenate([a.keys, b.keys]), np.concatenate([a.copies, b.copies]))
    out, visitors = Links(copies), a.visitors()
    for cell, start, end in zip(b.cells, b.starts, b.ends):
        inside = np.flatnonzero(a.cell == cell)
        away = np.zeros(0, np.int64) if visitors is None else np.flatnonzero(visitors[:, cell - first])
        for i, j in _near(a, away, b, start, end, cosine):
            out.add(i, shift + j)
        for i, j in _near(a, inside, b, start, end, cosine):
            keep = slice(None) if not same else i < j
            out.add(i[keep], shift + j[keep])
    out.close()
    hit = np.flatnonzero(out.links)
    return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (keys, out.links.astype(np.int64), keys[out.root])], schema=LINKS_ARROW)


def linked_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                   codewords: int = CODEWORDS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    source = table.select(quoted(id_col).alias("vec_id"), quoted(vector_col).alias("v"))
    single = isinstance(source.schema["v"].dataType, T.ArrayType) and isinstance(source.schema["v"].dataType.elementType, T.FloatType)
    number, kind = ("float", "<f4") if single else ("double", "<f8")
    source = source.withColumn("v", F.col("v").cast(f"array<{number}>"))
    id_type = source.schema["vec_id"].dataType
    good = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce((F.col("vec_id").isNotNull()) & (F.size("v") > 0) & good, F.lit(False))
    # a sum with 0 has no negative zero: equal vectors have equal bytes and fingerprints
    plain = F.transform("v", lambda x: x + F.lit(0).cast(number))
    marked = source.select("vec_id", F.when(usable, plain).alias("v"))
    given = marked.where("v IS NOT NULL").withColumn("h", fingerprint(F.col("v")))
    lengths = {r.n: r.total for r in given.groupBy(F.size("v").alias("n")).agg(F.approx_count_distinct("h", 0.02).alias("total")).collect()}
    alone = marked.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not lengths:
        return alone.withColumn("kept", F.lit(True))
    many = sorted(n for n, count in lengths.items() if count > FEW)
    share = max(FEW, SAMPLE // max(1, len(many)))
    drawn: dict[int, list] = {n: [] for n in many}
    if many:
        quota = F.broadcast(source.sparkSession.createDataFrame([(n, lengths[n]) for n in many], "n int, total long"))
        for r in (given.withColumn("n", F.size("v")).join(quota, "n").where(F.pmod("h", "total") < share)
                  .select("n", "v").distinct().collect()):
            drawn[r.n].append(r.v)
    samples = {n: unit(np.array(sorted(v), np.float64)) for n, v in drawn.items() if v}
    indexes = {n: Index(halves(x), codewords, cosine) for n, x in samples.items()}
    axes = {n: leading_axes(x) for n, x in samples.items()}

    # Every cell has a share of the numbers, as the sample tells; cells in order, of one length after the other, are cut into blocks.
    # Cells of a length are numbered after those of shorter ones.
    names, widths = [], []
    for n, count in sorted(lengths.items()):
        held = np.ones(1)
        if n in indexes:
            held = np.bincount(indexes[n].place(halves(samples[n]))[0], minlength=codewords ** 2) + 0.5
        names.append(n * codewords ** 2 + np.arange(len(held)))
        widths.append(np.ceil(held / held.sum() * n * count).astype(np.int64))
    names, widths = np.concatenate(names), np.concatenate(widths)
    starts, total = np.cumsum(widths) - widths, int(widths.sum())
    parts = max(-(-total // NUMBERS), min(PARTS, -(-total // LEAST)))

    def place(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            sizes = rows.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes).tolist():
                some = rows.filter(pa.array(sizes == n))
                v = some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(kind)
                cell = indexes[n].place(halves(unit(v.astype(np.float64))))[0] if n in indexes else np.zeros(len(v), np.int64)
                cell += n * codewords ** 2
                at, h = np.searchsorted(names, cell), some.column("h").to_numpy()
                # what is added stays below the width, so blocks rise with cells
                part = (starts[at] + ((h & ((1 << PLACES) - 1)) * widths[at] >> PLACES)) * parts // total
                one = pa.table({"part": pa.array(part, pa.int32()), "cell": pa.array(cell, pa.int64()), "h": pa.array(h),
                                "v": pa.array([x.tobytes() for x in v], pa.binary()), "rep": some.column("rep"), "copies": pa.array(np.ones(len(v), np.int64))})
                yield from merged(one).to_batches()

    def merged(rows: pa.Table) -> pa.Table:
        """Equal vectors as one."""
        out = rows.group_by(["part", "cell", "h", "v"]).aggregate([("rep", "min"), ("copies", "sum")])
        return out.rename_columns(["part", "cell", "h", "v", "rep", "copies"])

    arrow = to_arrow_schema(T.StructType.fromDDL(BLOCKS))

    def pack(batches):
        held, few = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(x.num_rows for x in held) > 2 * few + 50_000:
                held = [merged(pa.concat_tables(held))]
                few = held[0].num_rows
        if not held:
            return
        rows = merged(pa.concat_tables(held)).sort_by("cell")
        first = rows.column("part")[0].as_py() << 33
        length = rows.column("cell").to_numpy() // codewords ** 2
        at = 0
        while at < len(length):
            n = int(length[at])
            end = min(int(np.searchsorted(length, n, "right")), at + max(1, 2 * NUMBERS // n))
            some = rows.slice(at, end - at)
            cells, counts = np.unique(some.column("cell").to_numpy(), return_counts=True)
            values = [first + at, n, cells, np.cumsum(counts), b"".join(some.column("v").to_pylist()),
                      *(some.column(c).to_numpy().astype("<i8").tobytes() for c in ("copies", "rep", "h"))]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, arrow)], schema=arrow)
            at = end

    dealt = given.select(F.col("vec_id").cast("long").alias("rep"), "v", "h").mapInArrow(
        place, "part int, cell long, h long, v binary, rep long, copies long").repartitionById(parts, "part")
    blocks = cut_lineage(dealt.mapInArrow(pack, BLOCKS))

    def unpack(batches, with_vectors: bool = False):
        for batch in batches:
            for r in batch.to_pylist():
                h = np.frombuffer(r["h"], "<i8")
                columns = [r["first"] + np.arange(len(h)), np.frombuffer(r["rep"], "<i8"), np.frombuffer(r["copies"], "<i8"), h]
                arrays, fields = [pa.array(x) for x in columns], ["key", "rep", "copies", "h"]
                if with_vectors:
                    numbers = pa.array(np.frombuffer(r["vectors"], kind))
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * r["n"], pa.int32()), numbers))
                    fields.append("v")
                yield pa.RecordBatch.from_arrays(arrays, fields)

    def meet(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                a, b = ({c: row[f"{side}_{c}"] for c in ("first", "n", "cells", "ends", "vectors", "copies")} for side in "ab")
                n = a["n"]
                a, b = (Block(x, kind, indexes.get(n), axes.get(n)) for x in (a, b))
                yield _links(a, b, cosine, n * codewords ** 2)

    sides = [blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("first", "n", "cells", "ends", "vectors", "copies")]) for side in "ab"]
    # a task reads two partitions of the checkpoint, whatever their size is thought to be
    pairs = sides[0].hint("shuffle_replicate_nl").join(sides[1], F.expr("a_n = b_n AND a_first <= b_first"))
    found = cut_lineage(pairs.mapInArrow(meet, "key long, links long, root long"))
    classes = blocks.mapInArrow(unpack, "key long, rep long, copies long, h long")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).join(
        classes.select(F.col("key").alias("node"), "rep"), "node")
    labels = with_least(labels.select(F.col("component").alias("u"), F.col("rep").alias("v"), "node")).select(
        F.col("node").alias("key"), F.col("m").alias("component"))
    by = ["h"]
    if not classes.groupBy("h").count().where("count > 1").isEmpty():
        by.append("v")
        classes = blocks.mapInArrow(lambda batches: unpack(batches, True), f"key long, rep long, copies long, h long, v array<{number}>")
    per_class = classes.join(links, "key", "left").join(labels, "key", "left").select(
        *by, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = given.select("vec_id", *by).join(per_class, by).select("vec_id", "n_links", F.col("component_id").cast(id_type).alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
