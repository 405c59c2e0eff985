"""Similarity self-join of documents on word shingles, by chosen paths.

A set is embedded as a row of minhash values, one for each coordinate; two sets agree on a coordinate with the
probability of their Jaccard similarity. A run splits all sets on the values of a coordinate or two that it
draws, and every part with too many sets again on coordinates drawn for that part, so that similar sets are
expected to stay together on at least one path. Small parts are compared pair by pair. Runs are repeated until a pair at
the threshold is found with the target probability at the greatest depth.

* Documents with the same shingle set are one class from the start, so copies are never paired.
* A pair that meets in several parts is counted in the one with the smallest name only, which both sets
  know from their lists of parts; so links are counted without writing pairs out.
* Parts are compared on the minhash values first; the exact similarity is computed from the texts, for those members
  alone that have a candidate.
* A part that stays large at the greatest depth is cut into blocks, and pairs of blocks are tasks of their own.

Shingles are runs of five words (ASCII white space between words, case kept); shorter texts are one shingle. Null,
empty and white-space texts have no set and link with nothing. Rows with a null id are returned with no links and a
null class; rows with equal ids are taken as documents of the same id and link with each other if their texts do. An id with
different texts has the links and the class of each text in the row of that text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import connected_components, roots_of
from tablewright.llm.shared import cut_lineage, id_and_text, map_texts

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDINATES, DEPTH, SMALL, BLOCK = 64, 4, 64, 256
#: four standard deviations of the estimate from 64 values at the threshold
SLACK = 0.2
_seeds = np.random.default_rng(8).integers(1, 1 << 63, (2, COORDINATES), np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").split()
    n = max(1, len(found) - words + 1) if found else 0
    hashes = (xxhash.xxh3_64_intdigest(b" ".join(found[i:i + words])) for i in range(n))
    return np.unique(np.fromiter(hashes, np.uint64, n))


def minhash(sets: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 4096):
        h = sets[at:at + 4096, None] * _seeds[0][None, :]
        h ^= h >> np.uint64(29)
        out = np.minimum(out, (h * _seeds[1][None, :]).min(0))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def fanout(path: np.ndarray | int) -> int:
    """One coordinate, or two in a quarter of the parts: 1.25 on average, the inverse of the threshold."""
    return 2 if path % 4 == 0 else 1


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    found = 1.0
    for _ in range(depth):
        one = threshold * found
        found = 0.75 * one + 0.25 * (1 - (1 - one) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def _draw(path: int, k: int) -> int:
    return xxhash.xxh3_64_intdigest(path.to_bytes(8, "little", signed=True), seed=k)


def children(path: int, values: np.ndarray) -> list[int]:
    out = []
    for k in range(fanout(path & (2 ** 63 - 1))):
        c = _draw(path, k) % COORDINATES
        out.append(xxhash.xxh3_64_intdigest(np.array([path, c, values[c]], np.int64).tobytes()) - (1 << 63))
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    def make():
        def sketch(texts):
            out = {"digest": [], "sketch": [], "body": []}
            for t in texts:
                s = shingles(t)
                out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out["sketch"].append(minhash(s).tobytes() if len(s) else None)
                # Spark's xxhash64 of the text
                out["body"].append(xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), seed=42))
            out["body"] = np.array(out["body"], np.uint64).view(np.int64)
            return out
        return sketch

    return map_texts(docs, make, "digest binary, sketch binary, body long")


def _first_paths(runs: int):
    def split(batches):
        for batch in batches:
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, COORDINATES)
            for r in range(runs):
                for k in range(fanout(r)):
                    c = _draw(r, k) % COORDINATES
                    place = np.uint64((1 + (r * 2 + k) * COORDINATES + c) * int(_seeds[0, 0]) % (1 << 64))
                    h = (values[:, c].astype(np.uint64) + place) * _seeds[1, 1]
                    h = (h ^ (h >> np.uint64(31))) * _seeds[0, 1]
                    yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array((h ^ (h >> np.uint64(30))).view(np.int64))], ["rep", "path"])
    return split


def _deeper(batches):
    for batch in batches:
        rep, path = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        reps, paths = [], []
        for r, p, s in zip(rep, path, batch.column(2).to_pylist()):
            for child in children(p, np.frombuffer(s, np.int32)):
                reps.append(r)
                paths.append(child)
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(paths, pa.int64())], ["rep", "path"])


def _parts(sets: DataFrame, runs: int) -> DataFrame:
    """(rep, path, n): membership in the parts that are to be compared, with their sizes."""
    paths = sets.select("rep", "sketch").mapInArrow(_first_paths(runs), "rep long, path long")
    done = []
    for depth in range(1, DEPTH + 1):
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = cut_lineage(paths.join(sizes, "path").select("rep", "path", "n"))
        done.append(sized if depth == DEPTH else sized.where(F.col("n") <= SMALL))
        hot = sized.where(F.col("n") > SMALL)
        if depth == DEPTH or hot.isEmpty():
            break
        paths = hot.select("rep", "path").join(sets.select("rep", "sketch"), "rep").select("rep", "path", "sketch").mapInArrow(
            _deeper, "rep long, path long").distinct()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _owned(lists: np.ndarray, i: np.ndarray, j: np.ndarray, path: int) -> np.ndarray:
    """Is ``path`` the smallest part that both have in common; lists are sorted rows padded with the largest number."""
    least = np.full(len(i), np.iinfo(np.int64).max)
    a, b = lists[i], lists[j]
    for k in range(lists.shape[1]):
        same = (a[:, k:k + 1] == b).any(1)
        least = np.where(same & (a[:, k] < least), a[:, k], least)
        if (same | (a[:, k] > path)).all():
            break
    return least == path


PAIRS = "part string, reps array<long>, pairs binary"
PAIRS_ARROW = pa.schema([("part", pa.string()), ("reps", pa.list_(pa.int64())), ("pairs", pa.binary())])
LINKS = "rep long, links long, root long"
LINKS_ARROW = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _candidates(table: pa.Table) -> pa.Table:
    """Pairs of one part (or of two blocks of it) whose sketches agree well enough and that no smaller part has."""
    schema = PAIRS_ARROW
    order = np.argsort(table.column("rep").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    reps, path = table.column("rep").to_numpy(), table.column("path")[0].as_py()
    block = table.column("block").to_numpy()
    across = len(np.unique(block)) > 1
    values = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.int32).reshape(-1, COORDINATES)
    lists = [sorted(x) for x in table.column("parts").to_pylist()]
    padded = np.full((len(lists), max(map(len, lists))), np.iinfo(np.int64).max)
    for r, x in enumerate(lists):
        padded[r, :len(x)] = x
    least = math.ceil((THRESHOLD - SLACK) * COORDINATES)
    left, right = [], []
    for i in range(len(reps) - 1):
        close = np.flatnonzero((values[i + 1:] == values[i]).sum(1) >= least) + i + 1
        if across:  # pairs inside a block belong to that block's own task
            close = close[block[close] != block[i]]
        if len(close):
            left.append(np.full(len(close), i))
            right.append(close)
    if not left:
        return schema.empty_table()
    left, right = np.concatenate(left), np.concatenate(right)
    own = _owned(padded, left, right, path)
    left, right = left[own], right[own]
    if not len(left):
        return schema.empty_table()
    members, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    return pa.Table.from_arrays([pa.array([table.column("part")[0].as_py()], pa.string()), pa.array([reps[members].tolist()], schema.field(1).type),
                                 pa.array([place.astype("<i4").tobytes()], pa.binary())], schema=schema)


def common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that at least two sets hold."""
    n = len(sets)
    unique, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    number = np.cumsum(counts > 1) - 1
    use = counts[place] > 1
    column, owner = number[place[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return out


def _verify(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    schema = LINKS_ARROW
    if not pairs.num_rows or not texts.num_rows:
        return schema.empty_table()
    reps = pairs.column("reps")[0].as_py()
    at = {r: k for k, r in enumerate(texts.column("rep").to_pylist())}
    text, weight = texts.column("text").to_pylist(), texts.column("copies").to_pylist()
    sets = [shingles(text[at[r]]) for r in reps]
    n = np.array([weight[at[r]] for r in reps], np.int64)
    left, right = np.frombuffer(pairs.column("pairs")[0].as_py(), "<i4").reshape(2, -1)
    both = common_counts(sets)[left, right].astype(np.float64)
    size = np.array([len(s) for s in sets])
    linked = both >= THRESHOLD * (size[left] + size[right] - both) - 1e-9
    left, right = left[linked], right[linked]
    links = np.bincount(left, weights=n[right], minlength=len(reps)) + np.bincount(right, weights=n[left], minlength=len(reps))
    root = roots_of(len(reps), left, right)
    rows = [(reps[k], int(links[k]), reps[root[k]]) for k in np.flatnonzero(links)]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """What ``near_duplicates`` gives, with ``body``, the xxhash64 of the row's text, and ``stands``: is it the row, by id and
    text, that its group of near duplicates keeps."""
    source = id_and_text(docs, id_col, text_col)
    marked = cut_lineage(_sketches(source.where(F.col("doc_id").isNotNull())))
    # classes have keys of their own: an id with different texts can be the smallest of several classes
    classes = cut_lineage(marked.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min(F.struct("doc_id", "body", "sketch")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("digest", "first.doc_id", "first.body", "first.sketch", "copies", F.monotonically_increasing_id().alias("rep")))
    sets = classes.select("rep", "sketch", "copies")
    parts = cut_lineage(_parts(sets, runs_needed(THRESHOLD, recall, DEPTH)))
    lists = parts.groupBy("rep").agg(F.collect_set("path").alias("parts"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    placed = (parts.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("rep", "path", "block", F.concat_ws("/", "path", F.least("block", "other"), F.greatest("block", "other")).alias("part")))
    members = placed.join(lists, "rep").join(sets.select("rep", "sketch"), "rep")
    pairs = cut_lineage(members.groupBy("part").applyInArrow(_candidates, PAIRS))
    wanted = pairs.select(F.col("part").alias("task"), F.explode("reps").alias("rep"))
    one = wanted.select("rep").distinct().join(classes.select("rep", "doc_id", "body", "copies"), "rep")
    # the text of each wanted class: by id and text hash, so it is the one that was sketched
    texts = (source.withColumn("body", F.xxhash64("text")).join(one, ["doc_id", "body"])
             .groupBy("rep").agg(F.min("text").alias("text"), F.first("copies").alias("copies")))
    found = cut_lineage(pairs.groupBy("part").cogroup(wanted.join(texts, "rep").groupBy("task")).applyInArrow(_verify, LINKS))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    labels = cut_lineage(labels.withColumnRenamed("node", "rep"))
    least = labels.join(classes.select("rep", "doc_id", "body"), "rep").groupBy("component").agg(F.min(F.struct("doc_id", "body")).alias("least"))
    per_class = (classes.select("digest", "rep", "doc_id", "body", "copies").join(links, "rep", "left")
                 .join(labels.join(least, "component").select("rep", "least"), "rep", "left")
                 .select("digest", F.col("doc_id").alias("copy_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                         F.coalesce("least", F.struct("doc_id", "body")).alias("least")))
    rows = marked.select("doc_id", "body", "digest").join(per_class, "digest", "left").select(
        "doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least.doc_id", "doc_id").alias("class_id"), "body",
        F.coalesce((F.col("least.doc_id") == F.col("doc_id")) & (F.col("least.body") == F.col("body")), F.lit(True)).alias("stands"))
    lost = source.where(F.col("doc_id").isNull()).select(
        "doc_id", F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"),
        F.xxhash64("text").alias("body"), F.lit(True).alias("stands"))
    return rows.unionByName(lost).withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, copy_id (smallest id with the same shingle set), n_links (other documents at or above the threshold),
    class_id (smallest id reachable by links) and kept (is it that document), one row per row of ``docs``."""
    return near_duplicate_rows(docs, id_col, text_col, recall).select("doc_id", "copy_id", "n_links", "class_id", "kept")
