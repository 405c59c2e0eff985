"""Nearest neighbours by inner product in balanced posting lists.

A largest inner product is a smallest distance once every vector x has one more coordinate, sqrt(M^2 - |x|^2) with M the
longest length, and every query is stretched to the length M with a 0 there. All distances below are those.

Lists. A bounded sample of the distinct vectors is halved at the median along its main direction until the parts are as small
as wanted; the means of the parts are the centroids, so lists are of even size wherever vectors are dense. Every vector is put
on the list of its nearest centroid, and on up to ``COPIES`` in all if it lies at the boundary of others, hardly farther away.

Centroids are found by a graph in memory: each has edges to near centroids that no nearer edge already leads to. A best-first
search starts at evenly spaced entries and keeps a pool; vectors and queries go through it in batches.

Search. A query takes all lists whose centroid is at most ``ratio`` times as far as its ``BASE``-th nearest one (the nearest is
often one that the query itself has drawn near). The ratio is measured: ``ASKED`` vectors are held against all vectors, and the
ratio is the one with which ``target`` of their true neighbours are on a taken list, whatever the data. The pool of a query
grows until it reaches beyond that distance, so no number of lists is a limit.

Neighbouring lists share a shelf of about ``SHELF`` numbers, and a list larger than that is cut into shelves by hash, so that a
query and its taken lists travel once a shelf. Queries are dealt in parts of measured size. A shelf and a part of the queries
are one task, whatever list is hot; it multiplies each list with the queries that took it and keeps the best of every query.

Ties go to the smaller vec_id. So of equal vectors only the k + 1 with the smallest ids can be among k neighbours of anything
(one may be the query itself); the others need no place in a list. Equal queries are searched once and their result is
joined back, in several copies where there are many of them.

Null ids and vectors that are null, empty, zero, or hold null or non-finite components take no part. Vectors of different lengths
have no inner product; each length has an index of its own. Rows with one vec_id and one vector count once; with one vec_id
and several vectors each is searched, and none is a neighbour of another. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.llm.shared import cut_lineage

NEIGHBOURS = 20
#: share of the true neighbours of the asked vectors that the taken lists must hold
TARGET = 0.95
#: most vectors, and numbers in them, that the indexes are fitted on; most of them whose true neighbours are found for the ratio
SAMPLE, SAMPLE_NUMBERS, ASKED = 20_000, 16_000_000, 500
#: distances are held against that of the BASE-th nearest centroid
BASE = 8
#: vectors wanted in a list, and fewest sample vectors of a centroid
LIST, PER_CENTROID = 32, 4
#: a boundary vector is on at most COPIES lists, those of centroids at most NEAR times as far as its nearest
COPIES, NEAR = 3, 1.005
#: numbers (64-bit) in the vectors of a shelf, and queries that visit one in a task
SHELF, QUERIES = 4_000_000, 32_768
#: edges of a centroid, and the nearest centroids that a search keeps at first for a vector and for a query
EDGES, NEAREST, POOL = 12, 12, 64
#: products that are kept in a task before the best of each query are sorted out
PENDING = 2_000_000


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(-1)[:, None] - 2 * x @ y.T + (y * y).sum(-1)[None, :], 0))


class Graph:
    """Best-first search among centroids."""

    def __init__(self, points: np.ndarray, edges: int = EDGES):
        self.points = points
        n = len(points)
        self.squares = (points * points).sum(1)
        self.edges = np.full((n, edges), -1, np.int64)
        for at in range(0, n, 256):
            d = distances(points[at:at + 256], points)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :4 * edges]
            for i, (row, far) in enumerate(zip(near, np.take_along_axis(d, near, 1))):
                between = distances(points[row], points[row])
                kept: list[int] = []
                for j in range(len(row)):
                    if np.isfinite(far[j]) and all(between[j, k] > far[j] for k in kept):
                        kept.append(j)
                        if len(kept) == edges:
                            break
                # places left over go to the nearest others, so that dense regions stay connected
                kept += [j for j in range(len(row)) if j not in kept and np.isfinite(far[j])][:edges - len(kept)]
                self.edges[at + i, :len(kept)] = row[kept]
        self.entries = np.unique(np.linspace(0, n - 1, max(1, int(np.sqrt(n)))).astype(np.int64))

    def search(self, x: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of about the ``pool`` nearest points of each row, nearest first; -1 where there are fewer."""
        n = len(x)
        rows, at_once = np.arange(n)[:, None], max(1, pool // 16)
        own = (x * x).sum(1)[:, None]
        if pool >= len(self.points):  # nothing is left out, so there is nothing to search
            far = np.maximum(own + self.squares[None, :] - 2 * x @ self.points.T, 0)
            ids = np.argsort(far, axis=1, kind="stable")
            return ids, np.take_along_axis(far, ids, 1)
        seen = np.zeros((n, len(self.points) + 1), bool)  # the last column stands for no point
        seen[:, self.entries] = seen[:, -1] = True
        ids = np.repeat(self.entries[None, :], n, 0)
        far = np.maximum(own + self.squares[self.entries][None, :] - 2 * x @ self.points[self.entries].T, 0)
        done = np.zeros(ids.shape, bool)
        while True:
            best = np.argsort(far, axis=1, kind="stable")[:, :pool]
            ids, far, done = (np.take_along_axis(a, best, 1) for a in (ids, far, done))
            waiting = ~done & np.isfinite(far)
            if not waiting.any():
                return np.where(np.isfinite(far), ids, -1), far
            # the nearest points not looked at yet; where fewer are waiting, points already seen come along and add nothing
            front = np.argsort(~waiting, axis=1, kind="stable")[:, :at_once]
            np.put_along_axis(done, front, True, 1)
            new = self.edges[np.take_along_axis(ids, front, 1)].transpose(1, 0, 2)
            for edge in new:  # one front point after the other, so that a point that two of them lead to comes once
                edge[seen[rows, edge]] = -1
                seen[rows, edge] = True
            new = new.transpose(1, 0, 2).reshape(n, -1)
            keep = np.argsort(new < 0, axis=1, kind="stable")[:, :max(1, int((new >= 0).sum(1).max()))]
            new = np.take_along_axis(new, keep, 1)
            d = np.maximum(own + self.squares[new] - 2 * np.matmul(self.points[new], x[:, :, None])[:, :, 0], 0)
            ids, far = np.hstack([ids, new]), np.hstack([far, np.where(new < 0, np.inf, d)])
            done = np.hstack([done, new < 0])


def halves(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of parts of at most ``leaf`` rows, each got by cutting a larger one at the median of its main direction."""
    parts, work = [], [np.arange(len(x))]
    while work:
        rows = work.pop()
        if len(rows) <= leaf:
            parts.append(rows)
            continue
        c = x[rows] - x[rows].mean(0)
        way = c[np.argmax((c * c).sum(1))]
        for _ in range(4):  # a few rounds of the power method find a direction of large spread
            way = c.T @ (c @ way)
            way /= max(np.linalg.norm(way), 1e-300)
        order = np.argsort(c @ way, kind="stable")
        work += [rows[order[len(rows) // 2:]], rows[order[:len(rows) // 2]]]
    return parts


class Lists:
    """Centroids and their graph for vectors of one length; ``ratio`` and the lists' sizes are set once they are measured."""

    def __init__(self, sample: np.ndarray, total: int, longest: float, list_size: int = LIST):
        self.longest, self.ratio = longest, np.inf
        points = self.lifted(sample)
        wanted = max(1, min(-(-total // list_size), len(sample) // PER_CENTROID))
        parts = halves(points, max(PER_CENTROID, -(-len(sample) // wanted)))
        self.graph = Graph(np.array([points[p].mean(0) for p in parts]))
        self.sizes = np.ones(len(parts), np.int64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(1), 0))[:, None]])

    def stretched(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x * (self.longest / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))])

    def places(self, lifted: np.ndarray) -> list[np.ndarray]:
        """The lists of every vector: its nearest, and others at whose boundary it lies."""
        found = []
        for at in range(0, len(lifted), 1024):
            ids, far = self.graph.search(lifted[at:at + 1024], NEAREST)
            near = (ids >= 0) & (far <= NEAR ** 2 * far[:, :1])
            found += [row[ok][:COPIES] for row, ok in zip(ids, near)]
        return found

    def needed(self, x: np.ndarray) -> np.ndarray:
        """(query, list): how many times as far as the query's BASE-th nearest centroid the list's is."""
        far = distances(self.stretched(x), self.graph.points)
        base = np.partition(far, min(BASE, far.shape[1]) - 1, axis=1)[:, min(BASE, far.shape[1]) - 1]
        return far / np.maximum(base, 1e-300)[:, None]

    def taken(self, x: np.ndarray, fewest: int) -> list[np.ndarray]:
        """The lists that each query takes: all within the ratio, and the nearest that hold ``fewest`` vectors between them."""
        lifted, found = self.stretched(x), [None] * len(x)
        left, pool = np.arange(len(x)), POOL
        while len(left):
            step, again = max(16, 1024 * POOL // pool), []
            for at in range(0, len(left), step):
                rows = left[at:at + step]
                ids, far = self.graph.search(lifted[rows], pool)
                base = np.where(np.isfinite(far[:, :BASE]), far[:, :BASE], 0).max(1, keepdims=True)
                before = np.cumsum(np.where(ids >= 0, self.sizes[ids], 0), axis=1) - self.sizes[ids]
                near = (ids >= 0) & ((far <= self.ratio ** 2 * (1 + 1e-9) * base) | (before < COPIES * fewest))
                full = near[:, -1] | (ids[:, -1] < 0) if pool < len(self.graph.points) else np.zeros(len(rows), bool)
                for i, r in enumerate(rows):
                    found[r] = ids[i][near[i]]
                again.append(rows[full])
            left, pool = np.concatenate(again), 4 * pool
        return found


def _matrix(lists: pa.Array, length: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), length)


def _by_length(batch, column: str):
    """(length, rows) of a batch or table of one chunk."""
    lists = batch.column(column)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        yield n, batch.filter(pa.array(sizes == n))


def _foremost(numbers, scores, most: int, slack: np.ndarray):
    """Which products are among the ``most`` largest of their query or within rounding of them, and each query's limit."""
    order = np.lexsort((-scores, numbers))
    n, s = numbers[order], scores[order]
    start = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
    size = np.diff(np.r_[start, len(n)])
    limit = np.where(size >= most, s[np.minimum(start + most, start + size) - 1], -np.inf) - slack[n[start]]
    return order[s >= np.repeat(limit, size)], n[start], limit


def best_of_shelf(own: np.ndarray, queries: np.ndarray, takes: np.ndarray, ids: np.ndarray, lists: np.ndarray, members: np.ndarray, most: int):
    """(number of the query, id, score) of each query's ``most`` members of largest product, ties to the smaller id.

    ``takes`` says for each query and list of the shelf whether the list is taken; a member with the query's own id is passed over.
    """
    slack = 1e-12 * queries.shape[1] * np.linalg.norm(queries, axis=1) * np.linalg.norm(members, axis=1).max()
    limits = np.full(len(queries), -np.inf)
    # a boundary vector may be on several lists of the shelf; the first of its rows stands for all of them
    same = np.arange(len(ids))
    first: dict = {}
    number = np.unique(ids, return_inverse=True)[1]
    for r in np.flatnonzero((np.bincount(number) > 1)[number]):
        same[r] = first.setdefault((ids[r], members[r].tobytes()), r)
    order = np.argsort(lists, kind="stable")
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(lists[order]) != 0]), len(order)]
    kept: list[tuple] = []
    pending = 0

    def settle():
        n, m, p = (np.concatenate(c) for c in zip(*kept))
        once = np.unique(n * len(ids) + m, return_index=True)[1]
        n, m, p = n[once], m[once], p[once]
        some, who, limit = _foremost(n, p, most, slack)
        limits[who] = np.maximum(limits[who], limit)
        kept[:] = [(n[some], m[some], p[some])]
        return len(some)

    mark = PENDING
    for a, b in zip(cuts[:-1], cuts[1:]):
        asking = np.flatnonzero(takes[:, lists[order[a]]])
        for at in range(a, b, 1024):
            rows = order[at:min(at + 1024, b)]
            for start in range(0, len(asking), 1024):
                some = asking[start:start + 1024]
                p = queries[some] @ members[rows].T
                i, j = np.nonzero((p >= limits[some][:, None]) & (own[some][:, None] != ids[rows][None, :]))
                kept.append((some[i], same[rows[j]], p[i, j]))
                pending += len(i)
                if pending > mark:
                    pending = settle()
                    mark = max(PENDING, 2 * pending)
    if not pending:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    settle()
    n, m, _ = kept[0]
    score = np.concatenate([(members[m[at:at + 65536]] * queries[n[at:at + 65536]]).sum(1) for at in range(0, len(n), 65536)])
    best = np.lexsort((ids[m], -score, n))
    n, i, score = n[best], ids[m][best], score[best]
    start = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
    place = np.arange(len(n)) - np.repeat(start, np.diff(np.r_[start, len(n)]))
    return n[place < most], i[place < most], score[place < most]


FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _searched(task: pa.Table, most: int) -> pa.Table:
    asks = pc.is_valid(task.column("query"))
    m, q = task.filter(pc.invert(asks)), task.filter(asks)
    if not m.num_rows or not q.num_rows:
        return FOUND.empty_table()
    members, queries = (_matrix(t.column("v").combine_chunks(), len(q.column("v")[0])) for t in (m, q))
    own = q.column("id").to_numpy()
    takes = np.unpackbits(np.stack([np.frombuffer(t, np.uint8) for t in q.column("takes").to_pylist()]), axis=1).astype(bool)
    numbers, ids, scores = best_of_shelf(own, queries, takes, m.column("id").to_numpy(), m.column("list").to_numpy(), members, most)
    return pa.Table.from_arrays([pa.array(q.column("query").to_numpy()[numbers]), pa.array(own[numbers]), pa.array(ids), pa.array(scores)], schema=FOUND)


def _shelves(sizes: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{length: (shelf of each list, its place there, blocks of each list)}; shelves are numbered through all lengths."""
    found, shelf = {}, 0
    for length in sorted({n for n, _ in sizes}):
        counts = {j: c for (n, j), c in sizes.items() if n == length}
        room = max(1, SHELF // length)
        top = max(counts) + 1
        where, place, blocks = (np.zeros(top, np.int64) for _ in range(3))
        shelf, used, at = shelf + 1, 0, 0
        for j in range(top):
            c = counts.get(j, 0)
            if used and used + c > room:
                shelf, used, at = shelf + 1, 0, 0
            where[j], place[j], blocks[j] = shelf, at, max(1, -(-c // room))
            used, at = used + c, at + 1
        found[length] = where, place, blocks
    return found


def _ratios(held: DataFrame, asked_of: dict, neighbours: int, target: float) -> dict[int, float]:
    """{length: ratio} from the true neighbours, among all vectors, of the asked ones; a task keeps ``neighbours`` a question."""
    def run(batches):
        best: dict = {}
        for batch in batches:
            for n, part in _by_length(batch, "v"):
                if n not in asked_of:
                    continue
                own, questions, need = asked_of[n]
                x, ids = _matrix(part.column("v"), n), part.column("id").to_numpy()
                lists = part.column("lists").to_pylist()
                lists = np.array([p + p[-1:] * (COPIES - len(p)) for p in lists])
                for at in range(0, len(x), 4096):
                    p = questions @ x[at:at + 4096].T
                    p[own[:, None] == ids[None, at:at + 4096]] = -np.inf
                    top = np.argpartition(-p, min(neighbours, p.shape[1]) - 1, axis=1)[:, :neighbours]
                    found = np.take_along_axis(p, top, 1), np.take_along_axis(need[:, None, :], lists[at + top].reshape(len(own), 1, -1), 2).reshape(
                        *top.shape, COPIES).min(2)
                    old = best.get(n)
                    s, d = found if old is None else (np.hstack([a, b]) for a, b in zip(old, found))
                    keep = np.argsort(-s, axis=1, kind="stable")[:, :neighbours]
                    best[n] = np.take_along_axis(s, keep, 1), np.take_along_axis(d, keep, 1)
        for n, (s, d) in best.items():
            i, j = np.nonzero(np.isfinite(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n), pa.int32()), pa.array(i, pa.int32()), pa.array(s[i, j]), pa.array(d[i, j])],
                                             ["n", "i", "score", "need"])

    found = held.mapInArrow(run, "n int, i int, score double, need double")
    place = F.row_number().over(Window.partitionBy("n", "i").orderBy(F.col("score").desc(), "need"))
    rows = found.withColumn("place", place).where(F.col("place") <= neighbours).select("n", "need").collect()
    return {n: float(np.quantile([r.need for r in rows if r.n == n], target)) for n in {r.n for r in rows}}


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None,
            neighbours: int = NEIGHBOURS, target: float = TARGET, list_size: int = LIST) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest of every query; ``queries`` is a condition on ``vec_id``, by default its
    being divisible by 20."""
    queries = F.col("vec_id") % 20 == 0 if queries is None else queries
    source = table.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).alias("v"))
    if "float" not in source.schema["v"].dataType.simpleString():
        source = source.withColumn("v", F.col("v").cast("array<double>"))
    good = F.exists("v", lambda c: c != 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = source.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    # equal vectors tie, so ids beyond the k + 1 smallest of them are never found; their rows are still asked
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    members = cut_lineage(rows.withColumn("place", place).where(F.col("place") <= neighbours + 1).drop("place").distinct())
    lengths = {r.n: (r.rows, r.longest) for r in members.groupBy(F.size("v").alias("n")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).alias("longest")).collect()}
    answer = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return table.sparkSession.createDataFrame([], answer)
    share = max(PER_CENTROID, SAMPLE // len(lengths))
    questions = max(PER_CENTROID, ASKED // len(lengths))
    quota = F.broadcast(table.sparkSession.createDataFrame(
        [(n, c[0], max(PER_CENTROID, min(share, SAMPLE_NUMBERS // (n * len(lengths)))), questions) for n, c in lengths.items()],
        "n int, total long, share long, questions long"))

    def drawn(seed: int, many: str, most: int):
        """(length, rows) of vectors chosen by a hash of the id; another seed chooses independently."""
        order = F.xxhash64("vec_id", F.lit(seed))
        some = members.withColumn("n", F.size("v")).join(quota, "n").where(F.pmod(order, "total") < F.col(many))
        found = some.orderBy(order, "vec_id").limit(most).select("vec_id", "v").toArrow().combine_chunks()
        return _by_length(found, "v") if found.num_rows else ()

    indexes = {n: Lists(_matrix(part.column("v").combine_chunks(), n), *lengths[n], list_size) for n, part in drawn(0, "share", 2 * SAMPLE)}
    asked_of = {}
    # not the vectors that the centroids are means of, which lie nearer to them than others do
    for n, part in drawn(1, "questions", 2 * ASKED + PER_CENTROID * len(lengths)):
        if n in indexes:
            x = _matrix(part.column("v").combine_chunks(), n)
            asked_of[n] = part.column("vec_id").to_numpy(), x, indexes[n].needed(x)

    def listed(taken: bool):
        def run(batches):
            for batch in batches:
                for n, part in _by_length(batch, "v"):
                    if n in indexes:
                        x = _matrix(part.column("v"), n)
                        lists = indexes[n].taken(x, neighbours + 1) if taken else indexes[n].places(indexes[n].lifted(x))
                    else:  # no vector of this length was drawn: all its few are on one list
                        lists = [np.zeros(1, np.int64)] * part.num_rows
                    yield pa.RecordBatch.from_arrays([part.column("query"), part.column("id"), part.column("v"),
                                                      pa.array([p.tolist() for p in lists], pa.list_(pa.int32()))], ["query", "id", "v", "lists"])
        return run

    kind = members.schema["v"].dataType.simpleString()
    row = ["query", "id", "v"]

    def on_lists(vectors: DataFrame, taken: bool) -> DataFrame:
        return cut_lineage(vectors.select(*row).mapInArrow(listed(taken), f"query long, id long, v {kind}, lists array<int>"))

    held = on_lists(members.select(F.lit(None).cast("long").alias("query"), F.col("vec_id").alias("id"), "v"), False)
    # one number for each list, of which there are at most SAMPLE / PER_CENTROID
    sizes = {(r.n, r.j): r["count"] for r in held.select(F.size("v").alias("n"), F.explode("lists").alias("j")).groupBy("n", "j").count().collect()}
    for n, lists in indexes.items():
        lists.sizes = np.array([sizes.get((n, j), 0) for j in range(len(lists.sizes))], np.int64)
    for n, ratio in _ratios(held, asked_of, neighbours, target).items():
        indexes[n].ratio = ratio
    # a number of its own for every distinct pair of id and vector; fixed by the checkpoint that follows
    asked = on_lists(rows.where(queries).distinct().select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("id"), "v"), True)
    shelves = _shelves(sizes)
    # the lists of the shelf that a query takes travel as bits
    task = "query long, id long, v " + kind + ", shelf long, block long, list int, takes binary"

    def to_shelves(batches):
        for batch in batches:
            for n, part in _by_length(batch, "v"):
                where, place, blocks = shelves[n]
                is_query = part.column("query").null_count == 0
                at, shelf, block, number, takes = [], [], [], [], []
                for i, lists in enumerate(part.column("lists").to_pylist()):
                    lists = np.array(lists, np.int64)
                    lists = lists[lists < len(where)]
                    if not is_query:
                        for j in lists:
                            at.append(i)
                            shelf.append(where[j])
                            block.append(0 if blocks[j] == 1 else zlib.crc32(part.column("id")[i].as_py().to_bytes(8, "little", signed=True)) % blocks[j])
                            number.append(place[j])
                            takes.append(None)
                        continue
                    for w in np.unique(where[lists]):
                        here = lists[where[lists] == w]
                        bits = np.zeros(place[where == w].max() + 1, bool)
                        bits[place[here]] = True
                        packed = np.packbits(bits).tobytes()
                        for k in range(blocks[where == w].max()):
                            at.append(i)
                            shelf.append(w)
                            block.append(k)
                            number.append(None)
                            takes.append(packed)
                rows_at = part.select(row).take(pa.array(at, pa.int64())) if isinstance(part, pa.Table) else pa.RecordBatch.from_arrays(
                    [part.column(c).take(pa.array(at, pa.int64())) for c in row], row)
                yield pa.RecordBatch.from_arrays([*rows_at.columns, pa.array(shelf, pa.int64()), pa.array(block, pa.int64()),
                                                  pa.array(number, pa.int32()), pa.array(takes, pa.binary())],
                                                 [*row, "shelf", "block", "list", "takes"])

    key = ["shelf", "block"]
    m, q = (x.mapInArrow(to_shelves, task) for x in (held, asked))
    # one row for each shelf and block: how many parts its queries are dealt in
    parts = F.broadcast(q.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts")))
    work = m.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).unionByName(
        q.join(parts, key).withColumn("part", F.pmod(F.xxhash64("query"), "parts")))
    found = work.drop("parts").groupBy(*key, "part").applyInArrow(lambda t: _searched(t, neighbours), "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return (found.distinct().withColumn("rank", rank).where(F.col("rank") <= neighbours)
            .select("query_id", "rank", "vec_id", "score"))
