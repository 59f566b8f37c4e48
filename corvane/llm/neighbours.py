"""The most similar vectors of every vector: NN-descent and greedy graph search.

1. Usable vectors become codes of one byte a dimension. Rows of one id count once; equal
   vectors form a group whose smallest id stands for it in the graph.
2. A first graph comes from a few routing trees: hyperplanes fitted on a bounded
   sample route every vector to a cell, and a cell is compared with itself.
3. NN-descent rounds by joins: all who point at a vector meet all it points at, and pairs
   that beat the poorest neighbour of either side come back. Meetings take place at
   the home of the vector, a cell of the first tree, so that a code is sent once to a home and not
   once to a meeting. After the first round only new links call meetings. Rounds stop when few
   links change.
4. The best candidates are compared again in double precision.

Similarities of codes are exact integers scaled and rounded, so one pair has one similarity in every
list, and cells, homes and samples are functions of ids and codes: the result doesn't depend on the
partitioning. A list holds a neighbour once.

Approximate: a neighbour is missed if no tree and no meeting brings the two together. ``exact_search`` is
the exact way: it compares given queries with all rows, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.sources.tables import discard, written

LISTS = "id bigint, home int, ids array<bigint>, sims array<smallint>, homes array<int>"
FOUND = "id bigint, ids array<bigint>, sims array<smallint>, homes array<int>"
UNIT = 32767  # a similarity of one as an integer
#: Groups of equal vectors beyond this size are joined by broadcast: there are at most as many as vectors / HOT.
HOT = 100_000


def _matrix(col: pa.Array, kind: str = "<u1") -> np.ndarray:
    """Byte strings of equal length, none null, as the rows of a matrix."""
    col = col.cast(pa.large_binary())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    if len(col) == 0:
        return np.zeros((0, 0), kind)
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(len(col), -1).view(kind)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, kind))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, number of values in each row) of a column of lists, none null."""
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(col.offsets))


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows equal in the first ``keys`` columns, each as one batch."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        at = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
        for lo, hi in zip(at, at[1:]):
            now = tuple(k[lo])
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _read(batches: Iterator[pa.RecordBatch], dims: int, raw: bool) -> Iterator[pa.RecordBatch]:
    """(id, h, code or 32-bit values) of the usable vectors; h is equal for equal directions."""
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        ok = (np.diff(np.asarray(col.offsets)) == dims) & np.asarray(col.is_valid()) & np.asarray(ids.is_valid())
        keep = np.flatnonzero(ok)
        x = col.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dims)  # a null becomes NaN
        wide = x.astype(np.float64)
        n = np.linalg.norm(wide, axis=1)
        good = np.isfinite(x).all(1) & (n > 0)
        x, keep = x[good], keep[good]
        unit = wide[good] / n[good, None] + 0.0
        h = pa.array([hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in unit], pa.binary())
        yield _batch(id=ids.take(pa.array(keep)).cast(pa.int64()), h=h, v=_binary(x if raw else _pack(unit)))


def _vectors(df: DataFrame, key: str, vector: str, dims: int, raw: bool) -> DataFrame:
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return rows.mapInArrow(partial(_read, dims=dims, raw=raw), "id bigint, h binary, v binary")


def usable(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, h, code): vectors of ``dims`` finite values, not all zero, one row per id; h is equal for equal directions.

    Of several vectors under one id the one with the smallest digest counts.
    """
    return _vectors(df, key, vector, dims, False).groupBy("id").agg(F.min(F.struct("h", "v")).alias("m")).select("id", "m.h", F.col("m.v").alias("code"))


def _pack(x: np.ndarray) -> np.ndarray:
    """Codes of unit vectors: one signed byte a dimension after the 32-bit factor that makes them unit vectors again."""
    q = np.rint(x / (np.abs(x).max(1, keepdims=True) / 127)) if len(x) else x
    s = (1 / np.linalg.norm(q, axis=1, keepdims=True)).astype("<f4")
    return np.hstack([s.view(np.int8).reshape(len(x), 4), q.astype(np.int8)])


def _open(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(integers as 32-bit floats, factors) of codes."""
    return codes[:, 4:].view(np.int8).astype(np.float32), codes[:, :4].copy().view("<f4")[:, 0]


def _sims(q: np.ndarray, s: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Similarities of codes as whole numbers of 1 / UNIT. Sums of products of bytes are exact in 32 bits, in whatever order."""
    dots = np.matmul(q, r.swapaxes(-1, -2))
    dots *= s[..., :, None] * t[..., None, :]
    dots *= UNIT
    return np.clip(np.rint(dots, out=dots), -UNIT, UNIT, out=dots)


def fit_tree(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes and thresholds of a balanced tree over a sample, in heap order; a split's direction joins two sample points."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    planes, cuts, nodes = [], [], [np.arange(len(sample))]
    for _ in range(depth):
        below = []
        for own in nodes:
            w, cut = rng.normal(size=dims), 0.0
            if len(own) >= 2:
                a, b = sample[rng.choice(own, 2, replace=False)]
                if (a != b).any():
                    w = (a - b).astype(np.float64)
                cut = float(np.median(sample[own] @ w))
            planes.append(w)
            cuts.append(cut)
            side = sample[own] @ w > cut
            below += [own[~side], own[side]]
        nodes = below
    return np.array(planes).reshape(-1, dims), np.array(cuts)


def _route(tree: tuple[np.ndarray, np.ndarray], depth: int, x: np.ndarray) -> np.ndarray:
    w, cuts = tree
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        # summed in one fixed order, so a vector has the same cell wherever it is routed
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, w[node]) > cuts[node])
    return node - (2**depth - 1)


def _cells(batches: Iterator[pa.RecordBatch], trees, depth: int, home_depth: int) -> Iterator[pa.RecordBatch]:
    """A row for each vector and tree: (cell, id, home, code)."""
    for b in batches:
        if not b.num_rows:
            continue
        q, s = _open(_matrix(b.column(1)))
        x = q.astype(np.float64) * s[:, None]
        first = _route(trees[0], depth, x)
        home = pa.array(first >> (depth - home_depth), pa.int32())
        for t, tree in enumerate(trees):
            cell = first if t == 0 else _route(tree, depth, x)
            yield _batch(cell=pa.array(t * 2**depth + cell, pa.int64()), id=b.column(0), home=home, code=b.column(1))


def _leaves(x: np.ndarray, own: np.ndarray, size: int, rng) -> Iterator[np.ndarray]:
    stack = [own]
    while stack:
        own = stack.pop()
        if len(own) <= size:
            yield own
            continue
        a, b = x[own[rng.choice(len(own), 2, replace=False)]]
        at = len(own) // 2
        order = np.argpartition(x[own] @ (a - b), at)
        stack += [own[order[:at]], own[order[at:]]]


def _block_knn(batches: Iterator[pa.RecordBatch], k: int, most: int) -> Iterator[pa.RecordBatch]:
    """Nearest neighbours inside each cell; rows arrive sorted by cell and id. A cell beyond ``most`` rows is divided further."""
    for b in _groups(batches, 1):
        ids, homes = b.column(1).to_numpy(), b.column(2).to_numpy()
        q, s = _open(_matrix(b.column(3)))
        for own in _leaves(q * s[:, None], np.arange(len(ids)), most, np.random.default_rng(b.column(0)[0].as_py())):
            own = np.sort(own)
            m = min(k, len(own) - 1)
            right, scale = np.ascontiguousarray(q[own].T), s[own]
            for lo in range(0, len(own), 256):
                rows = own[lo:lo + 256]
                dots = q[rows] @ right  # exact
                key = dots * scale  # orders a row as its similarities do
                key[np.arange(len(rows)), np.arange(lo, lo + len(rows))] = -np.inf
                top = np.argpartition(key, -m, axis=1)[:, -m:] if m else np.zeros((len(rows), 0), np.int64)
                sim = np.clip(np.rint(np.take_along_axis(dots, top, 1) * (s[rows, None] * scale[top]) * UNIT), -UNIT, UNIT)
                near = own[top].ravel()
                n = np.full(len(rows), m)
                yield _batch(
                    id=pa.array(ids[rows]), home=pa.array(homes[rows], pa.int32()), ids=_lists(ids[near], n, pa.int64()),
                    sims=_lists(sim.ravel().astype(np.int16), n, pa.int16()), homes=_lists(homes[near], n, pa.int32()))


def _zip(*names: str):
    return F.arrays_zip("sims", "ids", "homes")


def _best(all_: F.Column, degree: int):
    """The ``degree`` best distinct (sims, ids, homes), best first; one pair has one similarity everywhere."""
    return F.slice(F.sort_array(F.array_distinct(all_), asc=False), 1, degree)


def _take(links: list[np.ndarray], k: int):
    """(owner, other, sim) without repeats, the ``k`` best of each owner, sorted by owner."""
    a, b, s = map(np.concatenate, zip(*links))
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    a, b, s = a[first], b[first], s[first]
    at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    keep = np.arange(len(a)) - np.repeat(at, np.diff(np.r_[at, len(a)])) < k
    return a[keep], b[keep], s[keep]


def _meet(batches: Iterator[pa.RecordBatch], degree: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Neighbours of neighbours at one home: compares who meets at each of its vectors, returns what beats a poorest neighbour.

    Rows: (group, salt, id, home, live, bar, code, ids, news). Those who point at a popular vector meet in parts of
    ``parts``, each with the whole list of the popular one, so nobody is left out.
    """
    for b in _groups(batches, 2):
        ids, home = b.column(2).to_numpy(), b.column(3).to_numpy()
        host = b.column(4).to_numpy(zero_copy_only=False) & (home == b.column(0)[0].as_py())
        bar = b.column(5).to_numpy().astype(np.float32)
        q, s = _open(_matrix(b.column(6)))
        to, n = _flat(b.column(7))
        news = _flat(b.column(8))[0].astype(bool)
        order = np.argsort(ids)
        if not host.any() or not len(to):
            continue
        at = order[np.minimum(np.searchsorted(ids[order], to), len(ids) - 1)]
        row = np.repeat(np.arange(len(ids)), n)
        here = ids[at] == to
        known = np.unique(row[here] * len(ids) + at[here])
        out = here & host[row]
        back = here & host[at] & news
        # (host, guest, whether the link is new); what points both ways counts as pointed at by the host
        h = np.r_[row[out], at[back]]
        g = np.r_[at[out], row[back]]
        fresh = np.r_[news[out], news[back]]
        behind = np.r_[np.zeros(out.sum(), bool), np.ones(back.sum(), bool)]
        order = np.lexsort((behind, g, h))
        h, g, fresh, behind = h[order], g[order], fresh[order], behind[order]
        twin = np.r_[False, (h[1:] == h[:-1]) & (g[1:] == g[:-1])]
        fresh[:-1] |= twin[1:] & fresh[1:]
        h, g, fresh, behind = h[~twin], g[~twin], fresh[~twin], behind[~twin]
        found = []
        sizes = [0, *np.cumsum(np.bincount(h, minlength=len(ids)))]
        meetings: dict[int, list] = {}
        for x in np.flatnonzero(host):
            lo, hi = sizes[x], sizes[x + 1]
            if hi - lo < 2 or not fresh[lo:hi].any():
                continue
            span = np.arange(lo, hi)
            ahead, rest = span[~behind[lo:hi]], span[behind[lo:hi]]
            for i in range(0, max(1, len(rest)), parts):
                own = np.r_[ahead, rest[i:i + parts]]
                if len(own) > 1:
                    meetings.setdefault(-(-len(own) // 6) * 6, []).append(own)
        for width, rows in meetings.items():
            for lo in range(0, len(rows), 1_024):
                own = rows[lo:lo + 1_024]
                seat = np.full((len(own), width), -1)
                for i, r in enumerate(own):
                    seat[i, :len(r)] = r
                empty = seat < 0
                guest, new = g[seat], fresh[seat]
                sim = _sims(q[guest], s[guest], q[guest], s[guest])
                hit = (sim > bar[guest][:, :, None]) & (new[:, :, None] | new[:, None, :]) & ~(empty[:, :, None] | empty[:, None, :])
                hit &= guest[:, :, None] != guest[:, None, :]
                r, i, j = np.nonzero(hit)
                pair = guest[r, i] * len(ids) + guest[r, j]
                told = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                yet = known[told] != pair
                if yet.any():
                    r, i, j = r[yet], i[yet], j[yet]
                    found.append(_take([(guest[r, i], guest[r, j], sim[r, i, j])], degree))
        if not found:
            continue
        a, c, v = _take(found, degree)
        at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        n = np.diff(np.r_[at, len(a)])
        yield _batch(id=pa.array(ids[a[at]]), ids=_lists(ids[c], n, pa.int64()), sims=_lists(v.astype(np.int16), n, pa.int16()), homes=_lists(home[c], n, pa.int32()))
        # those who were found are told, so that their meetings are called too
        told = np.unique(c)
        none = np.zeros(len(told), np.int64)
        yield _batch(id=pa.array(ids[told]), ids=_lists(none[:0], none, pa.int64()), sims=_lists(none[:0], none, pa.int16()), homes=_lists(none[:0], none, pa.int32()))


def _behind():
    """Homes of those a vector newly points at."""
    return F.array_distinct(F.filter(F.transform(F.arrays_zip("homes", "news"), lambda x: F.when(x["news"], x["homes"])), lambda x: x.isNotNull()))


def crowded(graph: DataFrame, most_guests: int = 200_000) -> dict[int, int]:
    """By home: how many times it is held, for those with over ``most_guests`` who point into it; at most vectors * degree / most_guests homes."""
    crowd = graph.select(F.explode(_behind()).alias("group")).groupBy("group").count().filter(F.col("count") > most_guests)
    return {r.group: -(-r["count"] // most_guests) for r in crowd.collect()}


def descend(graph: DataFrame, codes: DataFrame, rows: int, degree: int, first: bool, salts: dict[int, int], parts: int = 24) -> DataFrame:
    """One NN-descent round over a graph of ``rows``: links found, as (id, ids, sims, homes).

    A vector goes to the home of every vector it newly points at, and to the homes of the live vectors that point at it.
    A home that ``salts`` names is held several times over, each time with a part of those who point into it.
    """
    behind = _behind()
    asked = graph.filter("live").select("home", F.explode(F.arrays_zip("ids", "homes")).alias("e"))
    if first:  # everybody is at home anyway
        asked = asked.filter("home <> e.homes")
    asked = asked.select(F.col("e.ids").alias("id"), F.col("home").alias("group")).groupBy("id").agg(F.collect_set("group").alias("asked"))
    none = F.array().cast("array<int>")
    every = F.array_distinct(F.concat(F.when(F.col("live"), F.array("home")).otherwise(none), F.coalesce("asked", none)))
    bar = F.when(F.size("sims") < degree, F.lit(-UNIT)).otherwise(F.array_min("sims")).alias("bar")
    sent = graph.join(asked, "id", "left").select("id", "home", "live", bar, "ids", "news", every.alias("every"), behind.alias("behind"))
    sent = sent.filter((F.size("every") > 0) | (F.size("behind") > 0)).join(codes, "id")
    if salts:
        many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in salts.items() for x in kv]), F.col("group")), F.lit(1))
    else:
        many = F.lit(1)
    row = ["id", "home", "live", "bar", "code", "ids", "news"]
    groups = F.concat(
        F.transform("every", lambda x: F.struct(x.alias("group"), F.lit(True).alias("all"))),
        F.transform(F.array_except("behind", "every"), lambda x: F.struct(x.alias("group"), F.lit(False).alias("all"))))
    sent = sent.select(F.explode(groups).alias("e"), *row).select("e.group", "e.all", *row)
    salt = F.when(F.col("all"), F.sequence(F.lit(0), many - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), many).cast("int"))) if salts else F.array(F.lit(0))
    sent = sent.select("group", F.explode(salt).alias("salt"), *row)
    return _by_group(sent, ["group", "salt"], rows).mapInArrow(partial(_meet, degree=degree, parts=parts), FOUND)


def _by_group(df: DataFrame, keys: list[str], rows: int, each: int = 8_192) -> DataFrame:
    """Rows of a group together, sorted by id; about ``each`` of ``rows`` to a task, and as many tasks as the session shuffles with at least."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, min(20_000, rows // each)), *keys).sortWithinPartitions(*keys, "id")


def knn_graph(
    codes: DataFrame, dims: int, degree: int = 12, trees: int = 3, cell_rows: int = 4_096, home_rows: int = 32_768, change: float = 0.02,
    sample_rows: int = 20_000, seed: int = 7, least: float = -1.0,
) -> DataFrame:
    """(id, home, ids, sims, homes): the ``degree`` nearest found for every id of (id, code), best first.

    The routing trees are fitted on the ``sample_rows`` vectors of smallest hash; every vector is routed and compared. Cells
    hold about ``cell_rows`` vectors as far as the sample can tell cells apart (about ten of it to a cell, some 2,000 cells);
    beyond that a task divides its cell further by hyperplanes through its own vectors. Rounds go on until fewer than
    ``change`` of the links of similarity ``least`` or more are new; every link is walked, whatever its similarity.
    """
    n = codes.count()
    spark = codes.sparkSession
    if n == 0:
        return spark.createDataFrame([], LISTS)
    h = F.xxhash64("id", F.lit(seed))
    share = min(1.0, 1.2 * sample_rows / n + 1e-6)  # so that no more than that is ever sent to be ordered
    drawn = codes.filter(F.pmod(h, F.lit(10**9)) < int(share * 10**9)).orderBy(h, "id").limit(sample_rows).select("code").collect()
    q, s = _open(np.frombuffer(b"".join(bytes(r.code) for r in drawn), np.int8).reshape(len(drawn), dims + 4))
    sample = q.astype(np.float64) * s[:, None]
    most_depth = max(0, int(np.log2(max(1, len(drawn) / 10))))
    depth = min(most_depth, int(np.ceil(np.log2(max(1, n / cell_rows)))))
    home_depth = min(depth, int(np.ceil(np.log2(max(1, n / home_rows)))))
    forest = [fit_tree(sample, depth, seed + t) for t in range(trees)]
    routed = codes.select("id", "code").mapInArrow(partial(_cells, trees=forest, depth=depth, home_depth=home_depth), "cell bigint, id bigint, home int, code binary")
    blocks = _by_group(routed, ["cell"], n * trees).mapInArrow(partial(_block_knn, k=degree, most=2 * cell_rows), LISTS)
    flat = blocks.groupBy("id").agg(F.max("home").alias("home"), F.flatten(F.collect_list(_zip())).alias("l"))
    lists = ("id", "home", F.col("b.ids").alias("ids"), F.col("b.sims").alias("sims"), F.col("b.homes").alias("homes"))
    buckets = _buckets(codes)
    graph = written(flat.select("id", "home", _best(F.col("l"), degree).alias("b")).select(
        *lists, F.transform("b", lambda _: F.lit(True)).alias("news"), F.lit(True).alias("live")), "graph", "id", buckets)
    first = True
    salts = crowded(graph)  # later rounds have fewer new links
    while True:
        found = descend(graph, codes, n, degree, first, salts).groupBy("id").agg(F.flatten(F.collect_list(_zip())).alias("more"))
        empty = F.array().cast("array<struct<sims:smallint,ids:bigint,homes:int>>")
        both = graph.select("id", "home", F.col("ids").alias("old"), _zip().alias("l")).join(found, "id", "left")
        both = both.select("id", "home", "old", F.col("more").isNotNull().alias("live"), F.when(F.col("more").isNull(), F.col("l")).otherwise(
            _best(F.concat("l", F.coalesce("more", empty)), degree)).alias("b"))
        after = written(both.select(*lists, F.transform("b", lambda x: ~F.array_contains("old", x["ids"])).alias("news"), "live"), "graph", "id", buckets)
        discard(graph)
        graph, first = after, False
        near = F.filter(F.arrays_zip("sims", "news"), lambda e: e["sims"] >= int(least * UNIT))
        have, new = graph.select(F.sum(F.size(near)), F.sum(F.size(F.filter(near, lambda e: e["news"])))).first()
        if (new or 0) <= change * (have or 0):
            return graph.select("id", "home", "ids", "sims", "homes")


def _exact(batches: Iterator[pa.RecordBatch], k: int, dims: int, least: float) -> Iterator[pa.RecordBatch]:
    """(node, to, sim): of each node's candidates the k most similar in double precision. Rows: (group, id, raw, near)."""
    for b in _groups(batches, 1):
        ids = b.column(1).to_numpy()
        once = pa.array(np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]))
        b = b.take(once)
        ids = b.column(1).to_numpy()
        x = _matrix(b.column(2), "<f4").astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        to, n = _flat(b.column(3))
        if not len(to):
            continue
        row = np.repeat(np.arange(len(ids)), n)
        order = np.argsort(ids)
        at = order[np.searchsorted(ids[order], to)]
        sim = np.concatenate([np.einsum("ij,ij->i", x[row[i:i + 8_192]], x[at[i:i + 8_192]]) for i in range(0, len(to), 8_192)])
        order = np.lexsort((to, -sim, row))
        row, to, sim = row[order], to[order], sim[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        keep = (np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k) & (sim >= least)
        yield _batch(node=pa.array(ids[row[keep]]), to=pa.array(to[keep]), sim=pa.array(sim[keep]))


def _exact_lists(graph: DataFrame, count: int, nodes: DataFrame, raw: DataFrame, dims: int, k: int, least: float | None, doubt: float) -> DataFrame:
    """(node, to, sim): the k most similar of each list, compared in double precision; ``doubt`` covers the codes' error."""
    bar = F.coalesce(F.get("sims", F.lit(k - 1)), F.lit(-UNIT)) - int(doubt * UNIT)
    if least is not None:
        bar = F.greatest(bar, F.lit(int((least - doubt) * UNIT)))
    near = graph.select("id", "home", F.filter(F.arrays_zip("ids", "homes", "sims"), lambda e: e["sims"] >= bar).alias("e")).filter(F.size("e") > 0)
    guests = near.select("home", F.explode("e").alias("e")).select(F.col("e.ids").alias("id"), F.col("home").alias("group"))
    none = F.array().cast("array<bigint>")
    hosts = near.select("id", F.col("home").alias("group"), F.col("e.ids").alias("near"))
    asked = guests.groupBy("id").agg(F.collect_set("group").alias("groups"))
    # a vector delivered twice comes twice here; the row of its digest is the one that counts
    rows = hosts.join(asked, "id", "full").join(nodes, "id").join(raw.withColumnRenamed("h", "g"), "id").filter("g = h").select(
        "id", F.col("v").alias("raw"), "group", F.coalesce("near", none).alias("near"),
        F.explode(F.array_distinct(F.concat(F.coalesce("groups", F.array().cast("array<int>")), F.when(F.col("group").isNull(), F.array().cast("array<int>")).otherwise(F.array("group"))))).alias("at"))
    sent = rows.select(F.col("at").alias("group"), "id", "raw", F.when(F.col("group") == F.col("at"), F.col("near")).otherwise(none).alias("near"))
    return _by_group(sent, ["group"], count).mapInArrow(
        partial(_exact, k=k, dims=dims, least=-2.0 if least is None else least), "node bigint, to bigint, sim double")


def _buckets(df: DataFrame, each: int = 65_536) -> int:
    """Parts for a table that is joined by id again and again."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(50_000, df.count() // each))


def most_similar(
    df: DataFrame, key: str, vector: str, dims: int, k: int = 5, least: float | None = None, doubt: float = 0.01, **how
) -> DataFrame:
    """(id, other, sim, rank): the k most similar others of every usable vector, at least ``least``.

    Ties go to the smaller id. Equal vectors are one node of the graph: its k + 1 smallest
    ids are the only ones that can be among anybody's k most similar. Vectors alone in the table have no rows.
    """
    every = written(usable(df, key, vector, dims), "vectors")
    sizes = every.groupBy("h").agg(F.min("id").alias("node"), F.count("*").alias("n")).filter("n > 1")
    sizes = written(sizes, "sizes")
    # groups that hold many rows are few and come to their rows; the others meet them by a join
    big = F.broadcast(sizes.filter(F.col("n") > HOT))
    rest = every.select("id", "h").join(big.select("h"), "h", "left_anti")
    many = written(
        every.select("id", "h").join(big, "h").unionByName(rest.join(sizes.filter(F.col("n") <= HOT), "h")).select("id", "node", (F.col("n") > HOT).alias("hot")), "many")
    ranked = many.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("id"))).filter(F.col("r") <= k + 1)
    firsts = written(ranked.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("firsts"), F.max("hot").alias("hot")), "groups")
    copies = many.filter("id <> node")
    nodes = written(every.join(copies.select("id"), "id", "left_anti").select("id", "h", "code"), "nodes", "id", _buckets(every))
    discard(every)
    if least is not None:
        how = {"least": least - doubt} | how
    graph = knn_graph(nodes.select("id", "code"), dims, **how)
    best = written(_exact_lists(graph, nodes.count(), nodes.select("id", "h"), _vectors(df, key, vector, dims, True), dims, k, least, doubt), "best")
    # back to ids: the others of the own group come first, then the near groups' smallest ids
    spread = best.join(firsts.select(F.col("node").alias("to"), "firsts"), "to", "left").select(
        "node", F.explode(F.coalesce("firsts", F.array("to"))).alias("other"), "sim")
    own = firsts.select("node", F.explode("firsts").alias("other"), F.lit(1.0).alias("sim"))
    w = W.partitionBy("node").orderBy(F.desc("sim"), "other")
    wide = spread.unionByName(own).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    # a lone vector's list is its node's; a group's members share theirs, each without itself
    lone = wide.select(F.col("node").alias("id"), "other", "sim")
    shared = wide.join(firsts.select("node", "hot"), "node").groupBy("node", "hot").agg(F.collect_list(F.struct("other", "sim")).alias("l"))
    hot = copies.filter("hot").join(F.broadcast(shared.filter("hot").select("node", "l")), "node")
    cold = copies.filter("not hot").join(shared.filter("not hot").select("node", "l"), "node")
    rest = hot.select("id", F.explode("l").alias("e")).unionByName(cold.select("id", F.explode("l").alias("e"))).select("id", "e.other", "e.sim")
    w = W.partitionBy("id").orderBy(F.desc("sim"), "other")
    return lone.unionByName(rest).filter("id <> other").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity of (q, qcode) with (id, code)."""
    for b in batches:
        if b.num_rows:
            (x, s), (y, t) = _open(_matrix(b.column(1))), _open(_matrix(b.column(3)))
            sim = np.einsum("ij,ij->i", x, y) * (s * t)
            yield _batch(q=b.column(0), id=b.column(2), s=pa.array(sim.astype(np.float32)))


def _enter(batches: Iterator[pa.RecordBatch], ids: np.ndarray, x: np.ndarray, t: np.ndarray, beam: int) -> Iterator[pa.RecordBatch]:
    """The entry points nearest to each query."""
    for b in batches:
        for lo in range(0, b.num_rows, 1_024):
            part = b.slice(lo, 1_024)
            y, s = _open(_matrix(part.column(1)))
            sim = (y @ x.T) * (s[:, None] * t)
            m = min(beam, len(ids))
            top = np.argpartition(sim, -m, axis=1)[:, -m:]
            yield _batch(q=pa.array(np.repeat(part.column(0).to_numpy(), m)), id=pa.array(ids[top].ravel()), s=pa.array(np.take_along_axis(sim, top, 1).ravel().astype(np.float32)))


def greedy_search(
    graph: DataFrame, codes: DataFrame, queries: DataFrame, dims: int, k: int = 5, beam: int = 32, expand: int = 8, entries: int = 4_096, reverse: int = 12,
) -> DataFrame:
    """(q, id, s): for every query (q, qcode) the k nearest found by walking the graph.

    Each query keeps its ``beam`` best nodes; a hop joins the graph on the best ones not yet expanded
    and compares their neighbours. All queries walk together. The walk starts at the nearest of
    ``entries`` nodes, a bounded set, and ends when no beam has anything left to expand: what falls out of a
    beam never comes back, so every walk ends.
    """
    share = min(1.0, 1.2 * entries / max(1, codes.count()) + 1e-6)
    start = codes.filter(F.pmod(F.xxhash64("id"), F.lit(10**9)) < int(share * 10**9)).orderBy(F.xxhash64("id"), "id").limit(entries).select("id", "code").collect()
    if not start:
        return queries.select("q", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("float").alias("s")).limit(0)
    ids = np.array([r.id for r in start])
    x, t = _open(np.frombuffer(b"".join(bytes(r.code) for r in start), np.int8).reshape(len(start), dims + 4))
    pointed = graph.select("id", F.explode(F.arrays_zip("ids", "sims")).alias("e")).select(F.col("e.ids").alias("id"), F.col("id").alias("to"), F.col("e.sims").alias("s"))
    back = pointed.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("s"), "to"))).filter(F.col("r") <= reverse)
    links = written(graph.select("id", F.explode("ids").alias("to")).unionByName(back.select("id", "to")).groupBy("id").agg(F.collect_set("to").alias("tos")), "links")
    state = written(queries.select("q", "qcode").mapInArrow(partial(_enter, ids=ids, x=x, t=t, beam=beam), "q bigint, id bigint, s float").withColumn("done", F.lit(False)), "beam")
    w = W.partitionBy("q").orderBy(F.desc("s"), "id")
    while True:
        opened = state.filter("not done").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= expand).select("q", "id")
        if opened.isEmpty():
            break
        near = opened.join(links, "id").select("q", F.explode("tos").alias("id")).distinct().join(state.select("q", "id"), ["q", "id"], "left_anti")
        found = near.join(queries, "q").join(codes, "id").select("q", "qcode", "id", "code").mapInArrow(_step, "q bigint, id bigint, s float")
        marked = state.join(opened.withColumn("o", F.lit(True)), ["q", "id"], "left").select("q", "id", "s", (F.col("done") | F.coalesce("o", F.lit(False))).alias("done"))
        both = marked.unionByName(found.withColumn("done", F.lit(False)))
        after = written(both.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= beam).drop("r"), "beam")
        discard(state)
        state = after
    return state.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "id", "s")


def _against(batches: Iterator[pa.RecordBatch], ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        own = b.column(0).to_numpy()
        y = _matrix(b.column(1), "<f4").astype(np.float64)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        for lo in range(0, len(ids), 512):
            sim = np.where(ids[lo:lo + 512, None] == own[None], -9.0, x[lo:lo + 512] @ y.T)
            # ties at the k-th place all go on, so that the smaller id can win
            m = min(k, sim.shape[1])
            r, c = np.nonzero(sim >= np.maximum(np.partition(sim, -m, axis=1)[:, -m:-m + 1 or None], -2.0))
            yield _batch(q=pa.array(ids[lo:lo + 512][r]), id=pa.array(own[c]), sim=pa.array(sim[r, c]))


def exact_search(df: DataFrame, key: str, vector: str, dims: int, queries, k: int = 5, block: int = 8_192) -> DataFrame:
    """(q, id, sim, rank): the k most similar others of every vector that fulfils the condition ``queries``, by comparing it with all rows.

    Queries go out in blocks of about ``block`` rows, a bounded set each time. The cost is queries times rows; this
    is the exact way for a query set, and the measure of the approximate one.
    """
    raw = written(_vectors(df, key, vector, dims, True).groupBy("id").agg(F.min(F.struct("h", "v")).alias("m")).select("id", F.col("m.v").alias("raw")), "raw")
    asked = raw.filter(queries)
    parts = max(1, -(-asked.count() // block))
    out = []
    w = W.partitionBy("q").orderBy(F.desc("sim"), "id")
    for p in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).collect()
        if own:
            x = np.frombuffer(b"".join(bytes(r.raw) for r in own), "<f4").reshape(len(own), dims).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = raw.mapInArrow(partial(_against, ids=np.array([r.id for r in own]), x=x, k=k), "q bigint, id bigint, sim double")
            out.append(written(near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "exact"))
    if not out:
        return raw.select(F.col("id").alias("q"), "id", F.lit(0.0).alias("sim"), F.lit(0).alias("rank")).limit(0)
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole
