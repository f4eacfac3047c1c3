"""Embedding near-dedup: tables of E8 lattice cells, neighbouring cells probed, cosine verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import heavy_hitters, lookup, spread, written
from quire.llm.components import components
from quire.llm.simhash import Forest

#: Tables, cells probed beside a vector's own, and the size of a cell (projected length of a unit vector: 1 / CELL).
TABLES, PROBES, CELL = 8, 4, 0.4
#: Entries of a cell that meet in one task, and candidate pairs verified at once.
MOST_IN_CELL, PAIRS = 2_000, 1 << 17

#: The 240 shortest vectors of the lattice.
NEIGHBOURS = np.array(
    [[s if k == i else t if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for s in (1.0, -1.0) for t in (1.0, -1.0)] + [x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
)


def _even_point(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    gap = x[odd] - point[odd]
    worst = np.abs(gap).argmax(axis=1)
    point[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def lattice_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: of two cosets of the even points, the nearer."""
    whole, half = _even_point(x), _even_point(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def cells(unit: np.ndarray, table: int, probes: int, cell: float) -> np.ndarray:
    """For each unit vector the 32-bit names of its cell and of the `probes` neighbours its projection is nearest to."""
    dims = unit.shape[1]
    projection = np.random.default_rng([table, dims]).normal(size=(dims, 8)) / (np.sqrt(8) * cell)
    x = unit @ projection
    own = lattice_point(x)
    near = np.argpartition(-((x - own) @ NEIGHBOURS.T), probes, axis=1)[:, :probes]
    points = np.concatenate([own[:, None, :], own[:, None, :] + NEIGHBOURS[near]], axis=1)
    halves = np.rint(2 * points).astype(np.int64).astype(np.uint64)
    mixed = np.full(halves.shape[:2], table + 1, np.uint64)
    for k in range(8):
        mixed = (mixed ^ halves[..., k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def _entries(batches: Iterator[pa.RecordBatch], tables: int, probes: int, cell: float) -> Iterator[pa.RecordBatch]:
    """node, group, copies, vector (unit, doubles), names (tables x (1 + probes))."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            vectors = part.column(3)
            sizes = vectors.value_lengths().to_numpy()
            flat = vectors.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                x = flat[(starts[rows][:, None] + np.arange(dims)).ravel()].reshape(len(rows), dims).astype(float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                names = np.stack([cells(x, t, probes, cell) for t in range(tables)], axis=1)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(list(names.reshape(len(rows), -1).astype(np.int64)), pa.list_(pa.int64()))],
                    names=["node", "space", "copies", "vector", "names"],
                )


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of (tables, 1 + probes) names, the first (table, side) where they meet, as table * 2 + side.

    Side 0: the first one's own cell is among the second's cells; side 1: the other way round.
    """
    meets = np.stack([(a[:, :, :1] == b).any(axis=2), (b[:, :, :1] == a).any(axis=2)], axis=2).reshape(len(a), -1)
    return meets.argmax(axis=1)


def _verified(batches: Iterator[pa.RecordBatch], least: float, tables: int) -> Iterator[pa.RecordBatch]:
    """Over entries sorted by key: for each node the copies it links with in these cells (b null), and a forest of links.

    A pair that meets in several cells counts in the first of them alone.
    """
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, kind, node, copies, number, chunk = (table.column(c).to_numpy() for c in ("key", "kind", "node", "copies", "number", "chunk"))
        order = np.lexsort((kind, key))
        key, kind, node, copies, number, chunk = (x[order] for x in (key, kind, node, copies, number, chunk))
        vectors = [np.frombuffer(v.as_py()) for v in table.column("vector")]
        names = np.array(table.column("names").to_pylist(), np.int64).reshape(len(key), tables, -1)[order]
        vectors = [vectors[k] for k in order.tolist()]
        lead = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[lead, len(key)])
        home = np.add.reduceat((kind == 0).astype(np.int64), lead)
        # every own entry of a cell with every entry behind it
        group = np.repeat(np.arange(len(lead)), home)
        first = np.arange(len(group)) - np.repeat(np.cumsum(home) - home, home) + lead[group]
        after = lead[group] + size[group] - 1 - first
        count: dict[int, int] = {}
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for at in _portions(after, PAIRS):
            n = after[at]
            a = np.repeat(first[at], n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            across = (chunk[a] < 0) | (chunk[a] != chunk[b])
            a, b = a[across], b[across]
            if not len(a):
                continue
            used = np.unique(np.r_[a, b])
            matrix = np.stack([vectors[k] for k in used.tolist()])
            x, y = np.searchsorted(used, a), np.searchsorted(used, b)
            close = np.einsum("ij,ij->i", matrix[x], matrix[y]) >= least
            a, b = a[close], b[close]
            swap = node[a] > node[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            other = node[a] != node[b]
            a, b = a[other], b[other]
            if not len(a):
                continue
            meeting = _first_meeting(names[a], names[b])
            # both sides are one cell when the own cells agree: then side 0 comes first and is this one
            here = number[a] * 2 + np.where(kind[a] == 0, 0, 1) == meeting
            a, b = a[here], b[here]
            for one, two in ((a, b), (b, a)):
                who, at_ = np.unique(node[one], return_inverse=True)
                for k, v in zip(who.tolist(), np.bincount(at_, copies[two]).astype(np.int64).tolist(), strict=True):
                    count[k] = count.get(k, 0) + v
            nodes, at_ = np.unique(np.r_[node[a], node[b]], return_inverse=True)
            kept = Forest(len(nodes)).joining(at_[: len(a)], at_[len(a) :])
            edges.append((node[a[kept]], node[b[kept]]))
        yield _found(np.fromiter(count, np.int64, len(count)), None, np.fromiter(count.values(), np.int64, len(count)))
        for a, b in edges:
            yield _found(a, b, np.zeros(len(a), np.int64))

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows > 6 * MOST_IN_CELL:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            whole = int(np.flatnonzero(key == key[-1])[0])
            if whole:
                yield from flush(table.slice(0, whole))
                held, rows = table.slice(whole).to_batches(), len(key) - whole
    if rows:
        yield from flush(pa.Table.from_batches(held))


def _portions(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Runs of indices whose sizes add up to about `most`."""
    part = np.cumsum(sizes) // most
    yield from np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1)


def _found(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def lattice_links(nodes: DataFrame, least: float, tables: int = TABLES, probes: int = PROBES, cell: float = CELL, most: int = MOST_IN_CELL) -> DataFrame:
    """a, b, n: rows without b add n to the number of vectors that node a links with; rows with b connect nodes.

    `nodes`: node, space, copies, embedding. A vector has an entry for its own cell and one for each probed
    cell of every table; two vectors meet where the own cell of one has an entry of the other. Ids and names
    of cells go first: only entries that meet another travel with their vectors. A cell with many entries is
    divided into chunks and each pair of chunks is a task's share, so nothing is skipped in crowded cells.
    """
    entries = written(nodes.select("node", "space", "copies", "embedding").mapInArrow(lambda it: _entries(it, tables, probes, cell), "node long, space long, copies long, vector binary, names array<long>"), "lattice-entries")
    slim = entries.select("node", "space", F.posexplode("names").alias("place", "name"))
    slim = slim.select("node", F.floor(F.col("place") / (1 + probes)).cast("int").alias("number"), (F.col("place") % (1 + probes) > 0).cast("int").alias("kind"), "space", "name")
    slim = slim.withColumn("key", F.xxhash64("space", "number", "name"))
    counts = slim.groupBy("key").agg(F.count_if(F.col("kind") == 0).alias("homes"), F.count(F.lit(1)).alias("all")).where("homes > 0 and all > 1")
    chunks = counts.select("key", F.ceil(F.col("homes") / most).cast("int").alias("own"), F.ceil(F.col("all") / most).cast("int").alias("any"), F.col("all").alias("n"))
    met = spread(slim, written(chunks, "lattice-cells"), "key", tables * (1 + probes) * entries.count())
    salt = F.xxhash64("node", F.lit(7))
    mine = F.pmod(salt, F.col("any")).cast("int")
    # chunks of all entries, paired: an entry goes to each pair its chunk is in
    pairs = F.transform(F.sequence(F.lit(0), F.col("any") - 1), lambda k: F.struct(F.least(k, mine).alias("low"), F.greatest(k, mine).alias("high")))
    dealt = met.select("node", "number", "kind", mine.alias("chunk"), "key", F.explode(pairs).alias("pair"))
    # of two different chunks only pairs across them count there: -1 marks a chunk with itself
    chunk = F.when(F.col("pair.low") < F.col("pair.high"), F.col("chunk")).otherwise(-1).alias("chunk")
    dealt = dealt.select("node", "number", "kind", F.xxhash64("key", "pair.low", "pair.high").alias("key"), chunk)
    loaded = dealt.join(entries.select("node", "copies", "vector", "names"), "node").select("key", "kind", "node", "copies", "number", "chunk", "vector", "names")
    sorted_entries = loaded.repartition("key").sortWithinPartitions("key")
    return written(sorted_entries.mapInArrow(lambda it: _verified(it, least, tables), "a long, b long, n long"), "lattice-links")


def lattice_dedup(vectors: DataFrame, least: float = 0.93, tables: int = TABLES, probes: int = PROBES, cell: float = CELL, most: int = MOST_IN_CELL, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors linked directly), component_id, kept.

    Vectors of one label (not null) and one length link when their cosine in double precision is at least
    `least`. A vector that is null, zero, or holds a null, NaN or infinite component links with nothing and
    is its own component, as does one without a label. Equal vectors are one node with a number of copies,
    so copies are counted and never paired; rows that repeat an id are vectors of their own. A null id names
    no component while others do. An empty table gives no rows.

    Links are looked for in `lattice_links`; the share found is measured against all pairs in the tests.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False)) & F.col(label_col).isNotNull()
    label = F.col(label_col).cast("string")
    name = F.concat_ws("/", F.hex(F.xxhash64(F.lit(1), label, x)), F.hex(F.xxhash64(F.lit(2), label, x)))
    rows = written(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, name).alias("name"), F.xxhash64(label, F.size(x)).alias("space"), x.alias("embedding"), F.monotonically_increasing_id().alias("_row")), "lattice-rows")
    good = rows.where("name is not null")
    nodes = written(good.groupBy("name").agg(F.min("_row").alias("node"), F.min("vec_id").alias("least"), F.first("space").alias("space"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "lattice-nodes")
    links = lattice_links(nodes, least, tables, probes, cell, most)
    degree = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    placed = components(links.where("b is not null").select("a", "b"))
    known = nodes.select("name", "node", "least", "copies").join(placed, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known, "lattice-known")
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    table = spread(known, ids, "component", known.count()).select("name", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    slim = good.select("vec_id", "name")
    heavy = written(heavy_hitters(slim, "name"), "lattice-heavy")
    found = lookup(slim, table, heavy, "name").select("vec_id", "n_links", "component_id")
    alone = rows.where("name is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
