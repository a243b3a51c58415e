"""Near-duplicate vectors by E8 lattice hashing.

Every table projects the vectors at random to 8 (or 8k) dimensions and decodes the result to its
nearest E8 lattice point, the vector's home cell.  A vector also probes the neighbouring cells (the
lattice's minimal vectors) that lie nearest.  Vectors that meet in a cell, one of them at home, are
verified by their cosine in double precision.  The number of tables follows from the target recall
at the threshold.  Equal vectors form one class and enter once.  Cells are dealt into blocks, which
return a link count and a local root for each vector, never the pairs.

Defined results: a vector that is null, zero or holds a null or non-finite component links with
nothing and is its own component, kept; vectors of different lengths never link; every row is a
vector of its own, also if its id repeats; a component of rows without any id has a null component_id
and all its rows are kept; columns of other names are not read.  The dimensions of the projection
follow the table's size, so which pairs above the threshold are missed may differ between tables;
the recall aimed at does not.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut_lineage, mix64
from tallyspark.llm.components import connected_components, named_components
from tallyspark.llm.ngram_join import local_roots

THRESHOLD = 0.95
WIDTH = 1.5
PROBES = 4
BLOCK = 400
#: A projection to 8 dimensions has about this many cells in use; larger tables project to more dimensions.
CELLS = 1700


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the neighbours of a lattice point."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in enumerate(pairs):
        whole[row, i], whole[row, j] = a, b
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.concatenate((whole, np.array(half)))


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    point = np.rint(x)
    error = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def neighbours(x: np.ndarray, home: np.ndarray, number: int) -> np.ndarray:
    """The ``number`` lattice points next to ``home`` that lie nearest to x: (n, number, 8)."""
    around = minimal_vectors()
    near = np.argpartition(-((x - home) @ around.T), number, axis=1)[:, :number]
    return home[:, None, :] + around[near]


def _cell(points: np.ndarray, table: int, length: int) -> np.ndarray:
    """A hash of lattice points, different for each table and for vectors of different lengths."""
    whole = np.rint(2 * points).astype(np.int64).astype(np.uint64)
    value = mix64(np.full(whole.shape[:-1], (length << 16) + table + 1, np.uint64))
    for k in range(whole.shape[-1]):
        value = mix64(value + whole[..., k])
    return value.view(np.int64)


def cells(unit: np.ndarray, tables: int, parts: int, width: float = WIDTH, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (n, tables) and probed cells (n, tables, parts * probes) of unit vectors."""
    n, d = unit.shape
    home, probed = np.empty((n, tables), np.int64), np.empty((n, tables, parts * probes), np.int64)
    for table in range(tables):
        random = np.random.default_rng((d, table))
        x = unit @ random.standard_normal((d, 8 * parts)) / width
        point = np.concatenate([nearest_e8(x[:, 8 * p : 8 * p + 8]) for p in range(parts)], axis=1)
        home[:, table] = _cell(point, table, d)
        for p in range(parts):
            part = slice(8 * p, 8 * p + 8)
            moved = np.repeat(point[:, None, :], probes, axis=1)
            moved[:, :, part] = neighbours(x[:, part], point[:, part], probes)
            probed[:, table, p * probes : (p + 1) * probes] = _cell(moved, table, d)
    return home, probed


def choose_tables(rows: int, threshold: float = THRESHOLD, recall: float = 0.99, width: float = WIDTH, probes: int = PROBES) -> tuple[int, int]:
    """(tables, parts): E8 blocks by the table's size, tables by the recall of a pair at the threshold, which is simulated."""
    parts = max(1, round(math.log(max(rows, 2)) / math.log(CELLS) - 0.25))
    random = np.random.default_rng(5)
    x = random.standard_normal((20_000, 8)) / width
    y = threshold * x + math.sqrt(1 - threshold**2) * random.standard_normal((20_000, 8)) / width
    hx, hy = nearest_e8(x), nearest_e8(y)
    home = (hx == hy).all(axis=1)
    found = home.copy()
    for a, ha, hb in ((x, hx, hy), (y, hy, hx)):
        found |= (neighbours(a, ha, probes) == hb[:, None]).all(axis=2).any(axis=1)
    same, near = home.mean(), found.mean()
    rate = same**parts + parts * same ** (parts - 1) * (near - same)
    return math.ceil(math.log(1 - recall) / math.log(1 - rate)), parts


def verify(nodes: np.ndarray, unit: np.ndarray, copies: np.ndarray, prober: np.ndarray, block: np.ndarray, home: np.ndarray, probed: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member of a cell (counting copies) and its local root's place.

    A pair counts in the first table that finds it.  If two vectors probe each other's home in one
    table, the pair counts at the home of the larger node.
    """
    close = unit @ unit.T >= threshold
    close &= ~(prober[:, None] & prober[None, :])
    close &= nodes[:, None] != nodes[None, :]
    if block.min() != block.max():
        close &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(close, 1))
    ok = np.ones(len(i), bool)
    for a, b in ((i, j), (j, i)):
        guest = prober[a] & ~prober[b]
        mutual = (probed[b, table] == home[a, table][:, None]).any(axis=1)
        ok &= ~(guest & mutual & (nodes[a] > nodes[b]))
    for earlier in range(table):
        hi, hj = home[i, earlier], home[j, earlier]
        ok &= ~((hi == hj) | (probed[i, earlier] == hj[:, None]).any(axis=1) | (probed[j, earlier] == hi[:, None]).any(axis=1))
    i, j = i[ok], j[ok]
    links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
    linked = np.zeros((len(nodes), len(nodes)), bool)
    linked[i, j] = linked[j, i] = True
    return links.astype(np.int64), local_roots(linked)


def lattice_dedup(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = 0.99, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts the other rows found with a cosine of at least ``threshold``.
    """
    x = F.col("v")
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))
    # Zeros of either sign are equal, so their sign is dropped before vectors are compared.
    print_of = [F.when(sound, F.xxhash64(F.transform(x, lambda c: c + F.lit(0.0)), F.lit(k))) for k in (1, 2)]
    known = rows.select("id", "v", print_of[0].alias("p1"), print_of[1].alias("p2"))
    classes = known.where("p1 is not null").groupBy("p1", "p2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # The checkpoint keeps each class's number.
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    tables, parts = choose_tables(classes.count(), threshold, recall)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                some = batch.filter(pa.array(sizes == d))
                raw = some.column(2).flatten().to_numpy().reshape(-1, d)
                # Scaled first, so that no square overflows or vanishes.
                raw = raw / np.abs(raw).max(axis=1, keepdims=True)
                unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
                home, probed = cells(unit, tables, parts)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), *(pa.array([row.tobytes() for row in m], pa.binary()) for m in (unit, home, probed)), pa.array(home.tolist(), pa.list_(pa.int64())), pa.array(probed.reshape(len(home), tables, -1).tolist(), pa.list_(pa.list_(pa.int64())))],
                    names=["node", "copies", "unit", "home", "probed", "homes", "probes"],
                )

    hashed = cut_lineage(classes.select("node", "copies", "v").mapInArrow(hash_all, "node long, copies long, unit binary, home binary, probed binary, homes array<long>, probes array<array<long>>"))
    own = hashed.select("node", F.posexplode("homes").alias("table", "cell"), F.lit(False).alias("prober"))
    guests = hashed.select("node", F.posexplode("probes").alias("table", "list")).select("node", "table", F.explode("list").alias("cell"), F.lit(True).alias("prober"))
    met = own.unionByName(guests)
    full = met.groupBy("table", "cell").agg(F.count("*").alias("n"), F.count_if(~F.col("prober")).alias("at_home")).where("n > 1 and at_home > 0")
    full = full.select("table", "cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    members = met.join(full, ["table", "cell"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "table", "cell", "node", "prober", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )

    def check(key: tuple, data: pa.Table) -> pa.Table:
        nodes = data["node"].to_numpy()
        unit = np.array([np.frombuffer(v) for v in data["unit"].to_pylist()])
        home = np.array([np.frombuffer(v, np.int64) for v in data["home"].to_pylist()])
        probed = np.array([np.frombuffer(v, np.int64) for v in data["probed"].to_pylist()]).reshape(len(nodes), tables, -1)
        prober = data["prober"].to_numpy(zero_copy_only=False)
        links, root = verify(nodes, unit, data["copies"].to_numpy(), prober, data["block"].to_numpy(), home, probed, key[0].as_py(), threshold)
        some = links > 0
        return pa.table({"a": nodes[some], "b": nodes[root[some]], "links": links[some]})

    payload = hashed.select("node", "copies", "unit", "home", "probed")
    checked = cut_lineage(dealt.join(payload, "node").groupBy("table", "cell", "low", "high").applyInArrow(check, "a long, b long, links long"))
    components = named_components(connected_components(checked.select("a", "b")), classes)
    links = checked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    found = classes.drop("v").join(links, "node", "left").join(components, "node", "left")
    component = F.when(F.col("joined"), F.col("component")).otherwise(F.col("rep")).alias("component")
    found = found.select("p1", "p2", "copies", "links", component)
    joined = known.select("id", "p1", "p2").join(found, ["p1", "p2"], "left")
    component = F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("component"))
    return joined.select(
        F.col("id").alias(vec_id),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
