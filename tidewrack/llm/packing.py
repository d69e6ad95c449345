"""Packing of documents into bins by a grouping genetic algorithm.

Documents are cut into pieces of at most a bin's capacity, and the pieces are
parted by a hash into blocks of bounded size, which are packed independently.
Each block has islands: populations that evolve in tasks of their own. A child
takes whole well-filled bins from one parent; bins of the other parent that
hold any of their pieces are dissolved, with its worst bins, and the displaced
pieces go, largest first, where they fit best. Between epochs each island's
best packing migrates to the next island; in the end the block's best one wins.
"""

from __future__ import annotations


from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm._rows import key, narrow
from tidewrack.llm._scratch import cut

#: Tokens of a bin, and the bytes that one token stands for.
CAPACITY, TOKEN_BYTES = 2048, 4
#: Pieces of a block, about.
BLOCK = 2000
#: Blocks of a task.
TASK_BLOCKS = 4
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2, 4, 2, 20
#: Share of the other parent's bins that a child takes, at most, best-filled first.
INJECTED = 0.5


def best_fit(order: np.ndarray, sizes: np.ndarray, capacity: int, bins: np.ndarray, loads: list[int]) -> list[int]:
    """Place the pieces of ``order`` one by one in the fullest bin that has room; fills ``bins``, returns all loads."""
    loads = list(loads)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for b, load in enumerate(loads):
        open_[capacity - load].append(b)
        rooms |= 1 << capacity - load
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        bins[i] = b
        loads[b] += size
        open_[room - size].append(b)
        rooms |= 1 << room - size
    return loads


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Falkenauer's measure: the mean of the squared fill of the bins."""
    loads = np.bincount(bins, sizes)
    loads = loads[loads > 0]
    return float(((loads / capacity) ** 2).mean()) if len(loads) else 0.0


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, draw: np.random.Generator) -> np.ndarray:
    """A child of ``a`` with whole bins of ``b``: see the module."""
    loads = np.bincount(b, sizes)
    full = np.argsort(-loads, kind="stable")
    full = full[: max(1, int(len(full) * INJECTED))]
    chosen = np.zeros(len(loads), bool)
    chosen[full[draw.random(len(full)) < draw.uniform(0.3, 0.9)]] = True
    injected = chosen[b]
    mine = np.bincount(a, sizes)
    hit = np.zeros(len(mine), bool)
    hit[a[injected]] = True
    worst = np.argsort(mine, kind="stable")
    hit[worst[: 1 + len(worst) // 50]] = True
    child = np.full(len(a), -1, np.int64)
    keep = ~injected & ~hit[a]
    number = np.cumsum(chosen) - 1
    child[injected] = number[b[injected]]
    stay, again = np.unique(a[keep], return_inverse=True)
    child[keep] = int(chosen.sum()) + again
    base = np.bincount(child[child >= 0], sizes[child >= 0], minlength=int(chosen.sum()) + len(stay)).astype(np.int64)
    out = np.flatnonzero(child < 0)
    best_fit(out[np.argsort(-sizes[out], kind="stable")], sizes, capacity, child, base.tolist())
    return np.unique(child, return_inverse=True)[1]


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, generations: int, draw: np.random.Generator) -> list[np.ndarray]:
    """The population after some generations, best first; its best never gets worse. No more children than it takes to reach the fewest bins there can be."""
    least = -(-int(sizes.sum()) // capacity)
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    born = len(scored)
    for _ in range(generations if len(sizes) > 1 else 0):
        if len(np.unique(scored[0][2])) <= least:
            break
        i, j = draw.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = crossover(scored[min(i, j)][2], scored[max(i, j)][2], sizes, capacity, draw)
        scored.append((fitness(child, sizes, capacity), born, child))
        born += 1
        scored.sort(key=lambda x: (-x[0], x[1]))
        scored.pop()
    return [p for _, _, p in scored]


def found(sizes: np.ndarray, capacity: int, many: int, draw: np.random.Generator) -> list[np.ndarray]:
    """A first population: best fit of the pieces, largest first and then in blurred orders."""
    out = []
    for k in range(many):
        noise = draw.random(len(sizes)) * (0.15 * k * capacity)
        bins = np.zeros(len(sizes), np.int64)
        best_fit(np.argsort(-(sizes + noise), kind="stable"), sizes, capacity, bins, [])
        out.append(bins)
    return out


def _generator(block: int, island: int, epoch: int) -> np.random.Generator:
    return np.random.default_rng([block, island, epoch, 7])


def _first_epoch(pieces: pd.DataFrame, *, capacity: int, islands: int) -> pd.DataFrame:
    block, island = int(pieces["block"].iloc[0]), int(pieces["island"].iloc[0])
    pieces = pieces.sort_values(["size", "k1", "k2", "piece"], ascending=[False, True, True, True], kind="stable")
    sizes = pieces["size"].to_numpy(np.int64)
    draw = _generator(block, island, 0)
    people = evolve(found(sizes, capacity, POPULATION, draw), sizes, capacity, GENERATIONS, draw)
    return _people(block, island, people, sizes, islands)


def _people(block: int, island: int, people: list[np.ndarray], sizes: np.ndarray, islands: int) -> pd.DataFrame:
    """The population as rows, and its best as a migrant to the next island."""
    rows = [(island, p) for p in people]
    if islands > 1:
        rows.append(((island + 1) % islands, people[0]))
    return pd.DataFrame(
        {"block": block, "island": [i for i, _ in rows], "sizes": [sizes.astype(np.int32).tobytes()] * len(rows), "bins": [p.astype(np.int32).tobytes() for _, p in rows]}
    )


_STATE = "block long, island int, sizes binary, bins binary"


def _next_epoch(rows: pd.DataFrame, *, capacity: int, islands: int, epoch: int) -> pd.DataFrame:
    block, island = int(rows["block"].iloc[0]), int(rows["island"].iloc[0])
    sizes = np.frombuffer(rows["sizes"].iloc[0], np.int32).astype(np.int64)
    people = [np.frombuffer(x, np.int32).astype(np.int64) for x in sorted(rows["bins"])]
    people.sort(key=lambda p: -fitness(p, sizes, capacity))
    return _people(block, island, evolve(people[:POPULATION], sizes, capacity, GENERATIONS, _generator(block, island, epoch)), sizes, islands)


def _assign(pieces: pd.DataFrame, state: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Each bin of the best packing of all islands of a block."""
    if pieces.empty:
        return pd.DataFrame({"bin_id": [], "doc_ids": [], "pieces": [], "used": []})
    block = int(pieces["block"].iloc[0])
    pieces = pieces.sort_values(["size", "k1", "k2", "piece"], ascending=[False, True, True, True], kind="stable")
    sizes = pieces["size"].to_numpy(np.int64)
    people = [np.frombuffer(x, np.int32) for x in sorted(state["bins"])]
    best = max(people, key=lambda p: fitness(p, sizes, capacity))
    order = np.argsort(best, kind="stable")
    cuts = np.flatnonzero(np.diff(best[order])) + 1
    ids, number = pieces["id"].to_numpy(object), pieces["piece"].to_numpy()
    groups = np.split(order, cuts)
    plain = lambda x: None if x is None or x != x or x is pd.NA else x
    return pd.DataFrame(
        {"bin_id": [(block << 32) + k for k in range(len(groups))], "doc_ids": [[plain(x) for x in ids[g]] for g in groups], "pieces": [number[g].tolist() for g in groups], "used": [int(sizes[g].sum()) for g in groups]}
    )


def tokens(text: Column) -> Column:
    """Tokens of a text: its bytes by ``TOKEN_BYTES``, rounded up; none of a null."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / TOKEN_BYTES).cast("long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Bins: ``bin_id``, ``doc_ids`` and ``pieces`` (both lists, item by item) and ``used`` tokens.

    A text longer than a bin is cut into pieces 0, 1 ... of ``capacity`` tokens
    and a rest; full pieces are bins of their own. Every piece is in exactly
    one bin, no bin is over its capacity, and the packing depends on the rows
    alone. Null and empty texts have no piece; null ids stay null in the lists;
    repeated rows are packed each; an empty table gives no bins.
    """
    rows = narrow(docs, id_col, text_col)
    k1, k2 = key(rows["id"], rows["text"])
    sized = rows.select("id", k1.alias("k1"), k2.alias("k2"), tokens(rows["text"]).alias("n")).where("n > 0")
    # rows alike are numbered, so that they don't all fall into one block
    sized = sized.groupBy("id", "k1", "k2", "n").agg(F.count("*").cast("int").alias("rows"))
    sized = cut(sized.select("id", "k1", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("nth"), "k2", "n").withColumn("k1", F.when(F.col("nth") == 1, F.col("k1")).otherwise(F.xxhash64("k1", "nth"))).drop("nth"))
    last = F.floor((F.col("n") - 1) / capacity).cast("int")
    pieces = sized.select("id", "k1", "k2", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece").cast("long") * capacity).cast("int")).drop("n")
    whole = pieces.where(F.col("size") == capacity)
    rest = pieces.where(F.col("size") < capacity)
    blocks = max(1, -(-rest.count() // block))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("k1", "piece"), F.lit(blocks)))
    # few bytes but much work: tasks are counted by blocks, not by the bytes that AQE would merge them by
    tasks = max(1, blocks // TASK_BLOCKS)
    state = rest.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = state.repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(partial(_first_epoch, capacity=capacity, islands=islands), _STATE)
    for epoch in range(1, epochs):
        state = state.repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(partial(_next_epoch, capacity=capacity, islands=islands, epoch=epoch), _STATE)
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("used", T.IntegerType())])
    packed = rest.repartition(tasks, "block").groupBy("block").cogroup(state.repartition(tasks, "block").groupBy("block")).applyInPandas(lambda p, s: _assign(p, s, capacity), schema)
    full = whole.select((-F.shiftrightunsigned(F.xxhash64("k1", "k2", "piece"), 1) - 1).alias("bin_id"), F.array("id").alias("doc_ids"), F.array("piece").alias("pieces"), F.col("size").alias("used"))
    return packed.unionByName(full)
