"""Best-fit packing with a grouping genetic algorithm.

Whole sequences are the genes: crossover injects the best-filled sequences of one parent into the other, removes the
sequences that hold one of their documents twice, swaps displaced documents into sequences that they fill better, and best-fits
the rest. Shards of pieces are solved apart, each by several islands (rows of a grouped Spark job); between epochs every island
keeps its best packing and takes in that of the island before it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import materialize, text_slices
from docspark.llm.tokens import batch_tokenizer, tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Pieces of one shard; a shard leaves at most about one sequence open, so this bounds the loss to 1 in some thousands.
SHARD_PIECES = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 6, 4
#: Share of a parent's sequences, the fullest first, that crossover injects.
INJECT = 0.25

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document's ids with the end id: full ones of `capacity`, only the first may be shorter.

    `row` tells repeated rows of one doc_id apart.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = batch_tokenizer(path, plain=False)
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                b = batch.slice(i, j - i)
                ids, n = tok.encode(b.column(1))
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                raw, doc_at = memoryview(ids.tobytes()), np.cumsum(n) - n
                count = -(-n // capacity)
                owner = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                first = n - (count - 1) * capacity
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[owner], capacity)
                at = doc_at[owner] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), b.column(2).take(take)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, PIECES)


Packing = list[list[int]]


def best_fit(items: list[int], length: list[int], capacity: int, bins: Packing) -> Packing:
    """Add items, longest first, each to the fullest sequence it fits; sequences that had room before are used too."""
    room: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        left = capacity - sum(length[x] for x in b)
        if left:
            room.setdefault(left, []).append(i)
    free = sorted(room)
    for x in sorted(items, key=lambda k: -length[k]):
        n = length[x]
        at = bisect_left(free, n)
        if at < len(free):
            left = free[at]
            own = room[left]
            i = own.pop()
            if not own:
                del room[left], free[at]
            bins[i].append(x)
            left -= n
        else:
            i = len(bins)
            bins.append([x])
            left = capacity - n
        if left:
            if left in room:
                room[left].append(i)
            else:
                room[left] = [i]
                insort(free, left)
    return bins


def fitness(bins: Packing, length: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then uneven filling: full sequences and one open one leave more to gain."""
    fill = [sum(length[x] for x in b) / capacity for b in bins]
    return -len(bins), float(sum(f * f for f in fill)) / max(1, len(bins))


#: Displaced pieces, the longest, of which replace() tries one or two.
DISPLACED = 40


def replace(loose: list[int], length: list[int], capacity: int, bins: Packing) -> list[int]:
    """Swap one or two pieces of a sequence with room for one or two longer displaced ones that still fit; what is displaced then.

    Every swap fills a sequence better and leaves shorter pieces, which fit more easily.
    """
    loose = sorted(loose, key=lambda k: -length[k])
    kept, rest = loose[:DISPLACED], loose[DISPLACED:]
    pairs = lambda xs: [(length[x], (x,)) for x in xs] + [(length[x] + length[y], (x, y)) for i, x in enumerate(xs) for y in xs[:i]]
    offers = sorted(pairs(kept))
    sums = [n for n, _ in offers]
    for i, b in enumerate(bins):
        room = capacity - sum(length[x] for x in b)
        if not room or not offers:
            continue
        best = (0, (), ())
        for n, out in pairs(b):
            at = bisect_right(sums, n + room) - 1
            if at >= 0 and sums[at] - n > best[0]:
                best = (sums[at] - n, out, offers[at][1])
        if best[0]:
            bins[i] = [x for x in b if x not in best[1]] + list(best[2])
            kept = [x for x in kept if x not in best[2]] + list(best[1])
            offers = sorted(pairs(kept))
            sums = [n for n, _ in offers]
    return kept + rest


def crossover(one: Packing, two: Packing, length: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Inject some of the fullest sequences of `two` into `one`."""
    fill = np.array([sum(length[x] for x in b) for b in two]) + rng.random(len(two))
    chosen = np.argsort(-fill)[: max(1, int(len(two) * INJECT * (0.5 + rng.random())))]
    injected = [two[i] for i in chosen.tolist()]
    inside = {x for b in injected for x in b}
    child, loose = [list(b) for b in injected], []
    for b in one:
        if inside.isdisjoint(b):
            child.append(list(b))
        else:
            loose += [x for x in b if x not in inside]
    return best_fit(replace(loose, length, capacity, child), length, capacity, child)


def mutate(bins: Packing, length: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Dissolve the emptiest sequences and a few others, and best-fit their documents."""
    fill = np.array([sum(length[x] for x in b) for b in bins])
    worst = set(np.argsort(fill)[: max(1, len(bins) // 50)].tolist()) | set(rng.integers(0, len(bins), max(1, len(bins) // 50)).tolist())
    child = [list(b) for i, b in enumerate(bins) if i not in worst]
    return best_fit(replace([x for i in sorted(worst) for x in bins[i]], length, capacity, child), length, capacity, child)


def evolve(length: list[int], capacity: int, seeds: list[Packing], seed: tuple[int, ...], generations: int = GENERATIONS) -> Packing:
    """One island's epoch from the seed packings; stops at the lower bound."""
    rng = np.random.Generator(np.random.PCG64(list(seed)))
    n = len(length)
    least = -(-sum(length) // capacity)
    population = [*seeds, best_fit(list(range(n)), length, capacity, [])]
    while len(population) < POPULATION:  # first-come variety: a random part is packed before the rest
        some = rng.permutation(n)[: n // 4].tolist()
        rest = set(range(n)).difference(some)
        population.append(best_fit(list(rest), length, capacity, best_fit(some, length, capacity, [])))
    scored = sorted(((fitness(p, length, capacity), k, p) for k, p in enumerate(population)), key=lambda s: s[:2], reverse=True)[:POPULATION]
    for g in range(generations):
        if -scored[0][0][0] <= least:
            break
        i, j = rng.choice(len(scored), 2, replace=False).tolist()
        for k, child in enumerate((crossover(scored[i][2], scored[j][2], length, capacity, rng), crossover(scored[j][2], scored[i][2], length, capacity, rng), mutate(scored[0][2], length, capacity, rng))):
            scored.append((fitness(child, length, capacity), POPULATION + 3 * g + k, child))
        scored = sorted(scored, key=lambda s: s[:2], reverse=True)[:POPULATION]
    return scored[0][2]


def _solve(items: DataFrame, capacity: int, epochs: int, islands: int) -> DataFrame:
    """items: shard, key, length -> key, shard, bin. One group a shard and island; `origin` is the island that a packing is from."""
    starts = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("bin", F.lit(-1)).withColumn("origin", F.lit(-1))

    def epoch(number: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["origin", "key"])
            parts = [g for _, g in frame.groupby("origin", sort=True)]
            length, seeds = parts[0]["length"].tolist(), []
            for part in parts if number else []:
                had = part["bin"].to_numpy()
                order = np.argsort(had, kind="stable")
                seeds.append([x.tolist() for x in np.split(order, np.flatnonzero(np.diff(had[order])) + 1)])
            best = evolve(length, capacity, seeds, (int(frame["shard"].iat[0]), int(frame["island"].iat[0]), number))
            out = np.empty(len(length), np.int32)
            for i, b in enumerate(best):
                out[b] = i
            return parts[0].assign(bin=out, bins=len(best)).drop(columns="origin")

        return run

    columns, schema = ["shard", "key", "length", "island", "bin"], "shard long, key long, length int, island int, bin int"
    solved = None
    for e in range(epochs):
        if solved is None:
            rows = starts
        else:  # its own elite and the one of the island before
            own = solved.select(*columns, F.col("island").alias("origin"))
            rows = own.unionByName(own.withColumn("island", (F.col("island") + 1) % islands)) if islands > 1 else own
        solved = materialize(rows.select(*columns, "origin").groupBy("shard", "island").applyInPandas(epoch(e), f"{schema}, bins int"), "pack-epoch")
    best = solved.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    return solved.join(best, ["shard", "island"]).select("key", "shard", "bin")


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """items: key long (unique), length int (1 to capacity) -> key, sequence_id, offset.

    Full pieces are sequences of their own. The rest is dealt to shards by a hash of the key and solved; then all sequences
    with room left, of all shards, are taken apart and packed once more together, in shards of the same size.
    """
    full = items.where(F.col("length") == capacity).select("key")
    small = items.where(F.col("length") < capacity).select("key", F.col("length").cast("int").alias("length"))
    n = small.count()
    if n:
        shards = -(-n // shard_pieces)
        dealt = small.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("long").alias("shard"), "key", "length")
        placed = materialize(_solve(dealt, capacity, epochs, islands).join(small, "key"), "pack-first")
        if shards > 1:
            fill = placed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
            open_bins = fill.where(F.col("fill") < capacity)
            again = placed.join(open_bins.select("shard", "bin"), ["shard", "bin"]).select("key", "length")
            rest = again.count()
            few = -(-max(1, rest) // shard_pieces)
            second = _solve(again.select((F.lit(shards) + F.pmod(F.xxhash64(F.lit("again"), "key"), F.lit(few))).cast("long").alias("shard"), "key", "length"), capacity, epochs, islands).join(small, "key")
            kept = placed.join(open_bins.select("shard", "bin"), ["shard", "bin"], "left_anti")
            placed = materialize(kept.select("key", "shard", "bin", "length").unionByName(second.select("key", "shard", "bin", "length")), "pack-second") if rest else placed
    else:
        placed = small.select("key", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("bin"), "length")
    inside = Window.partitionBy("shard", "bin").orderBy(F.desc("length"), "key").rowsBetween(Window.unboundedPreceding, -1)
    mixed = placed.select("key", (F.shiftleft(F.col("shard"), 32) + F.col("bin")).alias("sequence_id"), F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    alone = full.select("key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return mixed.unionByName(alone)


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A null text is empty and has its end id alone; repeated rows, null ids too, are documents of their own; an empty table
    gives an empty result; columns other than doc_id and text are not read.
    """
    cut = materialize(pieces(docs, path or tokenizer_path(), capacity), "pack-pieces")
    cut = materialize(cut.withColumn("key", F.monotonically_increasing_id()), "pack-items")
    where = pack(cut.select("key", "length"), capacity)
    return cut.join(where, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
