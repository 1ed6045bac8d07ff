"""Top-k search of large tables in runs of like keys.

Every left key can reach its bar only in few places if like right keys stand together:

1. Right keys are ordered by their tokens, frequent ones first, and cut into *runs* of some 32 keys; a *block* holds
   32,768 keys.  The summaries of the runs (:mod:`..functions.runs`) are collected; there are 131,072 at most, as runs
   grow with the table.
2. Each left key is compared with the runs it seems to be most like.  The ``k``-th best row found is its *bar*.
3. Each left key goes to all runs where a key may reach its bar, and is compared with them; no other key matters.

A cell is a block with the left keys that have runs there; a block that very many want is dealt to several cells.
Where the bounds rule nothing out, every left key meets every block, as in the grid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runs import Index, best_in_runs, joined, summarize
from ..session import written

SLACK = 1e-6
BOUND_SLACK = 1e-2  # the bounds are single precision
FREQUENT = 2000  # tokens of at least one in so many keys come first, the most frequent before all others
PARTITION = 131_072  # right keys of a sorted partition
ROUTED = 2048  # left keys of a task that looks for runs
AT_ONCE = 512  # left keys whose runs are given out together


@dataclass(frozen=True)
class Runs:
    """Sizes; the result is the same for any values.  All but ``most`` and ``near`` are powers of two."""

    run: int = 32  # right keys of a run, if there are no more than ``most`` runs
    most: int = 131_072
    block: int = 32_768  # right keys of a cell
    near: int = 512  # right keys that give a left key its bar
    left: int = 16_384  # left keys of a cell

    def sized(self, keys: int) -> Runs:
        """Runs as long as ``most`` of them take, and blocks of whole runs."""
        run = self.run
        while keys > run * self.most:
            run *= 2
        return Runs(run, self.most, max(self.block, run), self.near, self.left)


def pairs_table(left: pa.Table, right: pa.Table, row, col, score) -> pa.Table:
    """Pairs of keys as rows (kind, token_key, ids, score)."""
    ids = right["ids"].take(pa.array(col))
    return pa.table(
        {
            "kind": left["kind"].take(pa.array(row)),
            "token_key": left["token_key"].take(pa.array(row)),
            "ids": ids.cast(pa.list_(pa.field("element", ids.type.value_type))),
            "score": pa.array(score),
        }
    )


def pairs_schema(right: DataFrame) -> str:
    id_type = right.schema["ids"].dataType.elementType.simpleString()
    return f"kind string, token_key string, ids array<{id_type}>, score double"


def _ranks(right: DataFrame) -> tuple[dict[str, dict[str, str]], int]:
    """Frequent tokens of each kind with a character that sorts by their rank, and the number of all keys."""
    sizes = right.groupBy("kind").agg(F.count("*").alias("keys"))
    words = right.selectExpr("kind", "explode(filter(split(token_key, ' '), t -> t <> '')) AS token")
    counts = words.groupBy("kind", "token").agg(F.count("*").alias("n"))
    often = counts.join(F.broadcast(sizes), "kind").where(f"n > 1 AND n * {FREQUENT} >= keys").select("kind", "token", "n")
    ranks: dict[str, dict[str, str]] = {}
    for r in sorted(often.collect(), key=lambda r: (-r["n"], r["token"])):
        of_kind = ranks.setdefault(r["kind"], {})
        if len(of_kind) < 0x9000:
            of_kind[r["token"]] = chr(0x4000 + len(of_kind))
    return ranks, sum(r["keys"] for r in sizes.collect())


def _ordered(right: DataFrame, ranks: dict[str, dict[str, str]], keys: int) -> DataFrame:
    """Written right keys with ``spot``: their places in an order that brings like keys together."""

    def with_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for kind, key in zip(batch["kind"].to_pylist(), batch["token_key"].to_pylist()):
                of_kind, words = ranks.get(kind, {}), (key or "").split(" ")
                often = "".join(sorted(of_kind[w] for w in words if w in of_kind))
                places.append(often + "\uffff" + " ".join(w for w in words if w not in of_kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.string())], [*batch.schema.names, "place"])

    slim = right.select("kind", "token_key", "ids")
    schema = pairs_schema(right).replace("score double", "place string")
    placed = slim.mapInArrow(with_place, schema).repartitionByRange(math.ceil(max(keys, 1) / PARTITION), "kind", "place")
    return written(placed.sortWithinPartitions("kind", "place").selectExpr("kind", "token_key", "ids", "monotonically_increasing_id() AS spot"))


def _summaries(ordered: DataFrame, sizes: Runs, partitions: int) -> dict[str, dict[str, np.ndarray]]:
    """The runs of each kind, collected."""

    def of_block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("spot")
        told = summarize(rows["token_key"].to_pylist(), rows["spot"].to_numpy() // sizes.run)
        return pa.table({"kind": rows["kind"].slice(0, 1), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in told.items()}})

    keyed = ordered.selectExpr("kind", "token_key", "spot", f"spot DIV {sizes.block} AS block").repartition(partitions, "kind", "block")
    fields = "run binary, least binary, most binary, shortest binary, longest binary, tokens binary"
    told = keyed.groupBy("kind", "block").applyInArrow(of_block, f"kind string, {fields}")
    found: dict[str, list] = {}
    for r in told.collect():
        run = np.frombuffer(r["run"], np.int64)
        part = {n: np.frombuffer(r[n], np.uint8).reshape(len(run), -1) for n in ("least", "most", "tokens")}
        part |= {n: np.frombuffer(r[n], np.int32) for n in ("shortest", "longest")}
        found.setdefault(r["kind"], []).append({"run": run, **part})
    return {kind: joined(parts) for kind, parts in found.items()}


def _routes(left: DataFrame, told, sizes: Runs, partitions: int, near: bool) -> DataFrame:
    """Left keys (kind, token_key, cutoff) with the blocks and, as bits, the runs they are compared with."""
    per_block = sizes.block // sizes.run

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {}
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            row, blocks, bits = [], [], []
            for i, (kind, key, cutoff) in enumerate(zip(*(batch[c].to_pylist() for c in ("kind", "token_key", "cutoff")))):
                if kind not in told.value:
                    continue
                if kind not in index:
                    index[kind] = Index(told.value[kind])
                of_kind = index[kind]
                some = of_kind.nearest(key, max(1, sizes.near // sizes.run)) if near else of_kind.reaching(key, cutoff - BOUND_SLACK)
                runs = of_kind.run[some]
                if not len(runs):
                    continue
                block, first = np.unique(runs // per_block, return_index=True)
                slot = np.repeat(np.arange(len(block)), np.diff(np.append(first, len(runs))))
                marked = np.zeros((len(block), per_block), bool)
                marked[slot, runs % per_block] = True
                row += [i] * len(block)
                blocks.append(block)
                bits += [x.tobytes() for x in np.packbits(marked, axis=1)]
            taken = batch.take(pa.array(row, pa.int64()))
            block = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
            columns = [*(taken[c] for c in ("kind", "token_key", "cutoff")), pa.array(block), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "token_key", "cutoff", "block", "runs"])

    spread = left.select("kind", "token_key", "cutoff").repartition(partitions, "kind", "token_key")
    return spread.mapInArrow(route, "kind string, token_key string, cutoff double, block long, runs binary")


def _compared(routes: DataFrame, ordered: DataFrame, sizes: Runs, k: int, partitions: int) -> DataFrame:
    """The best pairs (kind, token_key, ids, score) of every routed left key in every block it goes to."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("spot")
        ids = right["ids"]
        wanted = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) for x in left["runs"].to_pylist()]
        first = pc.list_element(ids, 0).to_numpy()
        run = right["spot"].to_numpy() % sizes.block // sizes.run
        keys = left["token_key"].to_pylist(), right["token_key"].to_pylist()
        return pairs_table(left, right, *best_in_runs(*keys, left["cutoff"].to_numpy(), first, run, wanted, k))

    routes = written(routes)
    wanted = F.broadcast(routes.groupBy("kind", "block").agg(F.expr(f"CAST(ceil(count(*) / {sizes.left}) AS INT) AS parts")))
    place = ["kind", "block", "part"]
    lefts = routes.join(wanted, place[:2]).selectExpr("kind", "token_key", "cutoff", "block", "runs", "CAST(pmod(xxhash64(token_key), parts) AS INT) AS part")
    rights = ordered.selectExpr("*", f"spot DIV {sizes.block} AS block").join(wanted, place[:2])
    rights = rights.selectExpr("kind", "token_key", "ids", "spot", "block", "explode(sequence(0, parts - 1)) AS part")
    return (
        lefts.repartition(partitions, *place)
        .groupBy(*place)
        .cogroup(rights.repartition(partitions, *place).groupBy(*place))
        .applyInArrow(cell, pairs_schema(ordered))
    )


def best_by_runs(left: DataFrame, right: DataFrame, k: int, sizes: Runs, most_tasks: int) -> DataFrame:
    """(kind, token_key, ids, score): for each left key at least the pairs with its ``k`` best right rows.

    ``left`` has (kind, token_key, cutoff), each key once, ``right`` (kind, token_key, ids).  Only scores of at least
    ``cutoff`` count; ties go to the lower first id.
    """
    spark = left.sparkSession
    left, right = written(left.select("kind", "token_key", "cutoff")), written(right)
    ranks, keys = _ranks(right)
    sizes = sizes.sized(keys)
    ordered = _ordered(right, ranks, keys)
    blocks = math.ceil(keys / sizes.block)
    told = spark.sparkContext.broadcast(_summaries(ordered, sizes, min(2 * blocks + 1, most_tasks)))
    lefts = left.count()
    tasks = max(1, min(math.ceil(lefts / ROUTED), most_tasks))
    cells = max(1, min(2 * blocks * max(4, math.ceil(lefts / sizes.left)), most_tasks))

    found = _compared(_routes(left, told, sizes, tasks, near=True), ordered, sizes, k, cells)
    reached = found.selectExpr(
        "kind", "token_key", "score", "sum(size(ids)) OVER (PARTITION BY kind, token_key ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS so_far"
    )
    bars = reached.where(f"so_far >= {int(k)}").groupBy("kind", "token_key").agg(F.max("score").alias("bar"))
    # A little less, so that a tie at the bar is never lost to rounding.
    raised = left.join(bars, ["kind", "token_key"], "left").selectExpr("kind", "token_key", f"greatest(cutoff, coalesce(bar - {SLACK}, cutoff)) AS cutoff")
    return _compared(_routes(raised, told, sizes, tasks, near=False), ordered, sizes, k, cells)
