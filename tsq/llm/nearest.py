"""Matching records by nearest time with x-fast tries."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A time shard has 2**SHARD_BITS milliseconds (35 minutes), so it has at most so many distinct times, whatever its rows.
SHARD_BITS = 21
#: Whole shards share a trie up to about so many rows.
TRIE_ROWS = 200_000


class XFastTrie:
    """Sorted distinct keys in 0..2**bits - 1. Each level has a hash table from bit-prefix to the least and greatest key below it.

    neighbours() answers many queries at once: a binary search over the prefix lengths finds each query's longest present prefix,
    whose greatest or least key is its predecessor or successor; the other one follows from the order of the leaves.
    """

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.bits = keys, bits
        self.tables = []
        for length in range(bits + 1):
            prefix = keys >> (bits - length)
            first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
            last = np.r_[first[1:] - 1, len(keys) - 1]
            self.tables.append((pd.Index(prefix[first]), first, last))

    def neighbours(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in keys of the greatest key <= q (-1: none) and the least key >= q (len(keys): none)."""
        lo = np.zeros(len(q), np.int64)
        self._search(q, np.arange(len(q)), 0, self.bits, lo)
        pred, succ = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
        for length in np.unique(lo):
            at = np.flatnonzero(lo == length)
            index, first, last = self.tables[length]
            node = index.get_indexer(q[at] >> (self.bits - length))
            if length == self.bits:  # the key itself
                pred[at] = succ[at] = first[node]
            else:
                # the child on the query's side is missing: all keys below the node lie on the other side of the query
                right = (q[at] >> (self.bits - length - 1)) & 1 == 1
                pred[at] = np.where(right, last[node], first[node] - 1)
                succ[at] = np.where(right, last[node] + 1, first[node])
        return pred, succ

    def _search(self, q: np.ndarray, at: np.ndarray, lo: int, hi: int, out: np.ndarray) -> None:
        """Binary search over the prefix lengths lo..hi of the queries at the given places: those whose search stands at one length are looked up together."""
        if not len(at):
            return
        if lo == hi:
            out[at] = lo
            return
        mid = (lo + hi + 1) // 2
        there = self.tables[mid][0].get_indexer(q[at] >> (self.bits - mid)) >= 0
        self._search(q, at[there], mid, hi, out)
        self._search(q, at[~there], lo, mid - 1, out)


class _Chunk:
    """Rows of whole shards, sorted by (entity, shard, side, t, id), or of a part of one shard. Side 0 is the right one."""

    def __init__(self, table: pa.Table, tolerance: int, bits: int):
        self.table = table.combine_chunks()
        column = lambda c: self.table.column(c).to_numpy()
        shard, t, self.id, self.side = column("shard"), column("t"), column("id"), column("side")
        entity = self.table.column("entity").combine_chunks().dictionary_encode().indices.to_numpy() if len(t) else np.zeros(0, np.int64)
        new = np.r_[True, (entity[1:] != entity[:-1]) | (shard[1:] != shard[:-1])][: len(t)]
        self.starts = np.flatnonzero(new)
        # a key: the number of its shard, and its time from where the shard's margin begins. A shard and its margins are shorter than the lower bits
        # reach by more than the tolerance, so no key of another shard is within the tolerance
        self.lower = int((1 << bits) + 2 * tolerance).bit_length()
        self.bits = self.lower + max(1, int(len(self.starts)).bit_length())
        self.key = (np.cumsum(new) - 1) << self.lower | (t - (shard << bits) + tolerance)
        self.tolerance = tolerance

    def right(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the right rows, of those at one time the one with the least id; and their keys."""
        at = np.flatnonzero(self.side == 0)
        k = self.key[at]
        at = at[np.r_[True, k[1:] != k[:-1]][: len(k)]]
        return at, self.key[at]

    def last(self) -> tuple[int, int]:
        """Key and id of the last row."""
        return int(self.key[-1]), int(self.id[-1])

    def pairs(self, trie: "XFastTrie", ids: np.ndarray, done: tuple[int, int] | None) -> pa.RecordBatch | None:
        """The pairs of the left rows with the keys of the trie, whose ids are given; without the left row that was done before, which may have been repeated."""
        at = np.flatnonzero(self.side == 1)
        if done:
            at = at[(self.key[at] != done[0]) | (self.id[at] != done[1])]
        q, left = self.key[at], self.id[at]
        once = np.r_[True, (q[1:] != q[:-1]) | (left[1:] != left[:-1])][: len(q)]
        q, left = q[once], left[once]
        if not len(q) or not len(ids):
            return None
        t = trie.keys
        pred, succ = trie.neighbours(q)
        far = np.iinfo(np.int64).max
        before = np.where(pred >= 0, q - t[np.maximum(pred, 0)], far)
        after = np.where(succ < len(t), t[np.minimum(succ, len(t) - 1)] - q, far)
        earlier = before <= after
        place, d = np.where(earlier, pred, succ), np.where(earlier, before, after)
        ok = d <= self.tolerance
        return pa.RecordBatch.from_arrays([pa.array(left[ok]), pa.array(ids[place[ok]]), pa.array(d[ok])], names=["left_id", "right_id", "distance"])


def _matcher(tolerance: int, bits: int, most: int):
    """A function over the sorted rows of a partition. What it holds is bounded: about `most` rows of whole shards, or the distinct times of one shard, and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows whose turn has not come: the beginning of a shard, or whole shards
        fresh, kept, done = 0, None, None  # rows that came since; of a long shard the number of its right rows with their trie, and the last left row that was matched

        def matched(c: _Chunk, prior) -> Iterator[pa.RecordBatch]:
            at, keys = c.right()
            trie, ids = prior if prior else (XFastTrie(keys, c.bits), c.id[at]) if len(keys) else (None, at)
            if trie is not None and (out := c.pairs(trie, ids, done)) is not None:
                yield out

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, fresh, kept, done
            if not held:
                return
            c = _Chunk(pa.Table.from_batches(held), tolerance, bits)
            fresh = 0
            if last:
                yield from matched(c, None)
                held = []
                return
            z = int(c.starts[-1])
            if z:  # all shards but the last are whole
                yield from matched(_Chunk(c.table.slice(0, z), tolerance, bits), None)
                rest = c.table.slice(z)
                held, kept, done = rest.to_batches(), None, None
                return
            # one long shard: its right rows come first and are kept once each; its left rows are matched as they come
            at, keys = c.right()
            if (c.side == 1).any():
                if kept is None or kept[0] != len(keys):
                    kept = len(keys), (XFastTrie(keys, c.bits), c.id[at]) if len(keys) else None
                yield from matched(c, kept[1])
                done = c.last() if len(at) else None
            held = c.table.take(pa.array(at)).to_batches() if len(at) else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                fresh += batch.num_rows
            if fresh >= most:
                yield from settle(False)
        yield from settle(True)

    return run


def nearest(left: DataFrame, right: DataFrame, tolerance_ms: int, shard_bits: int = SHARD_BITS) -> DataFrame:
    """Pairs each row of left with the row of right of the same entity that is nearest in time: left_id, right_id, distance (ms).

    Both have the columns entity, t (bigint ms) and id (bigint). Only pairs at most tolerance_ms apart; of two equally near the earlier one; of rows of right
    at one time the least id. Repeated rows of left give one pair. Rows with a null entity, time or id match nothing. Other columns are ignored.

    Both sides are sharded by (entity, time); rows of right within the tolerance of a shard's edge go to both shards, so every pair is found in
    exactly one shard. The shards of a hot entity spread over the cluster. Both sides move in one shuffle; a task reads its shards in order, and
    as many as have about TRIE_ROWS rows together meet in one x-fast trie over the times of right (see XFastTrie). A shard of more rows is
    matched in parts: it has at most 2**shard_bits distinct times of right. The tolerance must be less than a shard.
    """
    width = 1 << shard_bits
    if not 0 <= tolerance_ms < width:
        raise ValueError("the tolerance must lie within a shard")
    full = "entity is not null and t is not null and id is not null"
    shard = lambda x: F.floor(x / F.lit(width)).cast("bigint")
    side = lambda df, n: df.where(full).select("entity", F.lit(n).alias("side"), F.col("t").cast("bigint").alias("t"), F.col("id").cast("bigint").alias("id"))
    le = side(left, 1).withColumn("shards", F.array(shard(F.col("t"))))
    ri = side(right, 0).withColumn("shards", F.array_distinct(F.array(shard(F.col("t") - tolerance_ms), shard(F.col("t")), shard(F.col("t") + tolerance_ms))))
    both = le.unionByName(ri).select("entity", F.explode("shards").alias("shard"), "side", "t", "id")
    both = both.repartition("entity", "shard").sortWithinPartitions("entity", "shard", "side", "t", "id")
    return both.mapInArrow(_matcher(tolerance_ms, shard_bits, TRIE_ROWS), "left_id bigint, right_id bigint, distance bigint")


def _numeric(kind: str, d: str) -> str:
    return f"({kind} in (2, 3) or ({kind} = 4 and not isnan({d})))"


def emits(scalar: DataFrame, vector: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides for nearest(): scalar emits with a number, and vector emits with at least one number in tagged (null and empty lists have none)."""
    s = scalar.where(_numeric("value.kind", "value.d")).selectExpr("pipe as entity", "tp_ms as t", "emit_id as id")
    v = vector.where(f"exists(tagged.value, x -> {_numeric('x.kind', 'x.d')})")
    return s, v.selectExpr("pipe as entity", "tp_ms as t", "emit_id as id")
