"""Which ids of one table another lacks, by invertible Bloom lookup tables (M5).

Per shard a table of cells holds, for the ids that fall into a cell, their signed number, the exclusive or of the ids and
that of their hashes; each id falls into three cells. Ids of one side count +1, of the other -1, so what both sides have
cancels out, and partial aggregation leaves a few cells per shard and task to be shuffled, however large the tables. A
cell with a single id left gives it away; taking it out of its other cells opens more of them. About one and a half cells
per differing id suffice. Where a table does not open (too many differences, or ids that occur several times), the shard
is compared by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.session import kept

HASHES = 3
LEAST = 32  # cells per hash at least
MOST = 1 << 18  # cells per hash at most; beyond, a join is cheaper
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of the public hash


def hash_long(values: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """What ``xxhash64`` gives for whole numbers, as unsigned numbers."""
    def turned(x, bits):
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    seed = np.asarray(seed).astype(np.uint64) if not isinstance(seed, int) else np.uint64(seed)
    found = seed + _P5 + np.uint64(8)
    found = found ^ (turned(values.astype(np.uint64) * _P2, 31) * _P1)
    found = turned(found, 27) * _P1 + _P4
    found = (found ^ (found >> np.uint64(33))) * _P2
    found = (found ^ (found >> np.uint64(29))) * _P3
    return found ^ (found >> np.uint64(32))


def places(ids: np.ndarray, third: int) -> np.ndarray:
    """The cell of each id under each hash."""
    own = hash_long(ids)
    each = [(hash_long(np.full(len(ids), i), own).view(np.int64) % third) + i * third for i in range(HASHES)]
    return np.stack(each, 1)


def opened(n: np.ndarray, key: np.ndarray, check: np.ndarray, third: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The ids in a table of cells, their signs, and whether the table was opened wholly."""
    n, key, check = n.copy(), key.copy(), check.copy()
    ids, signs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while True:
        one = np.flatnonzero(np.abs(n) == 1)
        one = one[hash_long(key[one]).view(np.int64) == check[one]]
        if not len(one):
            break
        some, first = np.unique(key[one], return_index=True)
        sign = n[one[first]]
        where = places(some, third)
        good = (where == one[first][:, None]).any(1)  # the id belongs to the cell it was found in
        some, sign, where = some[good], sign[good], where[good]
        if not len(some):
            break
        hashes = hash_long(some).view(np.int64)
        for column in where.T:
            np.subtract.at(n, column, sign)
            np.bitwise_xor.at(key, column, some)
            np.bitwise_xor.at(check, column, hashes)
        ids.append(some)
        signs.append(sign)
        if sum(map(len, ids)) > len(n) * HASHES:  # ids that come again and again
            return np.concatenate(ids), np.concatenate(signs), False
    return np.concatenate(ids), np.concatenate(signs), not (n.any() or key.any() or check.any())


def cell_tables(wanted: DataFrame, held: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(shard, third, cell, n, key, check)`` of ``wanted`` minus ``held`` (``shard``, ``vec_id``), cells that are not empty.

    ``sizes`` has ``shard`` and ``third``, the cells per hash, a row per shard.
    """
    def cell(i: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(i).cast("bigint")), F.col("third").cast("bigint")) + i * F.col("third")

    both = wanted.select("shard", "vec_id", F.lit(1).alias("sign")).unionByName(held.select("shard", "vec_id", F.lit(-1).alias("sign")))
    both = both.join(F.broadcast(sizes), "shard")
    each = both.select("shard", "third", "vec_id", "sign", F.explode(F.array(*[cell(i) for i in range(HASHES)])).alias("cell"))
    found = each.groupBy("shard", "third", "cell").agg(
        F.sum("sign").alias("n"), F.bit_xor("vec_id").alias("key"), F.bit_xor(F.xxhash64("vec_id")).alias("check"))
    return found.filter("n <> 0 or key <> 0 or check <> 0")


def differences(tables: DataFrame) -> DataFrame:
    """``(shard, vec_id, sign)`` of the ids in cell tables; a row without id for a shard whose table did not open."""
    kind = "shard int, vec_id long, sign long"

    def work(group: pa.Table) -> pa.Table:
        shard, third = (group.column(x)[0].as_py() for x in ("shard", "third"))
        cell = group.column("cell").to_numpy()
        full = [np.zeros(HASHES * third, np.int64) for _ in range(3)]
        for whole, name in zip(full, ("n", "key", "check"), strict=True):
            whole[cell] = group.column(name).to_numpy()
        ids, signs, done = opened(*full, third)
        if not done:
            ids, signs = pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())
        return pa.table({"shard": pa.array([shard] * len(ids), pa.int32()), "vec_id": pa.array(ids), "sign": pa.array(signs)})

    return tables.groupBy("shard").applyInArrow(work, kind)


def missing_rows(wanted: DataFrame, held: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (with ``shard`` and ``vec_id``) whose id ``held`` lacks, as a left anti join would give them.

    ``expected`` has ``shard`` and ``difference``, about how many ids of it differ; other shards are left out. Null ids are
    in no table and always missing.
    """
    sizes = expected.select("shard", F.greatest(F.lit(LEAST), F.ceil((F.col("difference") + 8) * 0.6)).cast("int").alias("third"))
    sizes = sizes.filter(F.col("third") <= MOST)
    known = wanted.filter("vec_id is not null")
    found = kept(differences(cell_tables(known, held.filter("vec_id is not null"), sizes)), "differences")
    large = expected.select("shard").join(sizes.select("shard"), "shard", "left_anti")
    closed = kept(found.filter("vec_id is null").select("shard").union(large), "closed")  # a row per shard
    ids = F.broadcast(found.filter("sign > 0").select("shard", "vec_id"))  # at most HASHES * MOST per shard that is short
    # An id that the wanted side has twice and the other once is a difference, yet not missing.
    there = F.broadcast(held.join(ids, ["shard", "vec_id"], "left_semi").select("shard", "vec_id").distinct())
    mine = F.broadcast(expected.select("shard").join(closed, "shard", "left_anti"))
    by_sketch = known.join(mine, "shard", "left_semi").join(ids, ["shard", "vec_id"], "left_semi").join(there, ["shard", "vec_id"], "left_anti")
    nameless = wanted.filter("vec_id is null").join(F.broadcast(expected.select("shard")), "shard", "left_semi")
    found_rows = by_sketch.unionByName(nameless)
    if closed.isEmpty():
        return found_rows
    rest = held.join(F.broadcast(closed), "shard", "left_semi").select("shard", "vec_id")
    by_join = known.join(F.broadcast(closed), "shard", "left_semi").join(rest, ["shard", "vec_id"], "left_anti")
    return found_rows.unionByName(by_join)
