"""Consistent-hash placement.

A ring is a small list on the driver (nodes times virtual nodes). Each segment
carries the first nodes of its preference list, as many as are asked for, so a
key needs one lookup, and the table of a large ring stays narrow. Lookups are equi-joins on the leading bits of
the hash, with the range as a residual: a broadcast hash join, never a nested
loop.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import RING_SIZE, ring_position, ring_position_of

VNODES = 150
HEAD_BITS = 10


class Ring:
    """Positions of virtual nodes; on a collision the node added later owns it."""

    def __init__(self, nodes: list[str], vnodes: int = VNODES):
        self.nodes, self.vnodes = list(dict.fromkeys(nodes)), vnodes
        at: dict[int, str] = {}
        for node in self.nodes:
            for i in range(vnodes):
                at[ring_position_of(f"{node}#vnode{i}")] = node
        self.positions = sorted(at)
        self.owners = [at[p] for p in self.positions]

    def with_node(self, node: str) -> Ring:
        return Ring([*self.nodes, node], self.vnodes)

    def without_node(self, node: str) -> Ring:
        return Ring([n for n in self.nodes if n != node], self.vnodes)

    def preference(self, i: int, most: int | None = None) -> list[str]:
        """The distinct nodes clockwise from position number ``i``, the first
        ``most`` of them."""
        most = min(len(self.nodes), most or len(self.nodes))
        out: dict[str, None] = {}
        for j in range(len(self.positions)):
            out[self.owners[(i + j) % len(self.positions)]] = None
            if len(out) == most:
                break
        return list(out)

    def owner_of(self, key: str) -> str:
        i = bisect_left(self.positions, ring_position_of(key)) % len(self.positions)
        return self.owners[i]

    def segments(self, most: int | None = None) -> list[tuple[int, int, list[str]]]:
        """(first hash, last hash, preference list), the wrap as two segments."""
        out, low = [], 0
        for i, p in enumerate(self.positions):
            out.append((low, p, self.preference(i, most)))
            low = p + 1
        if self.positions and low < RING_SIZE:
            out.append((low, RING_SIZE - 1, self.preference(0, most)))
        return out

    def lookup(self, spark: SparkSession, most: int | None = None) -> DataFrame:
        """Segments cut at the boundaries of the hash's leading bits."""
        step = RING_SIZE >> HEAD_BITS
        rows = []
        for lo, hi, prefs in self.segments(most):
            for head in range(lo // step, hi // step + 1):
                rows.append((head, max(lo, head * step), min(hi, head * step + step - 1), prefs))
        return spark.createDataFrame(rows, "_head long, _lo long, _hi long, prefs array<string>")

    def sampled(self, most: int = 200) -> list[tuple[int, str]]:
        """Every k-th position with its owner, at most ``most``, for a picture."""
        step = max(1, -(-len(self.positions) // most))
        return list(zip(self.positions, self.owners))[::step]

    def vnodes_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.positions, self.owners)), "position long, node string")


def with_preferences(df: DataFrame, ring: Ring, key: str = "key", most: int | None = None) -> DataFrame:
    """``df`` with ``prefs``, the first ``most`` nodes in the key's clockwise order."""
    h = ring_position(F.col(key))
    own = df.withColumn("_h", h).withColumn("_head", F.shiftrightunsigned("_h", 32 - HEAD_BITS))
    # at most nodes * vnodes + 2^HEAD_BITS rows
    return own.join(F.broadcast(ring.lookup(df.sparkSession, most)), ["_head"]).where("_h between _lo and _hi").drop("_h", "_head", "_lo", "_hi")


def owners(df: DataFrame, ring: Ring, key: str = "key") -> DataFrame:
    return with_preferences(df, ring, key, 1).withColumn("owner", F.element_at("prefs", 1)).drop("prefs")


def replicas(df: DataFrame, ring: Ring, n: int = 3, key: str = "key") -> DataFrame:
    """One row for each replica of a row: replica_index from 0, and node."""
    prefs = with_preferences(df, ring, key, n)
    rest = [c for c in prefs.columns if c not in ("prefs", "node", "replica_index")]
    return prefs.select(*rest, F.posexplode(F.slice("prefs", 1, n)).alias("replica_index", "node"))


def distribution(spark: SparkSession, ring: Ring) -> DataFrame:
    """node, vnodes, pct of the virtual nodes, pct_width of the hash space."""
    rows, low = {n: [0, 0] for n in ring.nodes}, ring.positions[-1] - RING_SIZE
    for p, n in zip(ring.positions, ring.owners):
        rows[n][0] += 1
        rows[n][1] += p - low
        low = p
    total = len(ring.positions)
    return spark.createDataFrame([(n, c, c * 100.0 / total, w * 100.0 / RING_SIZE) for n, (c, w) in rows.items()], "node string, vnodes long, pct double, pct_width double")


def movement(df: DataFrame, before: Ring, after: Ring, key: str = "key") -> DataFrame:
    """from_node, to_node, n_keys of the keys whose owner changes."""
    a = owners(df.select(key).distinct(), before, key).withColumnRenamed("owner", "from_node")
    both = owners(a, after, key).withColumnRenamed("owner", "to_node")
    return both.where("from_node <> to_node").groupBy("from_node", "to_node").agg(F.count("*").alias("n_keys"))
