"""Replication as relations: fan-out, acknowledgements, quorum reads, repair.

A tombstone is an answer like any other. Errors are an explicit column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import QuorumNotReached
from ..plans.scratch import written
from . import resolve
from .ring import Ring, with_preferences


@dataclass(frozen=True)
class QuorumConfig:
    """n replicas, w acknowledgements of a write, r answers of a read."""

    n: int = 3
    w: int = 2
    r: int = 2

    def __post_init__(self):
        if min(self.n, self.w, self.r) < 1 or self.w > self.n or self.r > self.n:
            raise ValueError("w and r must be between 1 and n")
        if self.w + self.r <= self.n:
            raise ValueError("w + r must exceed n, else a read can miss the last write")


def write_acks(fan_out: DataFrame, config: QuorumConfig, keys: list[str], ok: str = "ok") -> DataFrame:
    """keys, acks, committed from one row for each replica written to."""
    return fan_out.groupBy(*keys).agg(F.count_if(ok).alias("acks")).withColumn("committed", F.col("acks") >= config.w)


def quorum_read(answers: DataFrame, config: QuorumConfig, keys: tuple[str, ...] = ("key",), rule: str = "version") -> DataFrame:
    """The winner of each key among the replicas' answers, with n_answers; keys
    with fewer than r answers are left out. Deleted keys are in, as tombstones."""
    n = answers.groupBy(*keys).agg(F.countDistinct("replica").alias("n_answers")).where(F.col("n_answers") >= config.r)
    return resolve.winners(answers.join(n, list(keys)), rule, keys)


def require_quorum(answers: DataFrame, config: QuorumConfig) -> None:
    """Raise if some key has too few answers."""
    row = answers.groupBy("key").agg(F.countDistinct("replica").alias("n")).where(F.col("n") < config.r).first()
    if row is not None:
        raise QuorumNotReached(f"{row.key}: {row.n} of {config.r} answers")


def effective_replicas(df: DataFrame, ring: Ring, alive: list[str], n: int = 3, key: str = "key") -> DataFrame:
    """``replicas``: the live ones of the n preferred nodes in clockwise order,
    filled up from the other live nodes in name order (sloppy quorum)."""
    up = F.array(*[F.lit(x) for x in sorted(set(alive))]).cast("array<string>")
    preferred = F.slice("prefs", 1, n)
    here = F.filter(preferred, lambda x: F.array_contains(up, x))
    out = with_preferences(df, ring, key, n)
    return out.withColumn("replicas", F.slice(F.concat(here, F.array_except(up, preferred)), 1, n)).drop("prefs")


def hint_pairs(df: DataFrame, ring: Ring, alive: list[str], n: int = 3, key: str = "key") -> DataFrame:
    """target, fallback: dead preferred nodes paired by position with the live
    nodes that stand in for them."""
    up = F.array(*[F.lit(x) for x in sorted(set(alive))]).cast("array<string>")
    preferred = F.slice("prefs", 1, n)
    out = with_preferences(df, ring, key, n)
    pairs = F.arrays_zip(F.filter(preferred, lambda x: ~F.array_contains(up, x)).alias("target"), F.array_except(up, preferred).alias("fallback"))
    out = out.withColumn("_p", F.explode(pairs)).drop("prefs")
    return out.select(*[c for c in out.columns if c != "_p"], F.col("_p.target").alias("target"), F.col("_p.fallback").alias("fallback")).where("target is not null and fallback is not null")


def deliverable_hints(hints: DataFrame, alive: DataFrame, max_attempts: int = 10) -> DataFrame:
    """Hints whose target is back and that may be tried again."""
    return hints.where(F.col("attempts") < max_attempts).join(alive.select(F.col("node").alias("target_node")).distinct(), "target_node", "left_semi")


def newest_hints(hints: DataFrame, cap: int, order: str = "created") -> DataFrame:
    """At most ``cap`` hints for each target, the oldest go first."""
    w = Window.partitionBy("target_node").orderBy(F.desc(order), F.desc("key"))
    return hints.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def retry_hints(hints: DataFrame, failed: DataFrame, max_attempts: int = 10) -> tuple[DataFrame, DataFrame]:
    """(hints to deliver, hints that stay): each hint that may be tried is
    delivered unless its (target_node, key) is in ``failed``, which counts one
    attempt more. Hints out of attempts stay and aren't tried again."""
    may = F.col("attempts") < max_attempts
    lost = failed.select("target_node", "key").distinct().withColumn("_failed", F.lit(True))
    tried = hints.join(lost, ["target_node", "key"], "left").withColumn("_failed", F.coalesce("_failed", F.lit(False)))
    stay = tried.where(~may | F.col("_failed")).withColumn("attempts", F.when(may, F.col("attempts") + 1).otherwise(F.col("attempts")))
    return tried.where(may & ~F.col("_failed")).drop("_failed"), stay.select(*hints.columns)


def fan_out(rows: DataFrame, ring: Ring, alive: list[str], config: QuorumConfig = QuorumConfig(), failed: DataFrame | None = None, key: str = "key", sloppy: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A coordinator's write: (one row for each replica that is written to, with
    replica, target and ok; acks and committed of each row; hints). Dead
    preferred nodes are stood in for by live ones, which hold the row for their
    ``target``; a write to a preferred node that fails (``failed``: key, replica)
    leaves a hint for it. Deletes go to all preferred nodes (not ``sloppy``) and
    leave a hint for every failure. ``rows`` carry their version and clock."""
    up = F.array(*[F.lit(x) for x in sorted(set(alive))]).cast("array<string>")
    plain = rows.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in rows.columns else rows
    owned = with_preferences(written(plain, "writes"), ring, key, config.n).withColumnRenamed("prefs", "_preferred")
    if sloppy:
        here = F.filter("_preferred", lambda x: F.array_contains(up, x))
        stand = F.slice(F.array_except(up, F.col("_preferred")), 1, F.greatest(F.lit(config.n) - F.size(here), F.lit(0)))
        dead = F.filter("_preferred", lambda x: ~F.array_contains(up, x))
        plain_part = F.transform(here, lambda x: F.struct(x.alias("replica"), F.lit(None).cast("string").alias("target")))
        stand_part = F.transform(stand, lambda x, i: F.struct(x.alias("replica"), F.get(dead, i).alias("target")))
        to = F.concat(plain_part, stand_part)
    else:
        to = F.transform("_preferred", lambda x: F.struct(x.alias("replica"), F.lit(None).cast("string").alias("target")))
    sent = owned.withColumn("_to", F.explode(to)).drop("_preferred").withColumns({"replica": F.col("_to.replica"), "target": F.col("_to.target")}).drop("_to")
    lost = None if failed is None else failed.select(F.col(key).alias("_fk"), F.col("replica").alias("_fr")).distinct().withColumn("_bad", F.lit(True))
    bad = F.lit(False) if lost is None else F.coalesce("_bad", F.lit(False))
    if not sloppy:
        bad = bad | ~F.array_contains(up, F.col("replica"))
    if lost is not None:
        sent = sent.join(lost, (F.col(key) == F.col("_fk")) & (F.col("replica") == F.col("_fr")), "left")
    sent = sent.withColumn("ok", ~bad).drop("_fk", "_fr", "_bad")
    acks = write_acks(sent, config, ["_id", key]).drop("_id")
    hints = sent.where(~F.col("ok") & F.col("target").isNull()).withColumn("target_node", F.col("replica")).drop("replica", "target", "ok", "_id")
    return sent.drop("_id"), acks, hints


def bounded_queue(rows: DataFrame, cap: int, peer: str = "peer", order: str = "seq") -> DataFrame:
    """``rows`` with ``queued``: a queue holds the first ``cap`` rows of a peer
    that arrive, and the newer ones are dropped."""
    w = Window.partitionBy(peer).orderBy(order)
    return rows.withColumn("queued", F.row_number().over(w) <= cap)


def queue_stats(events: DataFrame) -> DataFrame:
    """peer, enqueued, dequeued, dropped, errors, pending of queue events (peer,
    event)."""
    kinds = {"enqueued": "enqueue", "dequeued": "dequeue", "dropped": "drop", "errors": "error"}
    out = events.groupBy("peer").agg(*[F.count_if(F.col("event") == v).alias(k) for k, v in kinds.items()])
    return out.withColumn("pending", F.col("enqueued") - F.col("dequeued"))


def repair_rows(answers: DataFrame) -> DataFrame:
    """key, replica, have, want of every replica that lags behind the winner."""
    want = answers.groupBy("key").agg(F.max("version").alias("want"))
    return answers.join(want, "key").where(F.col("version") < F.col("want")).select("key", "replica", F.col("version").alias("have"), "want")


def majority(answers: DataFrame, value: str = "value") -> DataFrame:
    """key, value, votes, repairs: the most common value (the smaller on a tie)
    and how many replicas hold another."""
    votes = answers.groupBy("key", F.col(value).alias("value")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy("key")
    ranked = votes.withColumn("_r", F.row_number().over(w.orderBy(F.desc("votes"), F.asc("value")))).withColumn("_n", F.sum("votes").over(w))
    return ranked.where("_r = 1").select("key", "value", "votes", (F.col("_n") - F.col("votes")).alias("repairs"))


def anti_entropy(local: DataFrame, remote: DataFrame) -> DataFrame:
    """key, action (push, pull or noop) from two replicas' winners."""
    a = local.select("key", F.col("version").alias("_a"))
    b = remote.select("key", F.col("version").alias("_b"))
    action = F.when(F.col("_b").isNull() | (F.col("_a") > F.col("_b")), "push").when(F.col("_a").isNull() | (F.col("_b") > F.col("_a")), "pull").otherwise("noop")
    return a.join(b, "key", "full_outer").select("key", action.alias("action"))


def group_by_peer(entries: DataFrame, ring: Ring, n: int = 3) -> DataFrame:
    """peer, n_entries, bytes: a replication queue's batches."""
    from .ring import replicas

    out = replicas(entries.drop("node"), ring, n)
    return out.groupBy(F.col("node").alias("peer")).agg(F.count("*").alias("n_entries"), F.sum(F.octet_length("value").cast("long")).alias("bytes"))


def token_valid(epoch_column: str, current_epoch: int):
    """A fencing token holds only in the epoch it was given in."""
    return F.col(epoch_column) == F.lit(current_epoch)
