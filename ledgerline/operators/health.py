"""Failure detection, timeouts, membership and circuit breakers as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the failure detectors.
PHI_WINDOW, PHI_LEAST, PHI_DEAD = 1000, 10, 8.0
TIMEOUT_WINDOW, TIMEOUT_LEAST, TIMEOUT_DEFAULT_MS = 100, 3, 500
TIMEOUT_MIN_MS, TIMEOUT_MAX_MS, TIMEOUT_FACTOR, TIMEOUT_QUANTILE = 50, 5000, 2.0, 0.95
SUSPECT_AFTER_S, DEAD_AFTER_S = 30, 60


#: Parts in which the newest rows of a key are looked for first.
PARTS = 64


def newest(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The ``most`` newest rows of each key. Parts of a key, by a hash, are cut
    to as many rows first, so that none with a long history meets in one task."""
    part = Window.partitionBy(key, F.pmod(F.xxhash64(order), F.lit(PARTS))).orderBy(F.desc(order))
    few = df.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= most)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= most).drop("_r")


def latest_intervals(beats: DataFrame, window: int = PHI_WINDOW) -> DataFrame:
    """node, ts_us, gap_us of the last ``window`` gaps between a node's heartbeats."""
    w = Window.partitionBy("node").orderBy("ts_us")
    few = newest(beats.select("node", "ts_us"), "node", "ts_us", window + 1)
    return few.withColumn("gap_us", F.col("ts_us") - F.lag("ts_us").over(w)).where("gap_us is not null")


def phi_accrual(beats: DataFrame, now_us: int) -> DataFrame:
    """node, n_intervals, mean_us, phi, dead at ``now_us``: phi is the elapsed
    time over the mean gap, over ln 10; zero below ten gaps."""
    last = beats.groupBy("node").agg(F.max("ts_us").alias("last_us"))
    gaps = latest_intervals(beats).groupBy("node").agg(F.count("*").alias("n_intervals"), F.avg("gap_us").alias("mean_us"))
    both = last.join(gaps, "node", "left").withColumn("n_intervals", F.coalesce("n_intervals", F.lit(0)))
    phi = (F.lit(now_us) - F.col("last_us")) / F.col("mean_us") / F.log(F.lit(10.0))
    both = both.withColumn("phi", F.when((F.col("n_intervals") < PHI_LEAST) | (F.col("mean_us") <= 0), 0.0).otherwise(phi))
    return both.select("node", "n_intervals", "mean_us", "phi", (F.col("phi") >= PHI_DEAD).alias("dead"))


def ratio_suspicion(beats: DataFrame, now_us: int, window_us: int, nodes: DataFrame | None = None, threshold: float = 8.0, least: int = 3) -> DataFrame:
    """node, n, ratio, available: elapsed time over the mean gap of the
    heartbeats in the ``window_us`` before a node's last; 0 below ``least``
    heartbeats (or two). A node of ``nodes`` without a heartbeat has
    ``threshold`` + 1. Gaps are means in whole nanoseconds."""
    last = beats.groupBy("node").agg(F.max("ts_us").alias("hi"))
    recent = beats.join(F.broadcast(last), "node").where(F.col("ts_us") >= F.col("hi") - window_us)  # one row for each node
    agg = recent.groupBy("node", "hi").agg(F.count("*").alias("n"), F.min("ts_us").alias("lo"))
    mean = F.expr("(hi - lo) * 1000 div greatest(n - 1, 1)")
    ratio = F.when((F.col("n") < max(2, least)) | (mean <= 0), 0.0).otherwise((F.lit(now_us) - F.col("hi")) * 1000.0 / mean)
    out = agg.select("node", "n", ratio.alias("ratio"))
    if nodes is not None:
        out = nodes.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("ratio", F.lit(threshold + 1)).alias("ratio"))
    return out.withColumn("available", F.col("ratio") < threshold)


def adaptive_timeout(samples: DataFrame) -> DataFrame:
    """node, n_samples, timeout_ms from each node's last hundred latencies."""
    last = newest(samples.where("latency_ms is not null").select("node", "seq", "latency_ms"), "node", "seq", TIMEOUT_WINDOW)
    agg = last.groupBy("node").agg(F.count("*").alias("n_samples"), F.expr(f"percentile_disc({TIMEOUT_QUANTILE}) within group (order by latency_ms)").alias("_p"))
    clamped = F.floor(F.greatest(F.lit(float(TIMEOUT_MIN_MS)), F.least(F.lit(float(TIMEOUT_MAX_MS)), F.col("_p") * TIMEOUT_FACTOR)))
    return agg.select("node", "n_samples", F.when(F.col("n_samples") < TIMEOUT_LEAST, TIMEOUT_DEFAULT_MS).otherwise(clamped).cast("long").alias("timeout_ms"))


def timeout_for(replica_rows: DataFrame, timeouts: DataFrame, keys: list[str]) -> DataFrame:
    """The largest timeout among each row group's replicas."""
    joined = replica_rows.join(timeouts.select("node", "timeout_ms"), "node", "left")
    return joined.groupBy(*keys).agg(F.max(F.coalesce("timeout_ms", F.lit(TIMEOUT_DEFAULT_MS))).cast("long").alias("timeout_ms"))


def member_ageing(beats: DataFrame, now_us: int) -> DataFrame:
    """node, silent_us, state: alive, suspect after 30 s, dead after 60 s."""
    last = beats.groupBy("node").agg((F.lit(now_us) - F.max("ts_us")).alias("silent_us"))
    s = F.col("silent_us")
    return last.withColumn("state", F.when(s > DEAD_AFTER_S * 10**6, "dead").when(s > SUSPECT_AFTER_S * 10**6, "suspect").otherwise("alive"))


def merge_members(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Membership after gossip: per node the greater incarnation, then the later
    last_seen, then the worse state, so a merge is commutative and idempotent."""
    rank = F.create_map(*[F.lit(x) for kv in (("alive", 0), ("suspect", 1), ("dead", 2)) for x in kv])
    both = mine.select("node", "state", "last_seen", "incarnation").unionByName(theirs.select("node", "state", "last_seen", "incarnation"))
    w = Window.partitionBy("node").orderBy(F.desc("incarnation"), F.desc("last_seen"), F.desc(F.element_at(rank, F.col("state"))))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_heartbeats(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """node, addr, heartbeat, state after a peer's answer: a node that the peer
    knows by a newer heartbeat, or that is new, is taken over as alive; on equal
    heartbeats the own entry stays."""
    cols = ["node", "addr", "heartbeat", "state"]
    both = mine.select(*cols, F.lit(1).alias("_own")).unionByName(theirs.select("node", "addr", "heartbeat", F.lit("alive").alias("state"), F.lit(0).alias("_own")))
    best = F.max_by(F.struct("addr", "heartbeat", "state"), F.struct("heartbeat", "_own"))
    return both.groupBy("node").agg(best.alias("_b")).select("node", "_b.addr", "_b.heartbeat", "_b.state")


def probe_states(members: DataFrame, probes: DataFrame) -> DataFrame:
    """node, state, last_seen after health checks (node, ts_us, ok): the last
    probe makes a node healthy or unhealthy. Nodes that are leaving or down
    aren't probed, and unknown nodes are ignored."""
    last = probes.groupBy("node").agg(F.max(F.struct("ts_us", "ok")).alias("_p"))
    both = members.join(last, "node", "left")
    counts = F.col("_p").isNotNull() & ~F.col("state").isin("leaving", "down")
    state = F.when(counts, F.when(F.col("_p.ok"), "healthy").otherwise("unhealthy")).otherwise(F.col("state"))
    return both.select("node", state.alias("state"), F.when(counts, F.col("_p.ts_us")).otherwise(F.col("last_seen")).alias("last_seen"))


def latest_state(events: DataFrame, key: str = "node", order: str = "seq") -> DataFrame:
    """The last event of each node: registry and member states from a log."""
    return newest(events, key, order, 1)


def alive_only(df: DataFrame, members: DataFrame, node: str = "node") -> DataFrame:
    up = members.where("state = 'alive'").select(F.col("node").alias(node)).distinct()
    return df.join(up, node, "left_semi")


def member_counts(members: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One row: alive, suspect, dead, total; with ``hints`` also pending_hints."""
    own = [F.count_if(F.col("state") == x).alias(x) for x in ("alive", "suspect", "dead")]
    out = members.agg(*own, F.count("*").alias("total"))
    return out if hints is None else out.crossJoin(hints.agg(F.count("*").alias("pending_hints")))  # one row each


def next_tokens(requests: DataFrame) -> DataFrame:
    """epoch, sequence of fencing tokens: sequences start again in each epoch."""
    w = Window.partitionBy("epoch").orderBy("seq")
    return requests.withColumn("sequence", F.row_number().over(w).cast("long"))



def breaker_step(state: tuple, ok: bool, ts_us: int, threshold: int, open_us: int, probes: int) -> tuple:
    """One event of a breaker: (state, failures, successes, opened_us) after it."""
    name, failures, successes, opened = state
    if name == "open" and ts_us - opened >= open_us:
        name, successes = "half_open", 0
    if name == "open":
        return name, failures, successes, opened
    if name == "half_open":
        if not ok:
            return "open", failures + 1, 0, ts_us
        return ("closed", 0, 0, opened) if successes + 1 >= probes else (name, failures, successes + 1, opened)
    if ok:
        return name, 0, 0, opened
    return ("open", failures + 1, 0, ts_us) if failures + 1 >= threshold else (name, failures + 1, 0, opened)


CLOSED = ("closed", 0, 0, 0)


def rpc_step(state: tuple, ok: bool, ts_us: int, threshold: int, open_us: int, probes: int) -> tuple:
    """One call through a client's breaker. Times count from the last failure,
    and a half-open breaker that is asked later than that opens again, so that
    of calls that come seldom every other is refused. A refused call changes
    nothing else; its state ends in a mark of the refusal."""
    name, failures, successes, failed = state
    late = ts_us - failed > open_us
    if name == "open":
        if not late:
            return name, failures, successes, failed, False
        name, successes = "half_open", 0
    elif name == "half_open" and late:
        return "open", 0, successes, failed, False
    if ok:
        if name == "closed":
            return name, 0, successes, failed, True
        return ("closed", 0, 0, failed, True) if successes + 1 >= probes else (name, failures, successes + 1, failed, True)
    if name == "half_open":
        return "open", 0, 0, ts_us, True
    return ("open" if failures + 1 >= threshold else name), failures + 1, successes, ts_us, True


def rpc_breaker_states(events: DataFrame, threshold: int = 5, open_us: int = 30_000_000, probes: int = 3) -> DataFrame:
    """node, seq, state, allowed of every call (node, seq, ts_us, ok)."""

    def call(state, ok, ts):
        *state, allowed = rpc_step(state, ok, ts, threshold, open_us, probes)
        return tuple(state), (state[0], allowed)

    return _chains(events.select("node", "seq", "ts_us", "ok"), call, CLOSED, "state string, allowed boolean")


def _chains(rows: DataFrame, step, first, kind: str) -> DataFrame:
    """node, seq and what ``step`` gives of every row (node, seq, ts_us, ok). A
    node's rows are one chain: they stream through one task in order (so a hot
    node is one task), and only the state is held, however long the chain."""
    ordered = rows.repartition("node").sortWithinPartitions("node", "ts_us", "seq")
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches):
        import pyarrow as pa

        node, state = object(), first
        for b in batches:
            out = []
            for n, ts, ok in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                if n != node:
                    node, state = n, first
                state, made = step(state, bool(ok), ts)
                out.append(made)
            columns = [pa.array([o[i] for o in out], pa.bool_() if "boolean" in k else pa.string()) for i, k in enumerate(kind.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["node", "seq", *names])

    return ordered.mapInArrow(run, f"node string, seq long, {kind}")


def breaker_states(events: DataFrame, threshold: int = 5, open_us: int = 30_000_000, probes: int = 3) -> DataFrame:
    """node, seq, state after every event (node, seq, ts_us, ok)."""

    def event(state, ok, ts):
        state = breaker_step(state, ok, ts, threshold, open_us, probes)
        return state, (state[0],)

    return _chains(events.select("node", "seq", "ts_us", "ok"), event, CLOSED, "state string")


def token_bucket(events: DataFrame, burst: int, period_us: int) -> DataFrame:
    """key, seq, allowed for requests (key, seq, ts_us): a bucket of ``burst``
    tokens for each key, one more every ``period_us``. Rows stream through a
    task in order, only the bucket is held."""
    rows = events.select("key", "seq", "ts_us").repartition("key").sortWithinPartitions("key", "ts_us", "seq")

    def run(batches):
        import pyarrow as pa

        key, tokens, since = object(), burst, 0
        for b in batches:
            out = []
            for k, ts in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    key, tokens, since = k, burst, ts
                gained = (ts - since) // period_us
                tokens, since = min(burst, tokens + gained), since + gained * period_us
                out.append(tokens > 0)
                tokens -= tokens > 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["key", "seq", "allowed"])

    return rows.mapInArrow(run, "key string, seq long, allowed boolean")


def sample_peers(members: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k live peers without replacement, the same for a seed."""
    return members.where("state = 'alive'").orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), "node")), "node").limit(k)


def gossip_round(members: DataFrame, fan_out: int = 2, seed: int = 42) -> DataFrame:
    """node, peer: whom each live node talks to in a round, ``fan_out`` others
    without replacement. Nodes lie on a circle in a random order of the round
    and talk to those after them, so no node meets all others."""
    place = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), "node")), "node"))  # members of a cluster
    up = members.where("state = 'alive'").select("node").distinct().withColumn("_at", place)
    total = up.agg(F.count("*").alias("_n"))
    own = up.crossJoin(F.broadcast(total)).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(fan_out)))).where("_step < _n")
    own = own.withColumn("_to", (F.col("_at") - 1 + F.col("_step")) % F.col("_n") + 1)
    return own.join(up.select(F.col("_at").alias("_to"), F.col("node").alias("peer")), "_to").select("node", "peer")
