"""Command line: python -m ledgerline --root DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .model import InvalidEntry, KeyNotFound, clip_text, require_valid
from .functions.text import split_words
from .operators import mutate
from .operators.merkle import global_rank
from .plans.store import Store
from .sources import json_map


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("ledgerline")
    p.add_argument("--root", required=True, help="directory of the table")
    p.add_argument("--node", default="local")
    p.add_argument("--format", choices=("text", "json", "table"), default="text")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *args in (("put", "key", "value"), ("get", "key"), ("delete", "key"), ("keys",), ("stats",), ("compact",), ("import", "file"), ("export", "file"), ("exists", "key"), ("glob", "pattern"), ("config",), ("flush",), ("shell",), ("truncate",)):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
    c = sub.add_parser("scan")
    c.add_argument("prefix", nargs="?", default="")
    c.add_argument("--limit", type=int)
    c.add_argument("--after")
    c.add_argument("--reverse", action="store_true")
    c = sub.add_parser("pressure")
    c.add_argument("--records", type=int, default=10_000)
    c.add_argument("--ops", type=int, default=10_000)
    c.add_argument("--batches", type=int, default=4)
    c = sub.add_parser("bench")
    c.add_argument("--profile", default="A")
    c.add_argument("--records", type=int, default=10_000)
    c.add_argument("--ops", type=int, default=10_000)
    return p


def show(rows: list, form: str, out) -> None:
    for r in rows:
        d = {k: (bytes(v).decode(errors="replace") if isinstance(v, (bytes, bytearray)) else v) for k, v in r.asDict().items()}
        print(json.dumps(d) if form == "json" else " | ".join(str(v) for v in d.values()) if form == "table" else " ".join(str(v) for v in d.values()), file=out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout, lines=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ledgerline").getOrCreate()
    store, now = Store(spark, a.root), time.time_ns()
    try:
        if a.command == "put":
            require_valid(a.key, a.value.encode())
            store.put(a.key, a.value.encode(), a.node, now)
        elif a.command == "delete":
            require_valid(a.key)
            store.delete(a.key, a.node, now)
        elif a.command == "get":
            show([store.table().get(a.key).select("key", "value", "version").first() or _missing(a.key)], a.format, out)
        elif a.command == "exists":
            show(store.table().exists([a.key]).select("key", "found").collect(), a.format, out)
        elif a.command in ("scan", "keys"):
            extra = {"limit": a.limit, "start_after": a.after, "reverse": a.reverse} if a.command == "scan" else {}
            rows = store.table().scan(getattr(a, "prefix", ""), **extra)
            value = clip_text(F.col("value").cast("string")).alias("value")
            show((rows.select("key") if a.command == "keys" else rows.select("key", value, "version")).toLocalIterator(), a.format, out)
        elif a.command == "glob":
            show(store.table().glob(a.pattern).select("key").toLocalIterator(), a.format, out)
        elif a.command == "config":
            print(Settings.load().text(), file=out)
        elif a.command == "stats":
            show(store.table().stats().collect(), a.format, out)
        elif a.command == "compact":
            print(store.compact(now), file=out)
        elif a.command == "truncate":
            print(store.truncate(), file=out)
        elif a.command == "flush":  # a batch is on disk when append() returns
            print(max([0, *store.epochs()]), file=out)
        elif a.command == "shell":
            return shell(a, spark, lines, out)
        elif a.command == "pressure":
            show(pressure(store, a.records, a.ops, a.batches), a.format, out)
        elif a.command == "import":
            rows = global_rank(json_map.read_import_document(spark, a.file).groupBy("key").agg(F.max("value").alias("value")), name="pos")
            good, bad = mutate.batch_put(store.entries(), rows, a.node, now, base=store.last_version())
            store.append(good)
            print(f"rejected {bad.count()}", file=out)
        elif a.command == "export":
            json_map.write_export(store.table().scan(), a.file)
        elif a.command == "bench":
            from . import workload

            began = time.time()
            log = workload.operations(spark, workload.PROFILES[a.profile], a.records, a.ops)
            show(workload.run(workload.preload(spark, a.records), log).collect(), a.format, out)
            print(f"{a.ops / (time.time() - began):.0f} ops/s", file=out)
    except (KeyNotFound, InvalidEntry) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def shell(a, spark: SparkSession, lines, out) -> int:
    """Commands line by line until exit or quit; a wrong one doesn't end it."""
    for line in sys.stdin if lines is None else lines:
        words = split_words(line.strip())
        if words and words[0] in ("exit", "quit"):
            break
        if words and words[0] != "shell":
            try:
                main(["--root", a.root, "--node", a.node, "--format", a.format, *words], spark, out)
            except SystemExit:
                print(f"no such command: {line.strip()}", file=out)
    return 0


def pressure(store: Store, records: int, ops: int, batches: int) -> list:
    """One row for each phase: rows, seconds and rows a second of batched writes
    to the store, of a merge, and of reads of what was written."""
    from pyspark.sql import Row

    from . import workload

    spark, out = store.spark, []

    def phase(name: str, n: int, run) -> None:
        began = time.time()
        run()
        took = time.time() - began
        out.append(Row(phase=name, rows=n, seconds=round(took, 3), rate=round(n / max(took, 1e-9))))

    log = workload.preload(spark, records)
    size = -(-records // batches)
    phase("write", records, lambda: [store.append(log.where((F.col("seq") >= i * size) & (F.col("seq") < (i + 1) * size))) for i in range(batches)])
    phase("compact", records, lambda: store.compact(time.time_ns()))
    mix = workload.operations(spark, workload.PROFILES["C"], records, ops)
    phase("read", ops, lambda: mix.join(store.table().scan().select("key"), "key", "left_semi").count())
    return out


def _missing(key: str):
    raise KeyNotFound(key)


if __name__ == "__main__":
    sys.exit(main())
