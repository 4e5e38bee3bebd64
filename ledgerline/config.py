"""Settings from a JSON file and the environment, checked before use."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields

from .operators.quorum import QuorumConfig

PREFIX = "LEDGERLINE_"


@dataclass(frozen=True)
class Settings:
    root: str = ""
    node: str = "local"
    vnodes: int = 150
    replicas: int = 3
    write_quorum: int = 2
    read_quorum: int = 2
    tombstone_ttl_s: int = 24 * 3600
    shuffle_partitions: int = 0

    def __post_init__(self):
        QuorumConfig(self.replicas, self.write_quorum, self.read_quorum)
        if self.vnodes < 1 or self.tombstone_ttl_s < 0 or self.shuffle_partitions < 0:
            raise ValueError("vnodes must be positive, times and partitions not negative")

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Settings:
        """Defaults, then the file, then LEDGERLINE_<NAME> variables."""
        given = json.load(open(path)) if path else {}
        env = os.environ if env is None else env
        known = {f.name: f for f in fields(cls)}
        if extra := set(given) - set(known):
            raise ValueError(f"unknown settings: {sorted(extra)}")
        for name in known:
            if (text := env.get(PREFIX + name.upper())) is not None:
                given[name] = int(text) if isinstance(known[name].default, int) else text
        return cls(**given)

    def spark_conf(self) -> dict[str, str]:
        return {"spark.sql.shuffle.partitions": str(self.shuffle_partitions)} if self.shuffle_partitions else {}

    def text(self) -> str:
        return json.dumps(asdict(self), indent=1)
