"""Configuration: defaults, then a YAML or JSON file, then environment variables, then a check of all rules."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

ENV_PREFIX = "QUILLON"


class ConfigError(ValueError):
    """Every rule that a configuration breaks, one a line."""


@dataclass
class Node:
    id: str
    address: str = ""
    replica_group: int = 0


@dataclass
class Store:
    backend: str = "parquet"
    path: str = "control"


@dataclass
class Switch:
    enabled: bool = False


@dataclass
class LeaderElection:
    enabled: bool = True
    lease_ttl_s: int = 10
    renew_interval_s: int = 3


@dataclass
class Cdc:
    enabled: bool = False
    overflow: str = "drop"
    batch_size: int = 100
    batch_seconds: int = 1


@dataclass
class ScopedKeys:
    enabled: bool = False
    max_age_days: int = 90
    rotate_before_expiry_days: int = 7
    rate_limit_backend: str = "local"


@dataclass
class TenantAffinity:
    enabled: bool = False
    dedicated_groups: list[int] = field(default_factory=list)
    static_map: dict[str, int] = field(default_factory=dict)


@dataclass
class ShadowTarget:
    name: str
    sample_rate: float = 0.05


@dataclass
class Shadow:
    enabled: bool = False
    targets: list[ShadowTarget] = field(default_factory=list)
    diff_buffer_size: int = 10_000


@dataclass
class Server:
    port: int = 7700
    request_timeout_ms: int = 30_000


@dataclass
class Config:
    shards: int = 64
    replication_factor: int = 2
    replica_groups: int = 1
    unavailable_shard_policy: str = "partial"
    nodes: list[Node] = field(default_factory=list)
    task_store: Store = field(default_factory=Store)
    server: Server = field(default_factory=Server)
    leader_election: LeaderElection = field(default_factory=LeaderElection)
    hpa: Switch = field(default_factory=Switch)
    cdc: Cdc = field(default_factory=Cdc)
    search_ui: ScopedKeys = field(default_factory=ScopedKeys)
    tenant_affinity: TenantAffinity = field(default_factory=TenantAffinity)
    shadow: Shadow = field(default_factory=Shadow)

    def problems(self) -> list[str]:
        """The rules that this configuration breaks. The local store has one writer, the shared one any number."""
        c, groups, single = self, self.replica_groups, self.task_store.backend == "local"
        ids = [n.id for n in c.nodes]
        found = [
            (c.shards < 1, "shards must be at least 1"),
            (c.replication_factor < 1, "replication_factor must be at least 1"),
            (c.server.port == 0, "server.port must not be 0"),
            (c.task_store.backend not in ("local", "parquet"), f"no such task store: {c.task_store.backend}"),
            (c.unavailable_shard_policy not in ("partial", "error", "fallback"), f"no such policy: {c.unavailable_shard_policy}"),
            (c.replication_factor > 1 and single, "a replication_factor over 1 needs a shared task store"),
            (groups > 1 and single, "more than one replica group needs a shared task store"),
            (groups > 1 and not c.leader_election.enabled, "more than one replica group needs leader election"),
            (c.hpa.enabled and single, "scaling out needs a shared task store"),
            (c.cdc.enabled and c.cdc.overflow == "store" and single, "a change buffer that overflows to the store needs a shared one"),
            (c.search_ui.enabled and c.search_ui.rotate_before_expiry_days >= c.search_ui.max_age_days, "scoped keys must be rotated before they expire"),
            (c.search_ui.enabled and c.search_ui.rate_limit_backend == "store" and single, "rate limits in the store need a shared one"),
            *((groups > 0 and n.replica_group >= groups, f"node {n.id}: no group {n.replica_group}") for n in c.nodes),
            *((ids.count(i) > 1, f"node {i} is there twice") for i in dict.fromkeys(ids)),
            *((c.tenant_affinity.enabled and g >= groups, f"dedicated group {g} does not exist") for g in c.tenant_affinity.dedicated_groups),
            *((c.tenant_affinity.enabled and g >= groups, f"tenant {t}: no group {g}") for t, g in c.tenant_affinity.static_map.items()),
            *((c.shadow.enabled and not 0 < t.sample_rate <= 1, f"shadow {t.name}: sample_rate must be over 0 and at most 1") for t in c.shadow.targets),
        ]
        return [text for broken, text in found if broken]

    def check(self) -> Config:
        if found := self.problems():
            raise ConfigError("\n".join(found))
        return self


_PARTS = {"nodes": Node, "targets": ShadowTarget}


def _fill(kind: type, given: Mapping[str, Any], where: str = "") -> Any:
    known = {f.name: f for f in fields(kind)}
    if unknown := [k for k in given if k not in known]:
        raise ConfigError(f"no such setting: {', '.join(where + k for k in unknown)}")
    out = {}
    for k, v in given.items():
        default = known[k].default_factory() if callable(known[k].default_factory) else known[k].default
        if is_dataclass(default):
            v = _fill(type(default), v or {}, f"{where}{k}.")
        elif k in _PARTS:
            v = [_fill(_PARTS[k], x, f"{where}{k}.") for x in v or []]
        elif isinstance(default, bool | int | float) and not isinstance(v, bool | int | float):
            raise ConfigError(f"{where}{k}: not a {type(default).__name__}: {v}")
        out[k] = v
    return kind(**out)


def from_mapping(given: Mapping[str, Any], environment: Mapping[str, str] | None = None) -> Config:
    """A checked configuration. Variables such as ``QUILLON_TASK_STORE__BACKEND`` (two underscores between levels) override the mapping."""
    given = json.loads(json.dumps(given))
    for name, text in (os.environ if environment is None else environment).items():
        if name.startswith(f"{ENV_PREFIX}_"):
            *path, last = name[len(ENV_PREFIX) + 1 :].lower().split("__")
            at = given
            for p in path:
                at = at.setdefault(p, {})
            try:
                at[last] = json.loads(text)
            except ValueError:
                at[last] = text
    return _fill(Config, given).check()


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> Config:
    """From a file (JSON is YAML too), or from defaults and the environment alone."""
    if path is None:
        return from_mapping({}, environment)
    text = Path(path).read_text()
    try:
        given = json.loads(text)
    except ValueError:
        import yaml  # only files that are not JSON need it

        given = yaml.safe_load(text) or {}
    return from_mapping(given, environment)


def to_mapping(config: Config) -> dict[str, Any]:
    return asdict(config)
