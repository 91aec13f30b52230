"""Settings from TOML, with the checks that a node makes before it starts."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import PurePosixPath

from tidemark.functions.predicates import DAYS, GROUPS

# Bounds of the settings.
LEAST_CHUNK, MOST_CHUNK, MOST_PERCENT, DAY_MINUTES = 4096, 64 << 20, 95, 1440
OWNERS = ("numeric", "skip")
#: Settings that are read again while a node runs; any other change needs a restart.
HOT = ("log_level", "ingress_rate", "egress_rate", "global_rate", "peer_rate", "schedule", "free_space_bytes", "free_space_percent")
#: Paths that must lie outside the share, as they would be scanned and replicated; keys above all.
OUTSIDE = ("state", "chunk_dir", "cert", "key", "roster", "socket")


@dataclass(frozen=True)
class Peer:
    node_id: str
    addr: str
    fingerprint: str = ""


@dataclass(frozen=True)
class Rule:
    """Rates on some days from one minute of the day to another; it wraps at midnight if the end is the smaller."""

    days: tuple[str, ...]
    begin: str
    end: str
    global_rate: int = 0
    peer_rate: int = 0

    def check(self) -> Rule:
        for day in self.days:
            if day not in GROUPS and day not in DAYS:
                raise ValueError(f"unknown day: {day}")
        for clock in (self.begin, self.end):
            hour, _, minute = clock.partition(":")
            if not (hour.isdigit() and len(minute) == 2 and minute.isdigit() and int(minute) < 60 and int(hour) * 60 + int(minute) <= DAY_MINUTES):
                raise ValueError(f"not a time of day: {clock}")
        if not self.days or min(self.global_rate, self.peer_rate) < 0:
            raise ValueError("a rule needs days, and rates of 0 or more")
        return self

    def row(self, number: int) -> tuple:
        """As a row of the rules that the schedule operators read."""
        minutes = lambda clock: int(clock.partition(":")[0]) * 60 + int(clock.partition(":")[2])
        return number, list(self.days), minutes(self.begin), minutes(self.end), self.global_rate, self.peer_rate


@dataclass(frozen=True)
class Config:
    node_id: str
    share: str
    state: str
    peers: tuple[Peer, ...] = ()
    chunk_dir: str = ""
    cert: str = ""
    key: str = ""
    roster: str = ""
    socket: str = ""
    health_addr: str = ""
    admin_key: str = ""
    owners: str = "numeric"
    chunk_min: int = 4096
    chunk_avg: int = 16384
    chunk_max: int = 65536
    quiesce_ms: int = 500
    scan_seconds: int = 60
    reconcile_seconds: int = 60
    file_chunks: int = 8
    transfers: int = 4
    serves: int = 8
    max_file_bytes: int = 1 << 40
    free_space_bytes: int = 0
    free_space_percent: float = 0.0
    ingress_rate: str = "0"
    egress_rate: str = "0"
    global_rate: int = 0
    peer_rate: int = 0
    small_bytes: int = 262_144
    schedule: tuple[Rule, ...] = ()
    log_level: str = "info"

    def check(self) -> Config:
        if not LEAST_CHUNK <= self.chunk_min <= self.chunk_avg <= self.chunk_max <= MOST_CHUNK:
            raise ValueError("chunk sizes must satisfy 4096 <= min <= avg <= max <= 64 MiB")
        if not 0 <= self.free_space_percent <= MOST_PERCENT:
            raise ValueError("free_space_percent must be from 0 to 95")
        ids = [self.node_id, *(p.node_id for p in self.peers)]
        if len(set(ids)) != len(ids):
            raise ValueError("node ids must be distinct")
        if self.owners not in OWNERS:
            raise ValueError("owners must be numeric or skip")
        if min(self.file_chunks, self.transfers, self.serves, self.scan_seconds, self.reconcile_seconds) < 1 or min(self.global_rate, self.peer_rate) < 0:
            raise ValueError("counts and periods must be 1 or more, rates 0 or more")
        share = PurePosixPath(os.path.realpath(self.share))
        for name in OUTSIDE:
            if PurePosixPath(os.path.realpath(self.path(name))).is_relative_to(share):
                raise ValueError(f"{name} must lie outside the share")
        return self

    def path(self, name: str) -> str:
        """A path of the settings; those left out stand beside the state."""
        return getattr(self, name) or f"{self.state}.{name}"

    def fingerprints(self) -> frozenset[str]:
        """Those of the peers that have one."""
        return frozenset(p.fingerprint for p in self.peers if p.fingerprint)

    def changed(self, other: Config) -> dict[str, str]:
        """Settings that differ, with what each needs: reload or restart."""
        return {f.name: "reload" if f.name in HOT else "restart" for f in fields(self) if getattr(self, f.name) != getattr(other, f.name)}


def _known(kind: type, given: dict) -> dict:
    names = {f.name for f in fields(kind)}
    if unknown := given.keys() - names:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return given


def load(path: str) -> Config:
    with open(path, "rb") as f:
        given = _known(Config, tomllib.load(f))
    peers = tuple(Peer(**_known(Peer, p)) for p in given.pop("peers", ()))
    rules = tuple(Rule(**(_known(Rule, r) | {"days": tuple(r.get("days", ()))})).check() for r in given.pop("schedule", ()))
    return Config(peers=peers, schedule=rules, **given).check()
