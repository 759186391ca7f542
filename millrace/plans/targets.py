"""Targets with dependencies: what a step reads, writes and depends on, so that only what is stale runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from millrace.sources import sinks
from millrace.sources.tables import paths_of, read_json


@dataclass
class Target:
    """A step: `run` gives an exit code; `reads` are files from outside, `writes` what must be there afterwards.

    `settings` are all values that its result depends on; `after` names the targets whose results it reads.
    """

    name: str
    run: Callable[[], int]
    writes: list[str]
    reads: list[str] = field(default_factory=list)
    settings: dict[str, object] = field(default_factory=dict)
    after: list[str] = field(default_factory=list)


def in_order(targets: list[Target], wanted: list[str]) -> list[Target]:
    """The wanted targets with all they depend on, each after those; a circle or an unknown name is an error."""
    known = {t.name: t for t in targets}
    found: list[Target] = []
    open_names: list[str] = []

    def visit(name: str) -> None:
        if name not in known:
            raise ValueError(f"no target is named {name!r}; there are {sorted(known)}")
        if name in open_names:
            raise ValueError("a circle of targets: " + " > ".join([*open_names, name]))
        if known[name] in found:
            return
        open_names.append(name)
        for other in known[name].after:
            visit(other)
        open_names.pop()
        found.append(known[name])

    for name in wanted:
        visit(name)
    return found


def state_of(spark: SparkSession, pattern: str) -> list[list]:
    """Path, length and time of change of the files that a path or a glob names."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for p in paths_of(spark, pattern):
        where = path(p)
        system = where.getFileSystem(conf)
        status = system.getFileStatus(where)
        found += [[s.getPath().toString(), s.getLen(), s.getModificationTime()] for s in (system.listStatus(where) if status.isDirectory() else [status])]
    return found


def fingerprint(spark: SparkSession, target: Target, above: dict[str, str]) -> str:
    """Agrees as long as the settings, the files from outside and the targets before do."""
    told = {"settings": target.settings, "reads": [state_of(spark, p) for p in target.reads], "writes": target.writes, "after": {n: above[n] for n in target.after}}
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:24]


def run_targets(spark: SparkSession, targets: list[Target], wanted: list[str], state: str, log: Callable[[str], None] = print) -> int:
    """Runs what is stale of the wanted targets and all they depend on; a target that fails ends the run with its exit code.

    A target is fresh if what it writes is there and its fingerprint is that of its last
    good run, which is kept in the JSON document `state`, written after each target.
    """
    done: dict[str, str] = read_json(spark, state) or {}
    above: dict[str, str] = {}
    for target in in_order(targets, wanted):
        mark = above[target.name] = fingerprint(spark, target, above)
        if done.get(target.name) == mark and all(paths_of(spark, p) for p in target.writes):
            log(f"{target.name}: up to date")
            continue
        done.pop(target.name, None)
        sinks.write_json(spark, state, done)
        log(f"{target.name}: running")
        if code := target.run():
            return code
        done[target.name] = mark
        sinks.write_json(spark, state, done)
    return 0
