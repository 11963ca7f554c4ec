"""Ordered enrichment steps over one table: guards, tags, dependencies and plans from configuration."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Wave:
    """Adds columns to a table; higher priorities run first. Rows outside when get nulls."""

    name: str
    columns: Callable[[DataFrame], dict[str, Column]]
    priority: int = 0
    tags: frozenset[str] = frozenset()
    needs: frozenset[str] = frozenset()
    emits: frozenset[str] = frozenset()
    when: Column | None = field(default=None)


def needed(waves: list[Wave], wanted: set[str]) -> list[Wave]:
    """The waves that the wanted columns depend on, directly or not, by priority; unknown wants are errors."""
    by_output = {c: w for w in waves for c in w.emits}
    chosen: dict[str, Wave] = {}
    open_wants = list(wanted)
    while open_wants:
        c = open_wants.pop()
        if c not in by_output:
            raise ValueError(f"no wave emits {c}")
        w = by_output[c]
        if w.name not in chosen:
            chosen[w.name] = w
            open_wants += [n for n in w.needs if n in by_output]
    return sorted(chosen.values(), key=lambda w: (-w.priority, w.name))


def orphans(waves: list[Wave], base: set[str]) -> dict[str, set[str]]:
    """Needs of each wave that neither the table nor another wave provides."""
    known = base | {c for w in waves for c in w.emits}
    return {w.name: set(w.needs) - known for w in waves if set(w.needs) - known}


def run(df: DataFrame, waves: list[Wave], tags: set[str] | None = None) -> DataFrame:
    """All columns of all waves (of those with one of the tags); one projection a wave, no shuffle."""
    for w in sorted(waves, key=lambda w: (-w.priority, w.name)):
        if tags is not None and not (w.tags & tags):
            continue
        made = w.columns(df)
        df = df.withColumns({c: F.when(w.when, x) if w.when is not None else x for c, x in made.items()})
    return df


#: Steps that a configuration may name.
STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "filter": lambda df, p: df.where(p["where"]),
    "select": lambda df, p: df.select(*p["columns"]),
    "derive": lambda df, p: df.withColumns({k: F.expr(v) for k, v in p["columns"].items()}),
    "distinct": lambda df, p: df.dropDuplicates(p["by"]),
    "top": lambda df, p: df.orderBy(*[F.desc(c) if p.get("descending", True) else F.asc(c) for c in p["by"]], *p.get("ties", [])).limit(int(p["n"])),
    "aggregate": lambda df, p: df.groupBy(*p["by"]).agg(*[F.expr(v).alias(k) for k, v in p["columns"].items()]),
}


def from_config(df: DataFrame, config: str | list[dict]) -> DataFrame:
    """Applies a JSON list of steps, each {"step": name, ...parameters}; unknown steps are errors."""
    steps = json.loads(config) if isinstance(config, str) else config
    for s in steps:
        if s.get("step") not in STEPS:
            raise ValueError(f"unknown step {s.get('step')!r}; there are {', '.join(sorted(STEPS))}")
        df = STEPS[s["step"]](df, s)
    return df
