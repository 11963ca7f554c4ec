"""Ordered folds and sequential clusterings: budgets, claims, names, subtitles, online clusters, weights."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import jaro_winkler


def within_budget(items: Column, budget: Column | int) -> Column:
    """Of an ordered array of (required, size, id): all required ids, then optional ones while they fit; the first that does not fit ends it."""
    start = F.expr("named_struct('left', cast(0 as long), 'open', true, 'ids', cast(array() as array<long>))")
    total = F.aggregate(F.filter(items, lambda x: x["required"]), F.lit(0).cast("long"), lambda s, x: s + x["size"])

    def step(acc, x):
        fits = acc["open"] & (acc["left"] + x["size"] + total <= budget)
        return F.when(x["required"], F.struct(acc["left"].alias("left"), acc["open"].alias("open"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"))).when(fits, F.struct((acc["left"] + x["size"]).alias("left"), acc["open"].alias("open"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"))).otherwise(F.struct(acc["left"].alias("left"), F.lit(False).alias("open"), acc["ids"].alias("ids")))

    return F.aggregate(items, start, step, lambda a: a["ids"])


def _sequential(df: DataFrame, group: str, schema: str, run) -> DataFrame:
    return df.groupBy(group).applyInPandas(run, schema)


def online_clusters(df: DataFrame, group: str, key: str, vector: str, least: float = 0.85) -> DataFrame:
    """(group, key, cluster): each vector in key order joins the nearest centroid within the similarity, or opens a cluster; centroids are running means."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        sums: list[np.ndarray] = []
        units = np.empty((0, 0))  # of the first sums, grown by doubling
        counts: list[int] = []
        out = []
        for v in pdf[vector]:
            x = np.asarray(v, float)
            n, best = len(sums), -1
            size = float(np.linalg.norm(x))
            if n:
                near = np.nan_to_num(units[:n] @ (x / max(size, 1e-12)), nan=-2.0)  # what is not finite is alike to nothing
                # the product finds who can be nearest or alike at all, the similarity itself decides
                top = near.max()
                for i in np.flatnonzero(near >= top - 1e-9) if not top < least - 1e-9 else ():
                    sim = float(x @ sums[i]) / max(float(np.linalg.norm(x) * np.linalg.norm(sums[i])), 1e-12)
                    if best < 0 or sim > most:
                        best, most = int(i), sim
            if best < 0 or most < least:
                sums.append(x.copy())
                counts.append(1)
                best = len(sums) - 1
                if best >= len(units):
                    units = np.concatenate([units.reshape(-1, len(x)), np.zeros((max(64, best), len(x)))])
            else:
                sums[best] += x
                counts[best] += 1
            units[best] = sums[best] / max(float(np.linalg.norm(sums[best])), 1e-12)
            out.append(best)
        return pd.DataFrame({group: pdf[group].to_numpy(), key: pdf[key].to_numpy(), "cluster": out})

    kinds = df.schema[group].dataType.simpleString(), df.schema[key].dataType.simpleString()
    return _sequential(df.where(F.col(vector).isNotNull()).select(group, key, vector), group, f"{group} {kinds[0]}, {key} {kinds[1]}, cluster int", run)


def merge_names(df: DataFrame, group: str, key: str, name: str, least: float = 0.85) -> DataFrame:
    """(group, key, canonical): names in key order merge into the first canonical name that is similar enough; the longer by over three becomes canonical."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        canon: list[str] = []
        place = []
        for n in pdf[name]:
            found = next((i for i, c in enumerate(canon) if c.lower() == n.lower() or (0.7 * jaro_winkler(c.lower(), n.lower()) + 0.3 * SequenceMatcher(None, c.lower(), n.lower()).ratio()) >= least), None)
            if found is None:
                canon.append(n)
                found = len(canon) - 1
            elif len(n) > len(canon[found]) + 3:
                canon[found] = n
            place.append(found)
        return pd.DataFrame({group: pdf[group].to_numpy(), key: pdf[key].to_numpy(), "canonical": [canon[i] for i in place]})

    kinds = df.schema[group].dataType.simpleString(), df.schema[key].dataType.simpleString()
    return _sequential(df.where(F.col(name).isNotNull()).select(group, key, name), group, f"{group} {kinds[0]}, {key} {kinds[1]}, canonical string", run)


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance of a and b is at most most.

    Bounds by length and by character counts come first. The matrix is computed by
    columns as bits of whole numbers (Myers, Hyyro), and ends when even a match of all
    that is left would exceed the bound.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not b:
        return len(a) <= most
    if (Counter(a) - Counter(b)).total() > most:
        return False
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for left, y in enumerate(b, 1 - len(b)):
        eq = places.get(y, 0)
        same = (((eq & up) + up) ^ up) | eq | down
        more = down | (full & ~(same | up))
        less = up & same
        if more & last:
            distance += 1
        elif less & last:
            distance -= 1
        if distance + left > most:
            return False
        more = (more << 1 | 1) & full
        less = (less << 1) & full
        cross = eq | down
        up = less | (full & ~(cross | more))
        down = more & cross
    return distance <= most


def subtitles(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, key, text): of neighbouring texts that contain each other or differ in at most max(3, 15 %) edits the longer stays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for k, t in pdf.sort_values(key)[[key, text]].itertuples(index=False):
            if kept:
                old = kept[-1][1]
                if old in t or t in old or within_edits(old, t, max(3, int(0.15 * max(len(old), len(t))))):
                    if len(t) > len(old):
                        kept[-1][1] = t
                    continue
            kept.append([k, t])
        return pd.DataFrame({group: pdf[group].iloc[0], key: [k for k, _ in kept], "text": [t for _, t in kept]})

    kinds = df.schema[group].dataType.simpleString(), df.schema[key].dataType.simpleString()
    return _sequential(df.where(F.col(text).isNotNull()).select(group, key, text), group, f"{group} {kinds[0]}, {key} {kinds[1]}, text string", run)


def effectiveness(df: DataFrame, group: str, key: str, days: str, agrees: str, rate: float = 0.95) -> DataFrame:
    """(group, weight, n): weights decay by age and move by one over the root of the count with each verdict, within 0 and 2."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, n, last = 1.0, 0, None
        for d, ok in pdf.sort_values(key)[[days, agrees]].itertuples(index=False):
            w *= rate ** max(0.0, float(d - last)) if last is not None else 1.0
            w = min(2.0, max(0.0, w + (1 if ok else -1) / np.sqrt(n + 1)))
            n, last = n + 1, d
        return pd.DataFrame({group: [pdf[group].iloc[0]], "weight": [w], "n": [n]})

    kind = df.schema[group].dataType.simpleString()
    return _sequential(df.select(group, key, days, agrees), group, f"{group} {kind}, weight double, n long", run)
