"""Inputs of a pack: expansion, exclusion, unique names, selection."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from moraine.functions.scalar import ARCHIVE_EXTENSIONS, glob_regex


def excluded_path(path: str, globs: Iterable[str]) -> bool:
    patterns = [re.compile(glob_regex(g)) for g in globs]
    return any(p.search(path) or p.search(os.path.basename(path)) for p in patterns)


def expand(inputs: list[str], recursive: bool = False, exclude: Iterable[str] = (), sort: bool = False, follow_links: bool = False, strict: bool = False, warn=lambda text: None) -> list[str]:
    """Input paths after exclusion, directory walks, sorting and removal of repeats, in this order.

    Only walked files need an archive's extension; a directory stays in the list unless `recursive` is set.
    """
    exclude, out = list(exclude), []

    def failed(error: OSError) -> None:
        if strict:
            raise error
        warn(str(error))

    for path in inputs:
        if excluded_path(path, exclude):
            continue
        if recursive and os.path.isdir(path):
            for folder, _, files in os.walk(path, followlinks=follow_links, onerror=failed):
                found = (os.path.join(folder, f) for f in sorted(files))
                out += [f for f in found if os.path.isfile(f) and (follow_links or not os.path.islink(f)) and is_archive(f) and not excluded_path(f, exclude)]
        else:
            out.append(path)
    if sort:
        out.sort(key=lambda p: p.split("/"))
    seen: set[str] = set()
    for path in out:
        if path in seen:
            warn(f"repeated input {path}")
        seen.add(path)
    return list(dict.fromkeys(out))


def is_archive(path: str) -> bool:
    return os.path.splitext(path)[1].lower().lstrip(".") in ARCHIVE_EXTENSIONS


def unique_names(paths: Iterable[str]) -> list[str]:
    """A name for each path: its last component, with __2, __3 ... before the extension until no earlier name is equal."""
    used: dict[str, None] = {}
    for path in paths:
        base = path.rsplit("/", 1)[-1]
        if base in ("", ".", "..") or "\\" in base:
            raise ValueError(f"unsafe name {base!r}")
        stem, extension = os.path.splitext(base)
        name, n = base, 1
        while name in used:
            n += 1
            name = f"{stem}__{n}{extension}"
        used[name] = None
    return list(used)


def select_only(containers: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The containers that are named."""
    return containers.join(names.select(key).distinct(), key, "left_semi")


def unknown_only(names: DataFrame, containers: DataFrame, key: str) -> DataFrame:
    """Names that no container has; they are warned about, not errors."""
    return names.select(key).distinct().join(containers.select(key), key, "left_anti")


def over_budget(metrics: DataFrame, budgets: DataFrame) -> DataFrame:
    """metric, value, limit, over: only a value above its limit is over."""
    return metrics.join(budgets, "metric").select("metric", "value", "limit", (F.col("value") > F.col("limit")).alias("over"))
