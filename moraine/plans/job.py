"""Job files: the options of pack and restore as one document, JSON or (where a YAML reader is installed) YAML."""

from __future__ import annotations

import json
from dataclasses import fields

from .api import PackOptions, RestoreOptions

#: Names of a job's sections and of options that have other names here.
PACK, RESTORE = ("pack", "dehydrate"), ("restore", "rehydrate")
OTHER_NAMES = {"write_sidecar_manifest": "sidecar", "dir": "folder", "deflate_level": "level"}
#: Options of other engines that have no meaning here: Spark decides, or nothing is kept.
NO_EFFECT = frozenset({"jobs", "max_inflight_bytes", "follow_symlinks", "pretty_manifest", "keep_cas", "input"})


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path} isn't JSON, and no YAML reader is installed") from None
        return yaml.safe_load(text)


def _options(kind: type, section: dict, what: str):
    known = {f.name for f in fields(kind)}
    values = {OTHER_NAMES.get(k, k): v for k, v in section.items() if k not in NO_EFFECT}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"{what}: unknown options {', '.join(unknown)}")
    return kind(**values)


def options(job: dict) -> tuple[PackOptions | None, tuple[str, RestoreOptions] | None]:
    """The options of a job's pack, and the pack to restore with its options; None for what it doesn't ask for."""
    if job.get("version") != 1:
        raise ValueError(f"a job of version {job.get('version')!r}")
    section = lambda names: next((job[n] for n in names if n in job), None)
    pack, restore = section(PACK), section(RESTORE)
    return _options(PackOptions, pack, "pack") if pack else None, (restore["input"], _options(RestoreOptions, restore, "restore")) if restore else None
