"""Command line: pack, restore, list, verify, spill, job. Exit codes: 0, 1 for an error, 2 for usage, 3 for damage."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from moraine.functions.scalar import bytes_text
from moraine.plans import api, job
from moraine.sources.pack_format import PackError


class Log:
    """What goes to stderr: lines for people, JSON lines, or nothing but warnings."""

    def __init__(self, quiet: bool, as_json: bool):
        self.quiet, self.as_json = quiet, as_json

    def say(self, kind: str, text: str, **values) -> None:
        if self.as_json:
            print(json.dumps({"event": kind, **(values or {"text": text})}), file=sys.stderr)
        elif not self.quiet or kind == "warning":
            print(f"{kind}: {text}", file=sys.stderr)


def packed(spark: SparkSession, o: api.PackOptions, log: Log) -> None:
    o.progress = lambda phase, done: log.say("progress", f"{phase} {done}", phase=phase, done=done)
    summary = api.pack(spark, o)
    for text in summary.warnings:
        log.say("warning", text)
    stats = summary.stats | {"archive_bytes": summary.archive_bytes}
    size = lambda k: bytes_text(stats[k])
    ratio = stats["archive_bytes"] / stats["bytes_in_jars"] if stats["bytes_in_jars"] else 0.0
    log.say("done", f"{stats['jar_count']} containers, {stats['entry_count']} entries, {stats['unique_blob_count']} payloads; {size('bytes_in_jars')} in, {size('archive_bytes')} out ({ratio:.3f})", **stats)
    print(json.dumps(stats))


def restored(spark: SparkSession, path: str, o: api.RestoreOptions, log: Log) -> None:
    values = {f: getattr(o, f) for f in ("clean", "restore_paths", "store_all")}
    for name, backend in api.restore(spark, path, o.folder, o.only, o.overwrite, o.dialect, o.level, warn=lambda text: log.say("warning", text), **values):
        print(f"{name}\t{backend}")


def listed(spark: SparkSession, path: str) -> None:
    """Six columns for each container, and their totals."""
    head = ("name", "entries", "bytes", "signed", "backend", "misses")
    rows, total = [head], [0, 0, 0]
    for r in api.listing(spark, path).orderBy("container").toLocalIterator():
        rows.append((r["container"], str(r["entries"]), bytes_text(r["source_size"]), "signed" if r["signed"] else "-", r["backend"], str(r["misses"])))
        total = [total[0] + r["entries"], total[1] + r["source_size"], total[2] + r["misses"]]
    rows.append((f"{len(rows) - 1} containers", str(total[0]), bytes_text(total[1]), "", "", str(total[2])))
    width = [max(len(r[k]) for r in rows) for k in range(6)]
    for r in rows:
        print("  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip())


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="moraine", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    p = verbs.add_parser("pack", aliases=["dehydrate"])
    p.add_argument("inputs", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--level", type=int, default=6)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--sidecar")
    for flag in ("recursive", "sort-inputs", "strict", "fail-on-signed", "dry-run", "restore-paths"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--format-version", type=int, choices=(1, 2), default=2)
    r = verbs.add_parser("restore", aliases=["unpack", "rehydrate"])
    r.add_argument("pack")
    r.add_argument("-d", "--folder", default=".")
    r.add_argument("--only", action="append")
    r.add_argument("--level", type=int, default=6)
    for flag in ("overwrite", "clean", "restore-paths", "store-all"):
        r.add_argument(f"--{flag}", action="store_true")
    s = verbs.add_parser("spill")
    s.add_argument("pack")
    s.add_argument("folder")
    j = verbs.add_parser("job")
    j.add_argument("file")
    for q in (p, r, j):
        q.add_argument("--json-logs", action="store_true")
        q.add_argument("-q", "--quiet", action="store_true")
    for verb in ("list", "verify"):
        q = verbs.add_parser(verb)
        q.add_argument("pack")
        q.add_argument("--json", action="store_true")
    try:
        a = parser.parse_args(arguments)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("moraine").getOrCreate()
    try:
        log = Log(getattr(a, "quiet", False), getattr(a, "json_logs", False))
        if a.verb in ("pack", "dehydrate"):
            o = api.PackOptions(a.inputs, a.output, a.level, a.recursive, a.exclude, a.sort_inputs, a.strict, a.fail_on_signed, a.sidecar, a.dry_run, restore_paths=a.restore_paths, version=a.format_version)
            packed(spark, o, log)
        elif a.verb in ("restore", "unpack", "rehydrate"):
            restored(spark, a.pack, api.RestoreOptions(a.folder, a.only, a.overwrite, a.clean, a.restore_paths, a.store_all, a.level), log)
        elif a.verb == "spill":
            print(api.spill(spark, a.pack, a.folder))
        elif a.verb == "job":
            pack, restore = job.options(job.load(a.file))
            if pack:
                packed(spark, pack, log)
            if restore:
                restored(spark, *restore, log)
        elif a.verb == "list" and a.json:
            print(json.dumps(api.document(a.pack), indent=2))
        elif a.verb == "list":
            listed(spark, a.pack)
        else:
            found = 0
            for row in api.verify(spark, a.pack).orderBy("severity", "container", "slot", "detail").toLocalIterator():
                found += 1
                print(json.dumps(row.asDict()) if a.json else f"{row['check']}\t{row['container']}\t{row['slot']}\t{row['detail']}")
            return 3 if found else 0
    except PackError as e:
        print(f"damaged: {e}", file=sys.stderr)
        return 3
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def run() -> None:
    """What the installed command calls."""
    sys.exit(main())


if __name__ == "__main__":
    run()
