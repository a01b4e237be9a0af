"""Command line: python -m rewind.cli --store PATH COMMAND."""

from __future__ import annotations

import argparse
import json
import sys

from .catalog import CaptureMissing, NoPrimaryKey
from .client import Client, StoreRule
from .jobs import BadJob
from .operators.compensate import CompensationFailed, UntrackedTable
from .plans.preview import HasDependents, InvalidMode, NotFound
from .snapshots import NoSnapshot

#: Exit codes: done, usage, not found, refused for dependents, undo failed, cannot track, no recovery point, interrupted.
EXITS = ((InvalidMode, 2), (BadJob, 2), (StoreRule, 2), (NotFound, 3), (HasDependents, 4), (CompensationFailed, 5), (UntrackedTable, 5), (NoPrimaryKey, 6), (CaptureMissing, 6), (NoSnapshot, 7), (KeyboardInterrupt, 130))


def exit_code(error: BaseException) -> int:
    return next((code for kind, code in EXITS if isinstance(error, kind)), 1)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rewind")
    p.add_argument("--store", required=True)
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *words: str, **options: dict):
        c = sub.add_parser(name)
        for w in words:
            c.add_argument(w, **({"type": int} if w == "txid" else {}))
        for o, kind in options.items():
            c.add_argument("--" + o.replace("_", "-"), **kind)
        return c

    flag, text = {"action": "store_true"}, {"default": None}
    cohort = {"table": text, "fingerprint": text, "since": text, "until": text, "where": text}
    for name in ("init", "status", "doctor", "markers", "snapshots", "track-all", "cycle"):
        command(name)
    command("track", "table")
    command("untrack", "table")
    command("log", table=text, since=text, limit={"type": int, "default": 50}, include_undo=flag)
    command("show", "txid")
    command("preview", "txid")
    command("undo", "txid", cascade=flag, targeted=flag, apply=flag)
    command("cohort", **cohort)
    command("undo-cohort", cascade=flag, targeted=flag, apply=flag, **cohort)
    command("mark", "label")
    command("snapshot", label=text)
    command("recover-table", "table", snapshot=text)
    command("recover-rows", "table", snapshot=text)
    command("recover-column", "table", "column", snapshot=text)
    command("as-of", "at", "sql")
    command("jobs", state={"default": ""})
    command("version")
    return p


def pick_mode(args) -> str:
    if args.cascade and args.targeted:
        raise InvalidMode("--cascade and --targeted exclude each other")
    return "cascade" if args.cascade else "targeted" if args.targeted else "clean_only"


def selector(args) -> dict:
    return {"table": args.table, "fingerprint": args.fingerprint, "since": args.since, "until": args.until, "predicate": json.loads(args.where) if args.where else None}


def run(client: Client, args) -> object:
    """The command's result; undo without --apply is a preview."""
    name = args.command
    if name == "undo":
        mode, plan = pick_mode(args), client.preview(args.txid).as_dict()
        return client.undo(args.txid, mode) if args.apply else plan | {"dry_run": True, "mode": mode}
    if name in ("cohort", "undo-cohort"):
        if name == "cohort" or not args.apply:
            return client.preview_cohort(**selector(args))
        return client.undo_cohort(pick_mode(args), **selector(args))
    if name in ("snapshot", "recover-table", "recover-rows", "recover-column", "as-of", "cycle"):
        given = {k: getattr(args, k, None) for k in ("label", "table", "column", "snapshot", "at", "sql")}
        job = client.runner.submit(name, {k: v for k, v in given.items() if v})
        client.runner.drain()
        return client.queue.get(job)
    simple = {
        "init": client.init, "status": client.status, "doctor": client.doctor, "markers": client.markers, "track-all": client.track_all,
        "track": lambda: client.track(args.table), "untrack": lambda: client.engine.catalog.untrack(args.table), "show": lambda: client.show(args.txid), "preview": lambda: client.preview(args.txid).as_dict(),
        "log": lambda: client.log(table=args.table, since=args.since, limit=args.limit, include_undo=args.include_undo), "mark": lambda: client.mark(args.label),
        "snapshots": lambda: [r.asDict() for r in client.snapshots.list().collect()], "jobs": lambda: client.queue.list(args.state), "version": lambda: {"version": 1},
    }
    return simple[name]()


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        if spark is None:
            from .session import session

            spark = session()
        client = Client(spark, args.store)
        try:
            result = run(client, args)
        finally:
            client.close()
    except (Exception, KeyboardInterrupt) as e:  # noqa: BLE001 - the exit code says which
        print(f"rewind: {e}", file=sys.stderr)
        return exit_code(e)
    print(json.dumps(result, default=str, indent=None if args.json else 1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
