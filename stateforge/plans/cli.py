"""Command line: `python -m stateforge.plans.cli COMMAND --root DIR [--config FILE] [--set key=value ...]`; options may stand anywhere."""

from __future__ import annotations

import argparse
import inspect
import json
import sys

# The commands, as one word or a group and a word.
COMMANDS = {
    "doctor": "doctor",
    "budget": "budget",
    "audit sparse-kl": "audit_sparse_kl",
    "checkpoint merge": "merge",
    "checkpoint promote": "promote",
    "data prepare": "prepare",
    "data audit-contamination": "audit",
    "data import-eval": "import_eval",
    "data fetch-eval": "fetch_eval",
    "data select-annotations": "select",
    "data build-view": "view",
    "rollout generate": "rollouts",
    "verify math": "verify",
    "teacher annotate": "annotate",
    "train": "train",
    "evaluate": "evaluate",
    "compare": "compare",
    "benchmark run": "benchmark",
    "report build": "report",
    "report failures": "failures",
    "report cost": "cost",
}


def value(s: str):
    try:
        return json.loads(s)
    except ValueError:
        return s


def stage(words: list[str]) -> str:
    """The stage of a command, which may also be named itself."""
    said = " ".join(words)
    if said in COMMANDS:
        return COMMANDS[said]
    if said in COMMANDS.values():
        return said
    raise ValueError(f"no such command: {said or '(none)'}; there are {', '.join(COMMANDS)}")


def main(argv: list[str] | None = None) -> int:
    """0, or 2 with the reason on stderr for what a user can mend."""
    p = argparse.ArgumentParser(prog="stateforge")
    p.add_argument("--root", required=True)
    p.add_argument("--config")
    p.add_argument("--set", action="append", default=[], metavar="key=value", help="an argument of the stage; values are JSON or plain text")
    p.add_argument("command", nargs="*", help=", ".join(COMMANDS))
    args = p.parse_intermixed_args(argv)
    from pyspark.sql import SparkSession

    from stateforge.plans import config as configs
    from stateforge.plans.stages import Stages

    try:
        name = stage(args.command)
        config = configs.load(args.config) if args.config else {}
        stages = Stages(SparkSession.builder.appName(f"stateforge-{name}").getOrCreate(), config, args.root)
        method = getattr(stages, name)
        given = config.get("stages", {}).get(name, {}) | {k: value(v) for k, _, v in (x.partition("=") for x in args.set)}
        inspect.signature(method).bind(**given)
        print(json.dumps(method(**given), ensure_ascii=False, indent=2, sort_keys=True, default=str))
    except (ValueError, KeyError, FileNotFoundError, RuntimeError, TypeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
