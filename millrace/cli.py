"""``python -m millrace.cli run package.module --key value``: runs the pipeline that the module's ``create(config)`` gives."""

from __future__ import annotations

import importlib
import sys

from pyspark.sql import SparkSession

from millrace.pipeline import Pipeline


def scalar(text: str):
    """A command-line value: true or false, a whole number, a number, or text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def options(args: list[str]) -> dict:
    """``--some-key value`` pairs as ``some_key``; a key without a value is true."""
    out, i = {}, 0
    while i < len(args):
        if not args[i].startswith("--"):
            raise SystemExit(f"{args[i]} belongs to no option")
        key, eq, value = args[i][2:].partition("=")
        if not eq and i + 1 < len(args) and not args[i + 1].startswith("--"):
            value, eq = args[i + 1], "="
            i += 1
        out[key.replace("-", "_")] = scalar(value) if eq else True
        i += 1
    return out


def main(args: list[str] | None = None) -> dict:
    args = sys.argv[1:] if args is None else args
    if len(args) < 2 or args[0] != "run":
        raise SystemExit(__doc__)
    pipeline = importlib.import_module(args[1]).create(options(args[2:]))
    if not isinstance(pipeline, Pipeline):
        raise SystemExit(f"{args[1]}.create gave no pipeline")
    return pipeline.run(SparkSession.builder.appName(pipeline.name).getOrCreate())


if __name__ == "__main__":
    print(main())
