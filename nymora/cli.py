"""mask, restore and audit a text from a file or standard input, with a vault file. Exit codes: 0, 1 (audit found something), 2 (error)."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .functions.scan import KnownNames
from .sources import vault as vaults


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="nymora", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("mask", "restore", "audit"):
        command = commands.add_parser(name)
        command.add_argument("input", nargs="?", help="a file; standard input by default")
        command.add_argument("--vault", required=True)
        if name != "audit":
            command.add_argument("-o", "--output")
        if name == "mask":
            for option in ("--name", "--org", "--location"):
                command.add_argument(option, action="append", default=[])
            command.add_argument("--names-file", action="append", default=[])
        if name == "restore":
            command.add_argument("--exact", action="store_true")
        if name == "audit":
            command.add_argument("--json", action="store_true")
    return parser


def _same(a: str | None, b: str | None) -> bool:
    return bool(a and b) and (os.path.realpath(a) == os.path.realpath(b) or os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b))


def names_of(lines: list[str]) -> dict[str, list[str]]:
    """Entries of a names file: one a line, ``org:`` or ``location:`` before an organisation or place; # starts a comment line."""
    out: dict[str, list[str]] = {"person": [], "org": [], "location": []}
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            kind, colon, value = line.partition(":")
            known = colon and kind.strip().lower() in out
            out[kind.strip().lower() if known else "person"].append(value.strip() if known else line)
    return out


def _read(path: str | None) -> str:
    if path:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    return sys.stdin.buffer.read().decode("utf-8")


def _write(path: str | None, text: str) -> None:
    if path:
        vaults.write_text(path, text)
    else:
        sys.stdout.buffer.write(text.encode("utf-8"))
        sys.stdout.buffer.flush()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = _parser().parse_args(args)
    try:
        for other in (options.input, getattr(options, "output", None)):
            if _same(options.vault, other):
                raise vaults.VaultError("the vault can't be the input or output as well")
        text = _read(options.input)
        spark = spark or SparkSession.builder.appName("nymora").getOrCreate()
        df = spark.createDataFrame([(0, text)], "ord long, text string")
        if options.command == "mask":
            names = {"person": options.name, "org": options.org, "location": options.location}
            for path in options.names_file:
                for kind, values in names_of(_read(path).splitlines()).items():
                    names[kind] = [*names[kind], *values]
            backends = [KnownNames(names["person"], names["org"], names["location"])] if any(names.values()) else []
            vault = vaults.load(spark, options.vault) if os.path.exists(options.vault) else None
            engine = Engine(spark, names=backends, vault=vault)
            masked = engine.mask(df).head()["masked"]
            vaults.save(engine.vault, options.vault)  # before the output: a masked text without its vault can't be restored
            _write(options.output, masked)
            return 0
        engine = Engine(spark, vault=vaults.load(spark, options.vault))
        if options.command == "restore":
            _write(options.output, engine.restore(df, "text", tolerant=not options.exact).head()["restored"])
            return 0
        found = [f.asDict() for f in engine.audit(df).head()["findings"]]
        _write(None, json.dumps(found, ensure_ascii=False, indent=2) + "\n" if options.json else "".join(f"{f['kind']} {f['type']} {f['start']}-{f['end']}\n" for f in found))
        return int(bool(found))
    except (vaults.VaultError, OSError, UnicodeDecodeError) as e:
        print(f"nymora: {e if isinstance(e, vaults.VaultError) else type(e).__name__}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
