"""python -m tidemark dump-metadata PATH: commands that restore the views of the engine at PATH."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import ViewEngine


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] != "dump-metadata":
        print(__doc__, file=sys.stderr)
        return 2
    print(*ViewEngine(SparkSession.builder.getOrCreate(), args[1]).restore_commands(), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
