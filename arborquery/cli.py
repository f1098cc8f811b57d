"""python -m arborquery [start...] [-conf FILE] [-updatedb] [expression]

Without an expression everything below the starts is printed; after -updatedb nothing is. The start is the current
directory by default. Exit codes: 0, 1 for a wrong expression or settings, 3 for a failed update, 4 without an index.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from .engine import Engine, Settings
from .plans import nodes as n
from .plans.parser import parse


def main(arguments: list[str], spark: SparkSession | None = None, out=None) -> int:
    starts: list[str] = []
    conf, update = None, False
    rest = list(arguments)
    while rest:
        if rest[0] == "-conf":
            if len(rest) < 2:
                print("-conf needs a file", file=sys.stderr)
                return 1
            conf = rest[1]
            del rest[:2]
        elif rest[0] == "-updatedb":
            update = True
            del rest[0]
        elif rest[0][:1] in ("-", "!", "(") or starts and rest[0] == "":
            break
        else:
            starts.append(os.path.realpath(rest.pop(0)))
    try:
        settings = Settings.load(conf) if conf else Settings.default()
        tree = parse(rest) if rest else n.Const(not update)
    except (ValueError, OSError, NotImplementedError) as e:
        print(e, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("arborquery").getOrCreate()
    engine = Engine(spark, settings)
    if update:
        try:
            engine.update()
        except Exception as e:
            print(e, file=sys.stderr)
            return 3
    if tree == n.Const(False):
        return 0
    if not engine.has_data():
        print("there is no index; make one with -updatedb", file=sys.stderr)
        return 4
    try:
        engine.run(tree, starts=starts or [os.getcwd()], out=out or sys.stdout, confirm=lambda command: input(f"{command} ? ")[:1] in ("y", "Y"), live=True)
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
    return 0
