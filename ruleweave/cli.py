"""Run a program file: ``python -m ruleweave.cli program.txt --table edge=edges.parquet``; without a file, read items from
standard input, one a line, and show the relation or atom of each line that begins with ``?``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .program import Program, ProgramError
from .storage import clean


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("file", nargs="?")
    p.add_argument("--provenance", default="unit", help="the tag algebra")
    p.add_argument("-k", "--top-k", type=int, default=3, help="proofs to keep, for algebras over proofs")
    p.add_argument("--query", help="a relation or atom to show instead of the program's queries")
    p.add_argument("--iter-limit", type=int, help="rounds of a recursion after the first")
    p.add_argument("--stop-at-goal", action="store_true")
    p.add_argument("--scheduler", default="lfp", choices=["lfp", "bfs", "dfs", "a-star", "beam"])
    p.add_argument("--beam-size", type=int, default=3)
    p.add_argument("--seed", type=int, default=1234)
    p.add_argument("--output-all", action="store_true", help="show hidden relations too")
    p.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet table as facts")
    p.add_argument("--explain", action="store_true", help="show plans and rounds instead of rows")
    p.add_argument("--monitor", action="store_true", help="print rounds and times")
    p.add_argument("--no-early-discard", action="store_true", help="keep rows whose tag is false")
    p.add_argument("--rows", type=int, default=100)
    a = p.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    program = Program(spark, a.provenance, a.top_k, a.seed, not a.no_early_discard)
    if a.monitor:
        program.monitor(lambda event, data: print(event, data))
    for t in a.table:
        name, _, path = t.partition("=")
        program.add_table(name, spark.read.parquet(path))
    if a.file is None:
        for line in sys.stdin:
            try:
                if line.startswith("?"):
                    name = line[1:].strip()
                    (program.query(name) if "(" in name else program.relation(name)).show(a.rows, truncate=False)
                elif line.strip():
                    program.add(line)
            except ProgramError as error:
                print(error)
        clean(spark)
        return
    program.add_file(a.file)
    program.run(a.iter_limit, "lfp" if a.scheduler == "bfs" else a.scheduler, a.beam_size, a.stop_at_goal)
    shown = [a.query] if a.query else program.outputs() if not a.output_all else sorted(program.results)
    for name in shown:
        print(name)
        atom = "(" in name
        if a.explain and not atom:
            print(f"rounds: {program.rounds.get(name, 0)}")
            print(program.explain(name))
            continue
        (program.query(name) if atom else program.relation(name)).show(a.rows, truncate=False)
    clean(spark)


if __name__ == "__main__":
    main()
