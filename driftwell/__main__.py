"""``python -m driftwell list`` names the queries; ``run NAME FOLDER`` runs one over a folder of tables."""

from __future__ import annotations

import argparse

from driftwell import catalog
from driftwell.session import local_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="driftwell", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("name", choices=sorted(catalog.queries()), metavar="NAME")
    run.add_argument("folder", help="where the tables are")
    run.add_argument("--out", help="write the result there as Parquet instead of showing it")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    run.add_argument("--cores", default="*")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    result = catalog.queries()[given.name](local_session(given.cores), given.folder)
    if given.out:
        result.write.mode("errorifexists").parquet(given.out)
    else:
        result.show(given.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
