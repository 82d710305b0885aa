"""``python -m privlytics``: list, run, evaluate, leaderboard, taxonomy, validate-card, reproduce."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("privlytics").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="privlytics", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out", help="folder for Parquet; else a table is printed")
    suite = sub.add_parser("evaluate", help="run detectors over a suite of specs and write a board")
    suite.add_argument("folder", help="folder of specs; a spec's dataset names the path of its JSON lines (doc_id, country, text, spans)")
    suite.add_argument("--adapter", action="append", help="a detector by name, several times for several (default: dummy)")
    suite.add_argument("--out", default="leaderboard.json")
    shown = sub.add_parser("leaderboard", help="print a board")
    shown.add_argument("path")
    sub.add_parser("taxonomy", help="entity types and tags")
    card = sub.add_parser("validate-card", help="check a model card")
    card.add_argument("path")
    card.add_argument("--adapters", nargs="+", required=True)
    again = sub.add_parser("reproduce", help="check the anchor row of a board")
    again.add_argument("path")
    again.add_argument("entry")
    again.add_argument("--config", default="en")
    args = parser.parse_args(argv)

    if args.command == "list":
        from privlytics.plans.registry import QUERIES

        print("\n".join(sorted(QUERIES)))
    elif args.command == "run":
        from privlytics.plans.registry import QUERIES
        from privlytics.sources.files import markdown

        if args.query not in QUERIES:
            parser.error(f"unknown query {args.query!r}")
        df = QUERIES[args.query](_spark(), args.tables)
        df.write.mode("errorifexists").parquet(args.out) if args.out else print(markdown(df))
    elif args.command == "evaluate":
        from privlytics.operators import detectors, leaderboard
        from privlytics.plans.suite import suite_rows
        from privlytics.sources.files import load_suite, write_board

        names = args.adapter or ["dummy"]
        if unknown := [n for n in names if n not in detectors.known()]:
            parser.error(f"unknown detector {', '.join(unknown)}")
        rows, skipped = suite_rows(_spark(), load_suite(args.folder), [detectors.build(n) for n in names])
        for name in skipped:
            print(f"skipped {name}: its data is not there")
        if rows is None:
            print("nothing was evaluated")
            return 1
        write_board(leaderboard.build(rows), args.out)
        print(f"wrote {args.out}")
    elif args.command == "leaderboard":
        from privlytics.operators.leaderboard import board_text

        print(board_text(json.loads(Path(args.path).read_text(encoding="utf-8"))))
    elif args.command == "taxonomy":
        from privlytics.functions import taxonomy

        print("\n".join(f"{n}\t{tier}\t{kind}{' special' if s else ''}" for n, tier, kind, s in taxonomy.ENTITIES))
    elif args.command == "validate-card":
        import yaml

        from privlytics.operators.leaderboard import validate_card

        try:
            validate_card(yaml.safe_load(Path(args.path).read_text(encoding="utf-8")), tuple(args.adapters))
        except (OSError, ValueError) as e:
            print(f"invalid: {e}")
            return 1
        print("valid")
    else:
        from privlytics.operators.comparison import ANCHOR

        rows = json.loads(Path(args.path).read_text(encoding="utf-8")).get("entries", {}).get(args.entry) or []
        row = next((r for r in rows if r.get("config") == args.config), None)
        good = row is not None and row.get("f1") is not None and abs(row["f1"] - ANCHOR["anchor"]) <= ANCHOR["tolerance"] and row.get("n") == ANCHOR["want_n"] and row.get("taxonomy_version") == ANCHOR["want_version"]
        print("reproduced" if good else "not reproduced")
        return 0 if good else 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
