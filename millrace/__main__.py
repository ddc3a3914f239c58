"""Command line: python -m millrace run RAW WORK | upload RAW UPLOADS | dump WORK FOLDER | query WORK SQL."""

from __future__ import annotations

import argparse
import json
import os

from millrace.operators import serving
from millrace.operators.warehouse import Warehouse
from millrace.plans import retail
from millrace.session import build


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace", description="Retail sales: from raw files to a warehouse and its models.")
    parser.add_argument("command", choices=["run", "upload", "dump", "query"])
    parser.add_argument("source", help="folder of raw files, or of a run")
    parser.add_argument("target", help="folder to write to, or a query")
    asked = parser.parse_args(args)
    spark = build()
    salt = os.environ.get("MILLRACE_SALT", "")
    if asked.command == "run":
        progress = lambda i, name: print(f"[{i}/{len(retail.STEPS)}] {name}", flush=True)
        print(json.dumps(retail.run(spark, asked.source, asked.target, salt, progress), default=str, ensure_ascii=False))
    elif asked.command == "upload":
        work, summary = retail.run_upload(spark, asked.source, asked.target, salt)
        print(json.dumps({"work": work} | summary, default=str, ensure_ascii=False))
    elif asked.command == "dump":
        print("\n".join(retail.dump(spark, asked.source, asked.target)))
    else:
        Warehouse(spark, f"{asked.source}/warehouse").views()
        for row in serving.safe_select(spark, asked.target).toJSON().collect():  # MOST_ROWS at most
            print(row)


if __name__ == "__main__":
    main()
