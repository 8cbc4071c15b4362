"""Command line: list the queries, run one to a sink, or show its plan.

python -m driftframe list
python -m driftframe run NAME DATA_DIR [--to PATH --as parquet|csv|json|md]
python -m driftframe explain NAME DATA_DIR
"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from driftframe import plans

    queries, _ = plans.load()
    p = argparse.ArgumentParser(prog="driftframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    for what in ("run", "explain"):
        q = sub.add_parser(what)
        q.add_argument("name", choices=sorted(queries))
        q.add_argument("data")
        if what == "run":
            q.add_argument("--to")
            q.add_argument("--as", dest="kind", default="parquet")
    a = p.parse_args(argv)
    if a.what == "list":
        print("\n".join(sorted(queries)))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"driftframe {a.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = queries[a.name](spark, a.data)
    if a.what == "explain":
        df.explain("formatted")
    elif a.to:
        from driftframe.sources.sinks import save

        save(df, a.to, a.kind)
    else:
        df.show(50, False)


if __name__ == "__main__":
    main()
