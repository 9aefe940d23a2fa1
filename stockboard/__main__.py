"""Command line: run a product or a registered query.

    python -m stockboard product supplier-risk --major 1 --sf-dir DIR \
        --param seit=1998-01-01 --param toleranz_tage=3 --show 20
    python -m stockboard product material-overview --materials PATH --param status=Aktiv \
        --out /shared/out/mo --format json
    python -m stockboard query kpi_board --sf-dir DIR --show 5
    python -m stockboard list

Inputs come either from the test tables (``--sf-dir``, through the entity
views) or from stored entity tables (``--materials``, ``--deliveries``,
``--suppliers``). Results are written (``--out``, Parquet or JSON lines) or a
first page is printed (``--show``); nothing else is collected.
"""
from __future__ import annotations

import argparse
import sys
from collections import defaultdict

def _params(pairs: list[str]) -> dict:
    raw: dict = defaultdict(list)
    for p in pairs:
        key, _, value = p.partition("=")
        raw[key].append(value)
    return {k: (v if len(v) > 1 or k in ("status", "werk", "werk_id", "warengruppe", "risiko_klasse") else v[0])
            for k, v in raw.items()}


def _inputs(spark, args, name: str) -> list:
    from stockboard.operators import contracts as K
    from stockboard.sources import views as V
    from stockboard.sources.tables import read_entity
    if name == "supplier-risk":
        if args.sf_dir:
            return [V.suppliers(spark, args.sf_dir).drop("supplier_key"), V.deliveries(spark, args.sf_dir)]
        return [read_entity(spark, args.suppliers, K.SUPPLIERS), read_entity(spark, args.deliveries, K.DELIVERIES)]
    if args.sf_dir:
        return [V.materials(spark, args.sf_dir)]
    return [read_entity(spark, args.materials, K.MATERIALS)]


def _emit(df, args) -> None:
    if args.out:
        writer = df.write.mode("overwrite")
        (writer.json(args.out) if args.format == "json" else writer.parquet(args.out))
        print(f"written: {args.out}")
    else:
        df.show(args.show, truncate=False)


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="stockboard")
    sub = ap.add_subparsers(dest="cmd", required=True)
    pr = sub.add_parser("product", help="run a product")
    pr.add_argument("name")
    pr.add_argument("--major", type=int, default=None, help="major version; default: latest")
    pr.add_argument("--param", action="append", default=[], help="key=value, repeatable")
    qr = sub.add_parser("query", help="run a registered query")
    qr.add_argument("name")
    sub.add_parser("list", help="list products and registered queries")
    for p in (pr, qr):
        p.add_argument("--sf-dir", help="folder with the test tables")
        p.add_argument("--materials")
        p.add_argument("--deliveries")
        p.add_argument("--suppliers")
        p.add_argument("--out", help="write the result here (shared storage)")
        p.add_argument("--format", choices=("parquet", "json"), default="parquet")
        p.add_argument("--show", type=int, default=20)
    args = ap.parse_args(argv)

    from stockboard.plans import products as P
    from stockboard.plans.queries import QUERIES
    if args.cmd == "list":
        for (name, major), deprecated in sorted((k, p.deprecated) for k, p in P.PRODUCTS.items()):
            print(f"product {name} v{major}{' (deprecated)' if deprecated else ''}")
        for q in sorted(QUERIES):
            print(f"query {q}")
        return 0

    from stockboard.session import local_session
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession() or local_session()
    if args.cmd == "query":
        if not args.sf_dir:
            ap.error("query needs --sf-dir")
        _emit(QUERIES[args.name](spark, args.sf_dir), args)
        return 0
    try:
        product = P.find_product(args.name, args.major)
    except KeyError as error:
        ap.error(error.args[0])
    params, limit, offset = P.parse_request(product.name, product.major, _params(args.param))
    _emit(P.run_product(product.name, product.major, *_inputs(spark, args, product.name), params=params,
                        limit=limit, offset=offset), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
