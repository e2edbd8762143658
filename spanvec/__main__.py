"""python -m spanvec: build, search, verify, inspect, sign, diagnose, canary and packset commands."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanvec")
    sub = p.add_subparsers(dest="command", required=True)

    def add(to, command: str, /, *positional: str, **options):
        c = to.add_parser(command)
        for x in positional:
            c.add_argument(x)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", type=type(v) if v is not None and not isinstance(v, bool) else str, default=v)
        return c

    add(sub, "build", "input", "out", text_col="text", id_col=None, lists=1024, seed=0, shard_size=0, layout="tables").add_argument("--max-rows", type=int)
    add(sub, "search", "folder", "text", k=5)
    v = add(sub, "verify", "folder", pubkey=None, sig=None)
    v.add_argument("--deep", action="store_true", help="count the rows of every list")
    add(sub, "publish", "folder", "out", key="file", ending="pack")
    f = add(sub, "fidelity", "folder", "queries", "out", name="queries", k=10, probe=8)
    f.add_argument("--max-scan", type=int, default=0)
    add(sub, "inspect", "folder")
    add(sub, "sign", "folder", "key", out=None)
    add(sub, "diagnose")
    add(sub, "canary", "base", "candidate", "queries", k=5, least=0.7, avg=0.8)
    s = sub.add_parser("packset").add_subparsers(dest="action", required=True)
    add(s, "base", "input", "folder", text_col="text", id_col="id", lists=1024, seed=0)
    d = add(s, "delta", "folder", "input", "out", text_col="text", id_col="id", lists=1024, seed=0)
    d.add_argument("--delete", type=int, nargs="*", default=[])
    c = add(s, "create", "base", "out")
    c.add_argument("deltas", nargs="*")
    add(s, "promote-delta", "folder", "delta")
    r = add(s, "revert", "folder")
    r.add_argument("to_seq", type=int)
    add(s, "rebase", "folder", "out", lists=1024, seed=0)
    return p


def main(args: list[str] | None = None, spark=None) -> object:
    a = parser().parse_args(args)
    from pyspark.sql import SparkSession

    from . import api
    from .operators import verify
    from .sources import storage, tables

    spark = spark or SparkSession.builder.appName("spanvec").getOrCreate()
    how = lambda: {k: getattr(a, k) for k in ("text_col", "id_col", "lists", "seed", "shard_size", "max_rows", "layout") if hasattr(a, k)}
    if a.command == "build":
        out = api.build_pack(tables.load(spark, a.input), a.out, **how())
    elif a.command == "search":
        out = api.open_pack(spark, a.folder).search_text(a.text, a.k)
    elif a.command == "verify":
        out = api.verify_pack(a.folder, a.deep)
        if a.pubkey and not api.manifest_signed(spark, a.folder, storage.read_bytes(a.pubkey).decode(), a.sig):
            raise ValueError("the manifest isn't signed by that key")
    elif a.command == "publish":
        out = api.open_pack(spark, a.folder).publish(a.out, a.key, a.ending)
    elif a.command == "fidelity":
        p = api.open_pack(spark, a.folder)
        asked = tables.read_queries(spark, a.queries)
        out = api.fidelity_report(p, p.queries(asked.drop("vector" if asked.where("vector is not null").isEmpty() else "text")), a.out, a.name, a.k, a.probe, a.max_scan)
    elif a.command == "inspect":
        out = [r.asDict() for r in api.inspect_pack(spark, a.folder).collect()]
    elif a.command == "sign":
        out = api.sign_manifest(spark, a.folder, storage.read_bytes(a.key).decode(), a.out)
    elif a.command == "diagnose":
        out = verify.diagnose(spark)
    elif a.command == "canary":
        out = api.run_canary(spark, a.base, a.candidate, tables.read_queries(spark, a.queries), a.k, a.least, a.avg)
    elif a.action == "base":
        out = api.build_packset_base(tables.load(spark, a.input), a.folder, **how())
    elif a.action == "delta":
        out = api.build_delta(a.folder, tables.load(spark, a.input), a.delete, a.out, **how())
    elif a.action == "create":
        out = api.create_packset(a.base, a.deltas, a.out)
    elif a.action == "promote-delta":
        out = api.promote_delta(a.folder, a.delta)
    elif a.action == "revert":
        out = api.revert_packset(a.folder, a.to_seq)
    else:
        out = api.rebase_packset(spark, a.folder, a.out, **how())
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
