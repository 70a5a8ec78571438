"""Command line: check a program, or serve one.

    python -m rillstone validate FILE            (rules, or with --streams the stream language)
    python -m rillstone serve FILE --view NAME... [--port N] [--materialized NAME...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from .plans import rule_check, stream_check
from .types import Diagnostic


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="rillstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="what", required=True)
    v = sub.add_parser("validate")
    v.add_argument("file", type=Path)
    v.add_argument("--streams", action="store_true")
    s = sub.add_parser("serve")
    s.add_argument("file", type=Path)
    s.add_argument("--view", nargs="+", required=True)
    s.add_argument("--materialized", nargs="*", default=[])
    s.add_argument("--port", type=int, default=8080)
    args = ap.parse_args(argv)
    text = args.file.read_text()
    try:
        if args.what == "validate":
            found = stream_check.check(text) if args.streams else rule_check.check(text)
            print("ok:", ", ".join(sorted(found.names if args.streams else found.types)))
            return 0
        stream_check.check(text)
    except Diagnostic as e:
        print(f"{args.file}:{e.line}:{e.column}: {e.step}: {e.message}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .streaming.server import Host, serve
    from .streaming.session import StreamSession

    spark = SparkSession.builder.appName("rillstone").getOrCreate()
    server = serve(Host(StreamSession(spark, text, args.view), materialized=frozenset(args.materialized)), args.port)
    print(f"listening on 127.0.0.1:{server.server_port}", flush=True)
    try:
        while True:
            time.sleep(3600)
    except KeyboardInterrupt:
        server.shutdown()
    return 0


if __name__ == "__main__":
    sys.exit(main())
