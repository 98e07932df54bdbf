"""Command line: compress, decompress, index, query, version. ``-`` is standard input or output."""

from __future__ import annotations

import argparse
import contextlib
import logging
import os
import shutil
import sys
import tempfile

from . import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readlake")
    p.add_argument("-t", "--threads", type=int, default=0, help="local threads; 0: all")
    p.add_argument("-g", "--log", choices=["debug", "info", "warning", "error", "off"], default="off")
    p.add_argument("-G", "--log-file")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("-e", "--remove", action="store_true", help="delete the input after the archive was verified")
    c.add_argument("-i", "--pack", action="store_true", help="keep what is needed of the reference in the archive")
    c.add_argument("-l", "--level", type=int, choices=range(1, 10), default=5, help="size of blocks")
    d = sub.add_parser("decompress")
    d.add_argument("-m", "--mode", choices=["FAILFAST", "DROPMALFORMED", "PERMISSIVE"], default="FAILFAST", help="what to do with damaged blocks")
    d.add_argument("-z", "--gzip", action="store_true")
    i = sub.add_parser("index")
    q = sub.add_parser("query")
    q.add_argument("-p", "--region", required=True, help="contig:from-to")
    for s in (c, d, i, q):
        s.add_argument("input")
        s.add_argument("-o", "--output")
        s.add_argument("-O", "--folder")
        s.add_argument("-f", "--force", action="store_true")
        s.add_argument("-r", "--reference")
    sub.add_parser("version")
    return p


@contextlib.contextmanager
def spooled(path: str):
    """Standard input as a file, for as long as it is needed; any other path as it is."""
    if path != "-":
        yield path
        return
    with tempfile.NamedTemporaryFile(prefix="readlake-", suffix=".fastq") as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
        f.flush()
        yield f.name


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    if a.log != "off":
        logging.basicConfig(level=a.log.upper(), filename=a.log_file)
    from pyspark.sql import SparkSession

    from . import api
    from .sources.files import output_name, restored_name

    spark = SparkSession.builder.master(f"local[{a.threads or '*'}]").appName("readlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.folder:
        os.makedirs(a.folder, exist_ok=True)
    if a.command == "compress":
        with spooled(a.input) as path:
            api.compress(spark, path, a.output or output_name(a.input, a.folder), a.reference, a.force, a.remove and path == a.input, a.pack, a.level)
    elif a.command == "decompress" and a.output == "-":
        from .sources import archive

        for text in archive.text(archive.read(spark, a.input, api.check_reference(spark, a.input, a.reference))).toLocalIterator(prefetchPartitions=True):
            sys.stdout.buffer.write(text["value"].encode("latin-1") + b"\n")
        sys.stdout.buffer.flush()
    elif a.command == "decompress":
        api.decompress(spark, a.input, a.output or restored_name(a.input, a.folder, a.gzip), a.reference, a.gzip, a.force, a.mode)
    elif a.command == "index":
        api.index(spark, a.input, a.output or output_name(a.input, a.folder, ".index"), a.force)
    else:
        api.query(spark, a.input, a.region, a.reference).show(50, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
