"""Command line: pack, unpack, list, check, bench, compress, decompress."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.builtin import human_size
from .kernels import containers
from .plans import pack
from .shipping import ship
from .sources.archive import write_blobs


def _sizes(df):
    return df.withColumns({c: human_size(F.col(c)) for c in ("original_size", "compressed_size")})


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="byteplan", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("pack", "unpack", "list", "check", "bench", "compress", "decompress"):
        sub = verbs.add_parser(verb)
        sub.add_argument("path")
        if verb in ("pack", "unpack", "compress", "decompress"):
            sub.add_argument("-o", "--output", required=True)
        if verb == "pack":
            sub.add_argument("--deep", action="store_true")
            sub.add_argument("--max-memory", type=int, default=containers.MAX_MEMORY)
    o = parser.parse_args(args)
    if o.verb in ("compress", "decompress"):
        code = containers.encode_blob if o.verb == "compress" else containers.decode_blob
        Path(o.output).write_bytes(code(Path(o.path).read_bytes()))
        return
    spark = SparkSession.builder.appName(f"byteplan {o.verb}").getOrCreate()
    ship(spark)
    if o.verb == "pack":
        pack.pack(pack.read_blobs(spark, o.path), o.output, deep=o.deep, max_memory=o.max_memory)
    elif o.verb == "unpack":
        write_blobs(pack.unpack(spark, o.path), o.output)
    elif o.verb == "list":
        entries = pack.list_archive(spark, o.path)
        _sizes(entries).show(1000, truncate=60)
        _sizes(pack.summary(entries)).show()
    elif o.verb == "check":
        failed = pack.check(spark, o.path)
        failed.show(1000, truncate=60)
        if failed.filter("n_failed > 0").count():
            raise SystemExit(1)
    else:
        pack.bench(pack.read_blobs(spark, o.path)).show(1000, truncate=60)


if __name__ == "__main__":
    main()
