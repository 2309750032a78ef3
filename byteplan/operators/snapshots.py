"""Published dictionaries as tables: sealing, statistics, deltas, and programs that name a snapshot by its hash.

A snapshot is one file and so one row; its patterns are a dictionary of bounded size. Programs meet their snapshot
in a join by hash. Many programs may name the same one, so their rows are spread over salted copies of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import functions, kernel
from ..kernels import containers
from ..kernels.errors import CODES, FormatError, VmError

_K = functions()

#: Copies of each snapshot that is named, over which the programs naming it are spread.
SALTS = 32

_CONTENTS = "struct<hash:string,domain:string,version:string,patterns:array<struct<id:bigint,pattern:binary>>,error:string>"
_NEEDS = "struct<source:string,snapshot:string,urls:array<string>,error:string>"


def _seal(domain: str, patterns: list) -> bytes:
    return containers.Snapshot({p["rank"]: bytes(p["pattern"]) for p in patterns}, domain).encode()


def _contents(content: bytes) -> dict:
    try:
        s = containers.Snapshot.decode(content)
    except (FormatError, UnicodeDecodeError) as e:
        return {"error": getattr(e, "name", "BAD_PAYLOAD")}
    return {"hash": s.hash.hex(), "domain": s.domain, "version": "%d.%d" % s.version, "patterns": [{"id": k, "pattern": s.patterns[k]} for k in sorted(s.patterns)]}


def _needs(content: bytes) -> dict:
    try:
        p = containers.ProgramFile.decode(content)
    except (FormatError, UnicodeDecodeError) as e:
        return {"error": getattr(e, "name", "BAD_PAYLOAD")}
    return {"source": p.source, "snapshot": p.snapshot and p.snapshot.hex(), "urls": p.urls}


def _execute(content: bytes, snapshot: bytes | None) -> dict:
    try:
        published = containers.Snapshot.decode(snapshot) if snapshot is not None else None
        return {"ok": True, "code": 0, "output": containers.ProgramFile.decode(content).execute(published)}
    except VmError as e:
        return {"ok": False, "code": e.code, "output": None}


def publish(patterns: DataFrame) -> DataFrame:
    """(domain, content): one sealed snapshot of each corpus's (corpus, rank, pattern). A null corpus is ``default``."""
    rows = patterns.groupBy(F.coalesce("corpus", F.lit("default")).alias("domain")).agg(F.sort_array(F.collect_list(F.struct("rank", "pattern"))).alias("p"))
    return rows.select("domain", kernel(lambda domain, p: _seal(domain, p), "binary")("domain", "p").alias("content"))


def snapshot_table(files: DataFrame) -> DataFrame:
    """(hash, domain, version, patterns, error, content) of snapshot files; a damaged one has an error and no hash."""
    rows = files.select(kernel(lambda content: _contents(content), _CONTENTS)("content").alias("s"), "content")
    return rows.select("s.*", "content")


def snapshot_patterns(table: DataFrame) -> DataFrame:
    """(hash, domain, id, pattern, entry_hash): a row for each pattern of readable snapshots."""
    rows = table.filter("error IS NULL").select("hash", "domain", F.explode("patterns").alias("p")).select("hash", "domain", "p.*")
    return rows.withColumn("entry_hash", F.sha2("pattern", 256))


def snapshot_statistics(patterns: DataFrame) -> DataFrame:
    """(corpus, n, avg_len, h_pattern) of (corpus, rank, pattern): size and entropy of each corpus's dictionary."""
    rows = patterns.groupBy("corpus").agg(F.count("*").alias("n"), F.avg(F.octet_length("pattern")).alias("avg_len"), F.sort_array(F.collect_list(F.struct("rank", F.hex("pattern").alias("h")))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), ""))
    return rows.select("corpus", "n", "avg_len", _K["byte_entropy"](joined).alias("h_pattern"))


def with_delta(base: DataFrame, delta: DataFrame) -> DataFrame:
    """(corpus, rank, pattern) of a later snapshot: the base's patterns with the delta's added, or put in their place."""
    columns = ["corpus", "rank", "pattern"]
    rows = base.select(*columns, F.lit(0).alias("later")).unionByName(delta.select(*columns, F.lit(1).alias("later")))
    return rows.groupBy("corpus", "rank").agg(F.max_by("pattern", F.struct("later", "pattern")).alias("pattern"))


def run_program_files(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(path, source, snapshot, ok, code, output) of program files, external patterns taken from a table of snapshots.

    ``snapshots`` is a ``snapshot_table``; the same snapshot may be there many times. A program whose snapshot is not
    in it fails with the code of an unavailable dictionary, a file that cannot be read with the code of a truncated
    one. Files of null content give null in all but the path.
    """
    rows = files.select("path", "content", kernel(lambda content: _needs(content), _NEEDS)("content").alias("n"))
    rows = rows.select("path", "content", "n.source", "n.snapshot", "n.error")
    named = rows.filter("snapshot IS NOT NULL").select(F.col("snapshot").alias("hash")).distinct()
    found = snapshots.filter("hash IS NOT NULL").join(named, "hash", "left_semi").groupBy("hash").agg(F.first("content").alias("published"))  # equal hash, equal content but for domain and version
    copies = found.select(F.col("hash").alias("snapshot"), "published", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("path", "content"), F.lit(SALTS)).cast("int"))
    run = kernel(lambda content, published: _execute(content, published), "struct<ok:boolean,code:int,output:binary>")
    joined = rows.join(copies, ["snapshot", "salt"], "left")
    readable = F.when(F.col("error").isNull(), F.col("content"))
    out = joined.select("path", "source", "snapshot", "content", run(readable, "published").alias("r"))
    failed = F.col("content").isNotNull() & F.col("r").isNull()
    code = F.when(failed, CODES["TRUNCATED"]).otherwise(F.col("r.code"))
    return out.select("path", "source", "snapshot", F.when(failed, False).otherwise(F.col("r.ok")).alias("ok"), code.alias("code"), "r.output")
