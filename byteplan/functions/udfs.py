"""Kernels as Spark functions, batched by Arrow, and their registration for SQL."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

from ..kernels import containers, dictionary, leb, lz, profile, rows, synth, transforms, vm
from ..kernels.errors import FormatError, VmError


def kernel(function: Callable, returns: str):
    """An Arrow UDF of a function of one to three values; a null in the first argument gives null."""
    kind: DataType = _parse_datatype_string(returns)
    arrow = to_arrow_type(kind)

    def one(a: pa.Array) -> pa.Array:
        return pa.array((None if x is None else function(x) for x in a.to_pylist()), arrow)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((None if x is None else function(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())), arrow)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        rows_ = zip(a.to_pylist(), b.to_pylist(), c.to_pylist())
        return pa.array((None if x is None else function(x, y, z) for x, y, z in rows_), arrow)

    needed = function.__code__.co_argcount - len(function.__defaults__ or ())
    wrapped = {1: one, 2: two, 3: three}[needed]
    return arrow_udf(wrapped, returnType=kind)


def batch_kernel(function: Callable, returns: str):
    """An Arrow UDF of a function of a list of values that gives a result for each; nulls give null."""
    kind: DataType = _parse_datatype_string(returns)
    arrow = to_arrow_type(kind)

    def run(a: pa.Array) -> pa.Array:
        values = a.to_pylist()
        found = iter(function([x for x in values if x is not None]))
        return pa.array((None if x is None else next(found) for x in values), arrow)

    return arrow_udf(run, returnType=kind)


def stream_kernel(function: Callable, returns: str):
    """An Arrow UDF of a function of a list of values (or nulls) that gives their results in arrays of bounded size."""
    kind: DataType = _parse_datatype_string(returns)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield from function(a.to_pylist(), arrow)

    return arrow_udf(run, returnType=kind)


_TOKENS = "array<struct<ord:int,kind:string,start:bigint,len:bigint,offset:bigint,data:binary>>"
_METRICS = "struct<literal_fraction:double,avg_match_len:double,line_similarity:double,byte_entropy:double,utf8_valid_ratio:double>"


_LZ_STATISTICS = "struct<n_literals:int,n_matches:int,literal_bytes:bigint,match_bytes:bigint>"
#: Tokens that are handed over together; a blob's tokens stay together.
TOKENS_AT_ONCE = 1 << 16


def lz_tokens(blobs: list[bytes | None], kind: pa.ListType) -> Iterator[pa.ListArray]:
    """The tokens of each blob, whole blobs in arrays of about ``TOKENS_AT_ONCE`` tokens."""
    parses = lz.parse_parts([b for b in blobs if b is not None])
    ends, nulls, parts = [0], [], []
    for k, data in enumerate(blobs):
        count = 0
        for tokens in next(parses) if data is not None else ():
            parts.append(_token_array(data, tokens, count, kind.value_type))
            count += len(tokens)
        ends.append(ends[-1] + count)
        nulls.append(data is None)
        if ends[-1] >= TOKENS_AT_ONCE or k == len(blobs) - 1:
            values = pa.concat_arrays(parts) if parts else pa.array([], kind.value_type)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind, mask=pa.array(nulls))
            ends, nulls, parts = [0], [], []


def _token_array(data: bytes, tokens: np.ndarray, ord: int, kind: pa.StructType) -> pa.StructArray:
    starts, lengths, offsets = tokens.T
    literal = offsets == 0
    ends = np.concatenate(([0], np.cumsum(np.where(literal, lengths, 0)))).astype(np.int32)
    held = b"".join([data[a : a + n] for a, n in tokens[literal, :2].tolist()])
    data_column = pa.Array.from_buffers(pa.binary(), len(tokens), [pa.array(literal).buffers()[1], pa.py_buffer(ends), pa.py_buffer(held)])
    kinds = pa.array(["CPY", "LIT"]).take(pa.array(literal.astype(np.int8)))
    columns = [pa.array(np.arange(ord, ord + len(tokens), dtype=np.int32)), kinds, *(pa.array(np.ascontiguousarray(c)) for c in (starts, lengths, offsets)), data_column]
    return pa.StructArray.from_arrays(columns, fields=list(kind))


def lz_statistics(blobs: list[bytes]) -> Iterator[dict]:
    """Numbers and bytes of the literals and matches of each blob's parse; tokens are counted as they are made."""
    for parts in lz.parse_parts(blobs):
        literals = matches = literal_bytes = match_bytes = 0
        for tokens in parts:
            copied = tokens[:, 2] > 0
            matches += (n := int(copied.sum()))
            literals += len(tokens) - n
            match_bytes += (size := int(tokens[copied, 1].sum()))
            literal_bytes += int(tokens[:, 1].sum()) - size
        yield {"n_literals": literals, "n_matches": matches, "literal_bytes": literal_bytes, "match_bytes": match_bytes}


def program_tokens(program: bytes) -> list[dict]:
    """Disassembly: one row per instruction of the main frame."""
    return [
        {"ord": k, "kind": i.name, "start": i.start, "len": i.end - i.start, "offset": i.numbers[0] if i.numbers else 0, "data": i.data or None}
        for k, i in enumerate(vm.instructions(program))
    ]


def try_run(program: bytes) -> dict:
    try:
        return {"ok": True, "code": 0, "output": vm.run(program)}
    except VmError as e:
        return {"ok": False, "code": e.code, "output": None}


def scan_summary(data: bytes) -> dict | None:
    found = rows.find_rows(data)
    if not found:
        return None
    return {"prefix": found.prefix, "n_rows": found.count, "template": found.template, "params": list(found.params), "suffix": found.suffix}


def json_keys(data: bytes) -> list[str] | None:
    members = rows.json_members(data)
    return None if members is None else [json.loads(k) for k, _, _ in members]


def synthesized(data: bytes, mode: str = "best") -> dict:
    r = synth.compress(data, mode)
    return {
        "data_class": r.data_class, "structure_first": r.structure_first, "lz_ratio": r.lz_ratio, "ratio": r.program.ratio(),
        "program": r.program.code(), "macros": list(r.program.macros.items()), "metrics": r.metrics,
        "size": r.program.size(), "literals": r.program.literals(),
    }


def encoded_entry(data: bytes, patterns: list, force: bool) -> dict:
    """``patterns`` is the dictionary as (key, pattern) pairs, or null."""
    method, payload = containers.encode_entry(data, {p["key"]: p["pattern"] for p in patterns or []}, force_programs=bool(force))
    return {"method": method, "payload": payload}


def decoded_entry(method: str, payload: bytes, patterns: list) -> bytes:
    return containers.decode_entry(method, payload, {p["key"]: p["pattern"] for p in patterns or []})


def _histogram(data: bytes) -> list[int]:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256).tolist()


def codec_sizes(data: bytes) -> dict:
    """Sizes by general codecs, to compare with; null where a library is missing."""
    out = {"zlib_1": len(zlib.compress(data, 1)), "zlib_9": len(zlib.compress(data, 9)), "zstd_1": None, "zstd_19": None}
    try:
        import zstandard
    except ImportError:
        return out
    for level in (1, 19):
        out[f"zstd_{level}"] = len(zstandard.ZstdCompressor(level=level).compress(data))
    return out


def _program_file(data: bytes) -> bytes:
    program = synth.compress(data).program
    return containers.ProgramFile(program.code(), program.macros, deflate=True).encode()


def _delta(data: bytes) -> int:
    return (synth.delta_gain(data) or (0, b""))[0]


def _macro(search: Callable, data: bytes) -> dict | None:
    found = search(data, 0)
    return found and {"gain": found[0], "pattern": found[1]}


def _safe(path: str) -> bool:
    try:
        return containers.safe_path(path) == path
    except FormatError:
        return False


#: SQL name -> (function, result type).
KERNELS: dict[str, tuple[Callable, str]] = {
    "byte_entropy": (lambda data: profile.entropy(data), "double"),
    "byte_histogram": (lambda data: _histogram(data), "array<bigint>"),
    "utf8_valid_ratio": (lambda data: profile.utf8_valid_ratio(data), "double"),
    "line_similarity_bytes": (lambda data: profile.line_similarity(data), "double"),
    "classify_metrics": (lambda m, data: profile.classify(m, data), "string"),
    "delta_entropy_gain": (lambda data: _delta(data), "bigint"),
    "leb_decode": (lambda data: leb.decode(data)[0], "bigint"),
    "apply_transform": (lambda data, t: transforms.apply(t, data), "binary"),
    "compress_smart": (lambda data: lz.compress_smart(data), "binary"),
    "run_program": (lambda program: vm.run(program), "binary"),
    "try_run_program": (lambda program: try_run(program), "struct<ok:boolean,code:int,output:binary>"),
    "validate_program": (lambda program: vm.validate(program), "int"),
    "program_tokens": (lambda program: program_tokens(program), _TOKENS),
    "program_spans": (lambda program: [{"start": a, "end": b, "kind": k} for a, b, k in lz.spans(program)], "array<struct<start:bigint,`end`:bigint,kind:string>>"),
    "find_rows": (lambda data: scan_summary(data), "struct<prefix:binary,n_rows:int,template:binary,params:array<binary>,suffix:binary>"),
    "json_member_keys": (lambda data: json_keys(data), "array<string>"),
    "suffix_order": (lambda data: synth.suffix_array(data).tolist(), "array<bigint>"),
    "synthesize": (lambda data: synthesized(data), f"struct<data_class:string,structure_first:boolean,lz_ratio:double,ratio:double,program:binary,macros:map<int,binary>,metrics:{_METRICS},size:bigint,literals:array<binary>>"),
    "synthesize_lz_first": (lambda data: synthesized(data, "lz"), f"struct<data_class:string,structure_first:boolean,lz_ratio:double,ratio:double,program:binary,macros:map<int,binary>,metrics:{_METRICS},size:bigint,literals:array<binary>>"),
    "run_with_macros": (lambda program, macros: vm.run(program, dict(macros or [])), "binary"),
    "encode_blob": (lambda data: containers.encode_blob(data), "binary"),
    "decode_blob": (lambda data: containers.decode_blob(data), "binary"),
    "encode_program_file": (lambda data: _program_file(data), "binary"),
    "decode_program_file": (lambda data: containers.ProgramFile.decode(data).execute(), "binary"),
    "encode_entry": (lambda data, patterns, force: encoded_entry(data, patterns, force), "struct<method:string,payload:binary>"),
    "decode_entry": (lambda method, payload, patterns: decoded_entry(method, payload, patterns), "binary"),
    "applicability": (lambda data: {k: v for k, v in dictionary.applicability(data).items() if k != "dictionary"}, "struct<total:bigint,cpy_bytes:bigint,lit_bytes:bigint,lz_coverage:double,cpy_count:bigint,avg_cpy_len:double,h_pattern:double,ref_data_coverage:double,predicts:boolean,dictionary_size:bigint>"),
    "best_macro": (lambda data: _macro(synth.best_macro, data), "struct<gain:bigint,pattern:binary>"),
    "best_long_macro": (lambda data: _macro(synth.best_long_macro, data), "struct<gain:bigint,pattern:binary>"),
    "split_fields": (lambda line: rows.split_fields(line, b","), "array<binary>"),
    "mine_patterns": (lambda data: list(dictionary.mine(data).values()), "array<binary>"),
    "codec_sizes": (lambda data: codec_sizes(data), "struct<zlib_1:bigint,zlib_9:bigint,zstd_1:bigint,zstd_19:bigint>"),
    "safe_path": (lambda path: _safe(path), "boolean"),
}


#: The same of functions that take many blobs at once.
BATCH_KERNELS: dict[str, tuple[Callable, str]] = {
    "class_metrics": (lambda blobs: (profile.metrics(d, t) for d, t in zip(blobs, lz.parse_many(blobs))), _METRICS),
    "lz_statistics": (lambda blobs: lz_statistics(blobs), _LZ_STATISTICS),
    "lz_encode": (lambda blobs: (lz.encode(d, t) for d, t in zip(blobs, lz.parse_many(blobs))), "binary"),
    "compress_naive": (lambda blobs: lz.compress_naive_many(blobs), "binary"),
}


#: The same of functions whose results are long.
STREAM_KERNELS: dict[str, tuple[Callable, str]] = {
    "lz_tokens": (lambda blobs, kind: lz_tokens(blobs, kind), _TOKENS),
}


class _Lazy(dict):
    """Kernels made when they are first used; making one needs a running session."""

    def __missing__(self, name: str) -> Callable:
        make, among = next((m, k) for m, k in ((batch_kernel, BATCH_KERNELS), (stream_kernel, STREAM_KERNELS), (kernel, KERNELS)) if name in k)
        made = self[name] = make(*among[name])
        return made


def functions() -> dict[str, Callable]:
    return _Lazy()


def register(spark: SparkSession) -> None:
    """Make every kernel callable from SQL under its name."""
    made = functions()
    for name in (*KERNELS, *BATCH_KERNELS, *STREAM_KERNELS):
        spark.udf.register(name, made[name])
