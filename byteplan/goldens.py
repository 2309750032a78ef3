"""Queries whose results are known beforehand: small inputs by hand, and what they must give, as SQL values."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.udfs import functions, kernel
from .kernels import containers, lz, profile, synth, vm
from .kernels.errors import VmError
from .operators import benefit, mining, profiling
from .schema import BLOBS

_K = functions()


def _values(rows: list[tuple], columns: str) -> str:
    shown = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({columns})"


#: name, program, macros, dictionary (hexadecimal) -> output.
MACHINE = [
    ("literal", "00026869FF", {}, {}, "6869"),
    ("overlapping copy", "00016101" + "0104FF", {}, {}, "6161616161"),
    ("map", "0003010203" + "020003FF", {}, {}, "020304"),
    ("loop", "030304" + "00026162" + "FF", {}, {}, "616261626162"),
    ("counting", "000401000000" + "030206" + "010404" + "020204" + "FF", {}, {}, "010000000200000003000000"),
    ("call", "0407FF", {7: "000178"}, {}, "78"),
    ("nested calls", "04010401FF", {1: "0001610402", 2: "000162"}, {}, "61626162"),
    ("reference", "05016BFF", {}, {"6B": "776F7264"}, "776F7264"),
    ("scan", "07020004" + "01610162" + "FF", {0: "0800010A"}, {}, "610A620A"),
    ("halt ends", "000161FF000162", {}, {}, "61"),
    ("halt in a loop ends one turn", "030205" + "000161FF08" + "FF", {}, {}, "6161"),
]


def machine_outputs(spark, sf_dir):
    """LIT, CPY, MAP, LOOP, CALL, REF, SCAN, NEXT and HALT."""
    known = {n: ({k: bytes.fromhex(v) for k, v in m.items()}, {bytes.fromhex(k): bytes.fromhex(v) for k, v in d.items()}) for n, _, m, d, _ in MACHINE}
    run = kernel(lambda name, program: vm.run(program, *known[name]), "binary")
    rows = spark.createDataFrame([(n, bytes.fromhex(p)) for n, p, *_ in MACHINE], "name string, program binary")
    return rows.select("name", F.hex(run("name", "program")).alias("output"))


#: name, program, macros, output limit -> code.
ERRORS = [
    ("output too long by a copy", "000161010164FF", {}, 10, 0x04),
    ("output too long by a literal", "00026162FF", {}, 1, 0x04),
    ("output as long as allowed", "00026162FF", {}, 2, 0),
    ("calls too deep", "0400FF", {k: f"04{k + 1:02X}" for k in range(100)}, 100, 0x05),
    ("macro calls itself", "0400FF", {0: "0400"}, 100, 0x06),
    ("macros call each other", "0400FF", {0: "0401", 1: "0400"}, 100, 0x06),
    ("too few parameters", "0702000201" + "61FF", {0: "08"}, 100, 0x0C),
    ("parameter cut off", "0701000205" + "61FF", {0: "08"}, 100, 0xFF),
]


def machine_limits(spark, sf_dir):
    """Limits, cycles and parameters: the codes that need macros or a limit."""
    known = {n: ({k: bytes.fromhex(v) for k, v in m.items()}, limit) for n, _, m, limit, _ in ERRORS}

    def code(name: str, program: bytes) -> int:
        try:
            vm.run(program, known[name][0], max_output=known[name][1])
            return 0
        except VmError as e:
            return e.code

    rows = spark.createDataFrame([(n, bytes.fromhex(p)) for n, p, *_ in ERRORS], "name string, program binary")
    return rows.select("name", kernel(lambda name, program: code(name, program), "int")("name", "program").alias("code"))


#: data -> tokens of the near and of the far parse (start:length, and +offset back for copies).
PARSES = [
    ("", "", ""),
    ("abc", "0:3", "0:3"),
    ("abcdabcd", "0:4 4:4+4", "0:4 4:4+4"),
    ("aaaaaaaaaa", "0:1 1:9+1", "0:1 1:9+1"),
    ("abcd1abcd2abcd", "0:5 5:4+5 9:1 10:4+5", "0:5 5:4+5 9:1 10:4+10"),
    ("abcdeXabcdYabcde", "0:6 6:4+6 10:1 11:5+11", "0:6 6:4+6 10:1 11:5+11"),
    ("abcabcabcabc", "0:3 3:9+3", "0:3 3:9+3"),
    ("x" * 600, "0:1 1:258+1 259:258+1 517:83+1", "0:1 1:258+1 259:258+259 517:83+517"),
    ("wxyz" + "." * 3 + "wxyz", "0:7 7:4+7", "0:7 7:4+7"),
]


def lz_ties(spark, sf_dir):
    """Which of equally long matches either parse takes, greed and the longest match."""
    show = lambda tokens: " ".join(f"{t.start}:{t.length}" + f"+{t.offset}" * bool(t.offset) for t in tokens)
    near, far = kernel(lambda data: show(lz.parse(data)), "string"), kernel(lambda data: show(lz.parse_far(data)), "string")
    rows = spark.createDataFrame([(d,) for d, *_ in PARSES], "data string").withColumn("b", F.col("data").cast("binary"))
    return rows.select("data", near("b").alias("near"), far("b").alias("far"))


#: data -> program by far parse, program with runs as loops (hexadecimal).
PROGRAMS = [
    ("6162636461626364", "000461626364010404FF", "000461626364010404FF"),
    ("61616161616161616161", "000161010109FF", "00016103090301" + "0101FF"),
    ("78796161616161" + "7A", "0003787961010104" + "00017AFF", "00027879" + "000161030403010101" + "00017AFF"),
    ("010000000200000003000000", "000C010000000200000003000000FF", "000401000000030206010404020204FF"),
]


def programs_by_hand(spark, sf_dir):
    """The bytes, and so the sizes, of whole programs."""
    rows = spark.createDataFrame([(d, bytes.fromhex(d)) for d, *_ in PROGRAMS], "data string, b binary")
    return rows.select("data", F.hex(_K["compress_naive"]("b")).alias("naive"), F.hex(_K["compress_smart"]("b")).alias("smart"))


#: data -> suffix array, common prefixes of neighbours.
SUFFIXES = [("banana", "5,3,1,0,4,2", "0,1,3,0,0,2"), ("aaaa", "3,2,1,0", "0,1,2,3"), ("abcab", "3,0,4,1,2", "0,2,0,1,0"), ("z", "0", "0")]


def suffix_prefixes(spark, sf_dir):
    """Suffix arrays and their longest common prefixes."""
    order = lambda data: ",".join(map(str, synth.suffix_array(data).tolist()))
    shared = lambda data: ",".join(map(str, synth.common_prefixes(data, synth.suffix_array(data)).tolist()))
    rows = spark.createDataFrame([(d,) for d, *_ in SUFFIXES], "data string").withColumn("b", F.col("data").cast("binary"))
    return rows.select("data", kernel(lambda data: order(data), "string")("b").alias("suffixes"), kernel(lambda data: shared(data), "string")("b").alias("prefixes"))


def transform_delta_u32(spark, sf_dir):
    """DELTA_U32 over two words: the second becomes the sum."""
    little = lambda c: F.concat(*[F.substring(F.lpad(F.hex(c), 8, "0"), 7 - 2 * k, 2) for k in range(4)])
    words = F.unhex(F.concat(little("p_partkey"), little("p_size")))
    out = F.hex(_K["apply_transform"](words, F.lit(5)))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", *[F.concat(*[F.substring(out, 8 * w + 7 - 2 * k, 2) for k in range(4)]).alias(f"word{w}") for w in (0, 1)])


_LOG = "2024-01-01T00:00:00Z INFO  server: request processed ok\n"
#: name, data, class.
CLASSES = [
    ("identical log lines", (_LOG * 200).encode(), "StructuredLog"),
    ("all bytes in turn", bytes(range(256)) * 8, "Binary"),
    ("jpeg", bytes.fromhex("FFD8FFE0") + b"AB" * 200, "AlreadyCompressed"),
    ("json object", b'{"id":1,"name":"x"}\n', "JsonArray"),
    ("json array", b' [{"id":1}]', "JsonArray"),
    ("one sentence", b"The quick brown fox jumps over the lazy dog.", "UnstructuredText"),
    ("nothing", b"", "UnstructuredText"),
]


def classes_by_hand(spark, sf_dir):
    """The class of blobs that each rule is made for."""
    rows = spark.createDataFrame([(n, d) for n, d, _ in CLASSES], "name string, content binary")
    rows = rows.withColumn("m", _K["class_metrics"]("content"))
    return rows.select("name", _K["classify_metrics"]("m", "content").alias("data_class"))


#: name, data, method, compressed size (-1: the codec's own).
METHODS = [
    ("jpeg", bytes.fromhex("FFD8FFE0") + b"AB" * 200, "store", 404),
    ("all bytes", bytes(range(256)), "store", 256),
    ("nothing", b"", "store", 0),
    ("too short to pay", b"aaaaa", "store", 5),
    ("small and repetitive", b"abc " * 50, "zlib", -1),
]


def archive_methods(spark, sf_dir):
    """How an entry is kept, and what stored ones take."""
    method = kernel(lambda data: containers.encode_entry(data)[0], "string")
    size = kernel(lambda data: (lambda m, p: len(p) if m == "store" else -1)(*containers.encode_entry(data)), "bigint")
    rows = spark.createDataFrame([(n, d) for n, d, *_ in METHODS], "name string, content binary")
    return rows.select("name", method("content").alias("method"), size("content").alias("stored_size"))


#: data (hexadecimal), share of valid units as a fraction.
UTF8 = [("", "1.0"), ("6162", "1.0"), ("C3A9", "1.0"), ("C3", "0.0"), ("61C3", "0.5"), ("80808061", "0.25"), ("E697A5FF", "0.5"), ("F09F9880", "1.0"), ("C080", "0.0")]


def utf8_units(spark, sf_dir):
    """Valid, cut off and stray bytes."""
    ratio = kernel(lambda data: profile.utf8_valid_ratio(data), "double")
    rows = spark.createDataFrame([(d, bytes.fromhex(d)) for d, _ in UTF8], "data string, b binary")
    return rows.select("data", ratio("b").alias("ratio"))


_LONG = "".join(map(chr, range(48, 122))) + "......"
#: data, gain and pattern of the best macro of 8 to 64 bytes, of 65 to 1024 bytes (gain 0: none).
MACROS = [
    ("abcdefghij1abcdefghij2abcdefghij", 14, "abcdefghij", 0, ""),
    ("abcdefgh1abcdefgh2", 2, "abcdefgh", 0, ""),
    ("no macro in this", 0, "", 0, ""),
    ("!".join(f"{k}{_LONG}" for k in "()*+"), 186, _LONG[:64], 234, _LONG),
]


def macros_by_hand(spark, sf_dir):
    """Short macros save the pattern at all uses but one, less six bytes; long ones by the costs of their instructions."""
    rows = spark.createDataFrame([(d,) for d, *_ in MACROS], "data string").withColumn("b", F.col("data").cast("binary"))
    show = [("short", _K["best_macro"]("b")), ("long", _K["best_long_macro"]("b"))]
    columns = [c for name, m in show for c in (F.coalesce(m["gain"], F.lit(0)).cast("int").alias(f"{name}_gain"), F.coalesce(m["pattern"].cast("string"), F.lit("")).alias(f"{name}_pattern"))]
    return rows.select("data", *columns)


#: data, patterns of a dictionary mined from it, best first.
DICTIONARIES = [
    ("abcdefabcdef", "abcdef"),
    ("abcdefgabcdefg", "abcdefg"),
    ("xxxxxxxx", "xxxxxx xxxxxxx"),
    ("abcdeabcde", ""),
    ("abcdef-ABCDEFG-abcdef-ABCDEFG", "abcdef-ABCDEFG"),
]


def dictionaries_by_hand(spark, sf_dir):
    """Scores, ties and patterns inside better ones."""
    rows = spark.createDataFrame([(d,) for d, _ in DICTIONARIES], "data string")
    patterns = F.transform(_K["mine_patterns"](F.col("data").cast("binary")), lambda p: p.cast("string"))
    return rows.select("data", F.array_join(patterns, " ").alias("patterns"))


#: data, tokens of the near parse summed: literals, matches, bytes of either, literal share, mean match.
STATISTICS = [("", 0, 0, 0, 0, "1.0", "0.0"), ("abc", 1, 0, 3, 0, "1.0", "0.0"), ("abcdabcd", 1, 1, 4, 4, "0.5", "4.0"), ("aaaaaaaaaa", 1, 1, 1, 9, "0.1", "9.0"), ("abcd1abcd2abcd", 2, 2, 6, 8, "0.428571", "4.0")]


def statistics_by_hand(spark, sf_dir):
    """What a parse covers."""
    rows = spark.createDataFrame([("all", d, d.encode(), len(d)) for d, *_ in STATISTICS], BLOBS)
    out = profiling.lz_statistics(rows)
    return out.select(F.col("path").alias("data"), "n_literals", "n_matches", "literal_bytes", "match_bytes", F.round("literal_fraction", 6).alias("literal_fraction"), F.round("avg_match_len", 6).alias("avg_match_len"))


#: data, bytes, bytes copied, literal bytes, share copied, copies, their mean length, entropy of the dictionary, its coverage, verdict, patterns.
APPLICABLE = [
    ("abcdefabcdef", 12, 6, 6, "0.5", 1, "6.0", "2.584963", "1.0", True, 1),
    ("abc", 3, 0, 3, "0.0", 0, "0.0", "0.0", "0.0", False, 0),
    ("aaaaaaaaaa", 10, 9, 1, "0.9", 1, "9.0", "0.0", "0.9", False, 3),
]


def applicability_by_hand(spark, sf_dir):
    """Both conditions of the prediction, and which fails."""
    rows = spark.createDataFrame([(d,) for d, *_ in APPLICABLE], "data string").withColumn("r", _K["applicability"](F.col("data").cast("binary")))
    names = "total, cpy_bytes, lit_bytes, lz_coverage, cpy_count, avg_cpy_len, h_pattern, ref_data_coverage, predicts, dictionary_size".split(", ")
    return rows.select("data", "r.*").select("data", *[F.round(n, 6).alias(n) if n in ("lz_coverage", "avg_cpy_len", "h_pattern", "ref_data_coverage") else n for n in names])


#: path, data. All hold one phrase twice or more; the dashes repeat in one only.
SHARED = [("a", "abcdefghabcdefgh!"), ("b", "abcdefgh?abcdefgh"), ("c", "abcdefgh--------abcdefgh"), ("d", "none of it")]


def _shared(spark):
    return spark.createDataFrame([("all", p, d.encode(), len(d)) for p, d in SHARED], BLOBS)


def cross_file_by_hand(spark, sf_dir):
    """The dictionary of each threshold of files and what it covers on average."""
    blobs = _shared(spark)
    out = benefit.sweep_coverage(blobs, mining.cross_file_candidates(mining.file_patterns(blobs)), (1, 2, 3, 4))
    return out.select("min_files", "n_patterns", F.round("avg_len", 6).alias("avg_len"), F.round("h_pattern", 6).alias("h_pattern"), F.round("mean_coverage", 6).alias("mean_coverage"))


def held_out_by_hand(spark, sf_dir):
    """Every blob against the others' dictionary; the one without the phrase is not covered."""
    out = mining.leave_one_out(_shared(spark))
    return out.select("path", "n_patterns", F.round("h_pattern", 6).alias("h_pattern"), F.round("coverage", 6).alias("coverage"), "predicts_benefit")


#: query -> SQL.
GOLDENS = {
    machine_outputs: _values([(n, out) for n, _, _, _, out in MACHINE], "name, output"),
    machine_limits: _values([(n, code) for n, _, _, _, code in ERRORS], "name, code"),
    lz_ties: _values(PARSES, "data, near, far"),
    programs_by_hand: _values(PROGRAMS, "data, naive, smart"),
    suffix_prefixes: _values(SUFFIXES, "data, suffixes, prefixes"),
    transform_delta_u32: "SELECT p_partkey, printf('%08X', p_partkey) AS word0, printf('%08X', (p_partkey + p_size) % 4294967296) AS word1 FROM part",
    classes_by_hand: _values([(n, c) for n, _, c in CLASSES], "name, data_class"),
    archive_methods: _values([(n, m, s) for n, _, m, s in METHODS], "name, method, stored_size"),
    macros_by_hand: _values(MACROS, "data, short_gain, short_pattern, long_gain, long_pattern"),
    dictionaries_by_hand: _values(DICTIONARIES, "data, patterns"),
    statistics_by_hand: "SELECT * REPLACE (literal_fraction::DOUBLE AS literal_fraction, avg_match_len::DOUBLE AS avg_match_len, literal_bytes::BIGINT AS literal_bytes, match_bytes::BIGINT AS match_bytes) FROM "
    f"({_values(STATISTICS, 'data, n_literals, n_matches, literal_bytes, match_bytes, literal_fraction, avg_match_len')})",
    applicability_by_hand: "SELECT * REPLACE (lz_coverage::DOUBLE AS lz_coverage, avg_cpy_len::DOUBLE AS avg_cpy_len, h_pattern::DOUBLE AS h_pattern, ref_data_coverage::DOUBLE AS ref_data_coverage) FROM "
    f"({_values(APPLICABLE, 'data, total, cpy_bytes, lit_bytes, lz_coverage, cpy_count, avg_cpy_len, h_pattern, ref_data_coverage, predicts, dictionary_size')})",
    cross_file_by_hand: "SELECT t AS min_files, 1 AS n_patterns, 8.0::DOUBLE AS avg_len, 3.0::DOUBLE AS h_pattern, round((16 / 17 + 16 / 17 + 16 / 24) / 4, 6) AS mean_coverage FROM (VALUES (1), (2), (3)) v(t)",
    held_out_by_hand: "SELECT path, 1 AS n_patterns, 3.0::DOUBLE AS h_pattern, round(c, 6) AS coverage, c > 0 AS predicts_benefit FROM (VALUES ('a', 16 / 17), ('b', 16 / 17), ('c', 16 / 24), ('d', 0)) v(path, c)",
    utf8_units: f"SELECT data, ratio::DOUBLE AS ratio FROM ({_values(UTF8, 'data, ratio')})",
}
