import os
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from byteplan.kernels import containers, dictionary, leb, lz, profile, rows, synth, transforms, vm
from byteplan.kernels.errors import FormatError, VmError

B = vm.ProgramBuilder

CSV = b"".join(b"%d,fixed_category,fixed_region,%d\n" % (i, i + 100) for i in range(30))
TSV = b"".join(b"%d\tfixed_region\tfixed_tier\t%d\n" % (i, i + 100) for i in range(30))
PIPE = b"".join(b"%d|fixed_category|fixed_datacenter|%d\n" % (i, i + 100) for i in range(30))
QUOTED = b"".join(b'"Smith %d, John",fixed_category,%d\n' % (i, i + 100) for i in range(30))
NDJSON = b"".join(b'{"id":%d,"status":"active","region":"us-east"}\n' % i for i in range(30))
ARRAY = b"[" + b",\n".join(b'{"id":%d,"s":"a"}' % i for i in range(40)) + b"]"
LOG = b"2024-01-01T00:00:00Z INFO  server: request processed ok\n" * 200
EDGES = [b"", b"a", b"abcdefg", bytes(64), bytes(range(256)), b"\xff\xfe\xc3(", CSV[:-1], NDJSON.replace(b"\n", b"\r\n"), ARRAY, b'"open', b"x" * 32, b"x" * 33, LOG]


@given(st.integers(0, 2**32 - 1), st.binary(max_size=4))
def test_leb_round_trip(n, rest):
    code = leb.encode(n)
    assert leb.decode(code + rest) == (n, len(code)) and leb.size(n) == len(code)


@pytest.mark.parametrize("bad", [b"", b"\x80", b"\x80\x80\x80\x80\x80\x01"])
def test_leb_cut_off(bad):
    with pytest.raises(VmError) as e:
        leb.decode(bad)
    assert e.value.code == 0xFF


def test_machine_runs_each_instruction():
    assert vm.run(B().lit(b"abc").cpy(3, 7).halt().lit(b"no").build()) == b"abcabcabca"
    assert vm.run(B().lit(b"ab").loop(3, B().cpy(2, 2)).build()) == b"abababab"
    assert vm.run(B().loop(0, B().lit(b"x")).lit(b"y").build()) == b"y"
    assert vm.run(B().loop(2, B().loop(2, B().lit(b"x")).lit(b"|")).build()) == b"xx|xx|"
    assert vm.run(B().loop(3, B().lit(b"x").halt().lit(b"y")).build()) == b"xxx"
    assert vm.run(B().lit(b"\x01\x02").map("INC_U8", 2).map("DELTA_U8", 2).build()) == b"\x02\x05"
    assert vm.run(B().elit(b"hello" * 20).build()) == b"hello" * 20
    assert vm.run(B().ref(b"k").build(), dictionary={b"k": b"pattern"}) == b"pattern"
    p = B().add_macro(1, B().lit(b"k=").next().lit(b"\n")).scan(2, 1, [b"1", b"22"]).call(2).add_macro(2, B().lit(b"end"))
    assert vm.run(p.build(), p.macros) == b"k=1\nk=22\nend"


def _chain(n):
    p = B().call(0)
    for k in range(n):
        p.add_macro(k, B().call(k + 1) if k + 1 < n else B().lit(b"x"))
    return p


@pytest.mark.parametrize(
    ("program", "macros", "name"),
    [
        (b"\xab", {}, "UNKNOWN_OPCODE"),
        (B().cpy(1, 1).build(), {}, "CPY_UNDERFLOW"),
        (B().lit(b"a").cpy(0, 1).build(), {}, "CPY_UNDERFLOW"),
        (B().map("INC_U8", 1).build(), {}, "CPY_UNDERFLOW"),
        (bytes([3, 2, 9]), {}, "LOOP_OVERRUN"),
        (B().call(1).build(), {1: B().call(1).build()}, "CALL_CYCLE"),
        (B().call(9).build(), {}, "UNKNOWN_REF"),
        (B().ref(b"zz").build(), {}, "UNKNOWN_REF"),
        (bytes([2, 9, 0]), {}, "UNKNOWN_TRANSFORM"),
        (B().lit(b"abc").map("INC_U32", 3).build(), {}, "UNKNOWN_TRANSFORM"),
        (B().next().build(), {}, "NEXT_OUTSIDE_SCAN"),
        (B().scan(2, 0, [b"a"]).build(), {0: B().next().build()}, "PARAMS_EXHAUSTED"),
        (bytes([0, 3, 1]), {}, "TRUNCATED"),
        (bytes([6, 2, 9, 0, 0]), {}, "TRUNCATED"),
    ],
)
def test_machine_errors(program, macros, name):
    with pytest.raises(VmError) as e:
        vm.run(program, macros)
    assert e.value.name == name


def test_depth_and_output_limits():
    assert vm.run(_chain(16).build(), _chain(16).macros) == b"x"
    with pytest.raises(VmError, match="CALL_DEPTH"):
        vm.run(_chain(17).build(), _chain(17).macros)
    with pytest.raises(VmError, match="OUTPUT_OVERFLOW"):
        vm.run(B().lit(b"ab").cpy(1, 100).build(), max_output=50)
    with pytest.raises(VmError, match="TRUNCATED"):
        vm.run(B().lit(b"ab").build(), strict_halt=True)
    assert vm.validate(_chain(16).build(), _chain(16).macros) == 0 and vm.validate(B().call(1).build(), {1: B().call(1).build()}) == 6


@pytest.mark.parametrize(
    ("name", "data", "out"),
    [
        ("INC_U8", b"\xff\x00", b"\x00\x01"), ("DEC_U8", b"\x00\x01", b"\xff\x00"), ("INC_U32", b"\xff\xff\xff\xff", bytes(4)),
        ("DEC_U32", bytes(4), b"\xff" * 4), ("DELTA_U8", b"\x01\x01\xff", b"\x01\x02\x01"), ("DELTA_U32", b"\1\0\0\0\2\0\0\0", b"\1\0\0\0\3\0\0\0"),
        ("BYTESWAP_U32", b"\1\2\3\4", b"\4\3\2\1"), ("ZIGZAG_U32", b"\3\0\0\0", b"\xfe\xff\xff\xff"),
    ],
)
def test_transforms(name, data, out):
    assert transforms.apply(transforms.IDS[name], data) == out


@given(st.binary(max_size=400))
def test_delta_is_undone(data):
    assert transforms.apply(4, transforms.delta(data)) == data


def _exhaustive(data, least, window):
    out, at, literal = [], 0, 0
    while at < len(data):
        best = far = 0
        for j in range(max(0, at - window), at):
            k = 0
            while at + k < len(data) and data[j + k] == data[at + k] and k < 258:
                k += 1
            if k > best:
                best, far = k, at - j
        if best >= least:
            if literal < at:
                out.append((literal, at - literal, 0))
            out.append((at, best, far))
            at += best
            literal = at
        else:
            at += 1
    return out + [(literal, len(data) - literal, 0)] * (literal < len(data))


@given(st.binary(max_size=90).map(lambda b: bytes(x % 3 for x in b)))
@settings(deadline=None)
def test_far_parse_is_exhaustive(data):
    assert [(t.start, t.length, t.offset) for t in lz.parse_far(data, 4, 40)] == _exhaustive(data, 4, 40)


@pytest.mark.parametrize("data", [*EDGES, CSV, b"abc" * 50, b"".join(i.to_bytes(4, "little") for i in range(90)), bytes(random.Random(42).randbytes(10_000))])
def test_programs_give_the_data_back(data):
    assert vm.run(lz.encode(data, lz.parse(data))) == data
    assert vm.run(lz.compress_naive(data), strict_halt=True) == data
    assert vm.run(lz.compress_smart(data), strict_halt=True) == data
    assert synth.compress(data).program.output() == data
    assert synth.compress(data, mode="lz").program.output() == data
    assert containers.decode_blob(containers.encode_blob(data)) == data
    assert sum(n for n, _ in lz.coverage(lz.compress_naive(data))) == len(data)
    spans = lz.spans(lz.compress_naive(data))
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


@given(st.binary(max_size=300) | st.text("ab,\n\"{}:1", max_size=300).map(str.encode))
@settings(deadline=None, max_examples=60)
def test_synthesis_never_loses(data):
    found = synth.compress(data)
    assert found.program.output() == data
    for d in (b",", b"\t", b"|"):
        scan = rows.find_delimited(data, d)
        if scan:
            assert scan.prefix + vm.run(scan.code(0), {0: scan.template}) + scan.suffix == data


def test_lz_prefers_the_nearest_and_limits():
    data = b"abcd" + b"x" + b"abcd" + b"y" + b"abcd"
    assert [(t.start, t.length, t.offset) for t in lz.parse(data)] == [(0, 5, 0), (5, 4, 5), (9, 1, 0), (10, 4, 5)]
    assert [(t.length, t.offset) for t in lz.parse_far(data)][-1] == (4, 10)
    assert max(t.length for t in lz.parse(b"a" * 1000)) == 258


@pytest.mark.parametrize("data", [CSV, TSV, PIPE, QUOTED, NDJSON, CSV[:-1], ARRAY, NDJSON.replace(b"\n", b"\r\n"), b"head\n" + CSV + b"tail"])
def test_row_templates_fire_and_reproduce(data):
    scan = rows.find_rows(data)
    assert scan and scan.prefix + vm.run(scan.code(0), {0: scan.template}) + scan.suffix == data


@pytest.mark.parametrize("data", [b"a,b,c\n" * 20, b'{"status":"ok","region":"us-east"}\n' * 30, b"one\ntwo\nsix\n" * 5, CSV[:150]])
def test_row_templates_do_not_fire(data):
    assert rows.find_rows(data) is None


def test_quotes_and_json():
    line = b'"a, ""b""",c,"d'
    assert rows.count_delimiters(line, b",") == 2 and rows.split_fields(line, b",") == [b'"a, ""b"""', b"c", b'"d']
    assert [k for k, _, _ in rows.json_members(b' {"a": [1, {"b": "}"}], "c":null , "d" : "\\"" }')] == [b'"a"', b'"c"', b'"d"']
    assert rows.json_members(b"{}") is None and rows.json_members(b'{"a" 1}') is None
    assert rows.json_object(b'[{"a":1},\n') == b'{"a":1}' and rows.json_object(b"[1]") is None


def test_detectors_and_gains():
    assert synth.find_period(b"[INFO] " * 20) == (7, 20) and synth.find_period(b"abcd" * 2) is None and synth.find_period(b"aaa" * 3) is None
    assert synth.suffix_array(b"banana").tolist() == [5, 3, 1, 0, 4, 2]
    assert synth.common_prefixes(b"banana", synth.suffix_array(b"banana")).tolist() == [0, 1, 3, 0, 0, 2]
    assert synth.delta_gain(bytes(range(128)))[0] > 0 and synth.delta_gain(b"short") is None
    assert synth.loop_gain(140, 7, 20) == 143 - 12 and synth.macro_gain(20, 5, 0) == 5 * (22 - 2) - 4 - 22
    gain, pattern = synth.best_macro(b"".join(b"SERVER_LOG_ENTRY:%c\n" % (65 + i) for i in range(20)), 0)
    assert b"SERVER_LOG_ENTRY:" in pattern and gain > 0
    block = bytes(random.Random(1).randbytes(120))
    gain, pattern = synth.best_long_macro(b"".join(block + bytes([i]) * 3 for i in range(4)), 0)
    assert pattern == block


@given(st.binary(max_size=200).map(lambda b: bytes(x % 2 for x in b)))
@settings(deadline=None, max_examples=50)
def test_repeated_substrings_are_all_found(data):
    for length, found in synth.repeated_substrings(data, 8, 12):
        counts = {}
        for i in range(len(data) - length + 1):
            counts.setdefault(data[i : i + length], []).append(i)
        assert sorted(found) == sorted((len(v), v[0]) for v in counts.values() if len(v) > 1)
    for n in (8, 65):
        grams = [data[i : i + n] for i in range(len(data) - n + 1)]
        assert synth.repeats(data, n) == (len(set(grams)) < len(grams))


def test_classes():
    kind = lambda d: synth.compress(d).data_class
    assert kind(LOG) == "StructuredLog" and kind(NDJSON) == "JsonArray" and kind(b"\xff\xd8\xff\xe0" + b"\xab" * 200) == "AlreadyCompressed"
    assert kind(bytes(random.Random(2).randbytes(4000))) == "Binary"
    assert kind("汉字测试文本。".encode() * 50) != "Binary"
    prose = b"the quick brown fox jumps over the lazy dog\npack my box with five dozen jugs\nhow vexingly quick daft zebras jump\nsphinx of black quartz judge my vow\n"
    assert profile.line_similarity(prose) < 0.5 and kind(prose) == "UnstructuredText"
    assert profile.classify(profile.metrics(NDJSON)) != "JsonArray"
    assert profile.utf8_valid_ratio(b"\xff\xfe") == 0 and profile.utf8_valid_ratio("é".encode()) == 1
    assert profile.entropy(bytes(range(256))) == 8 and profile.entropy(b"") == 0


@pytest.mark.parametrize("magic", ["FFD8FFE0", "89504E470D0A1A0A", "504B0304", "1F8B", "000000186674797069736F6D"])
def test_magic(magic):
    assert profile.is_compressed(bytes.fromhex(magic)) and not profile.is_compressed(b"plain text")


def test_dictionaries():
    data = CSV[:800]
    found = dictionary.mine(data)
    assert found and all(p in data for p in found.values())
    assert dictionary.decompress_with_references(dictionary.compress_with_references(CSV, found), found) == CSV
    assert dictionary.mine_strided([bytes(64)] * 3) == {}
    assert dictionary.mine_strided([os.urandom(16) * 32] * 2)
    assert dictionary.net_gain({b"\0": bytes(8)}, 3) < 0 < 1024 <= dictionary.net_gain({b"\0": bytes(64)}, 40)
    assert dictionary.short_key(254) == b"\xfe" and dictionary.short_key(256) == b"\xff\x01"
    assert dictionary.find_matches(b"xabcabx", {0: b"ab", 1: b"abc"}) == [(1, 4, 1), (4, 6, 0)]
    assert not dictionary.predict_benefit(CSV, {})["predicts_benefit"]
    counts = dictionary.substring_counts(b"abcabcabcabc", 6, 8)
    assert counts[b"abcabc"] == 3 and counts[b"bcabcabc"] == 2 and b"abcabcab" in counts


def test_references_in_programs():
    program = synth.Program([synth.Piece(b"xxHELLO WORLDyyHELLO WORLDzz")], 28)
    synth.apply_dictionary(program, {b"\0": b"HELLO WORLD", b"\1": b"unused pattern", b"\2": b"ab"})
    assert program.output() == b"xxHELLO WORLDyyHELLO WORLDzz" and program.dictionary == {b"\0": b"HELLO WORLD"} and program.size() < 28


@pytest.mark.parametrize("deep", [False, True])
def test_archives(deep):
    blobs = [CSV * 10, b"", b"hello " * 20, b"\xff\xd8\xff\xe0" + b"\xab" * 200, CSV * 80]
    shared = dictionary.mine_strided([CSV, CSV, CSV[10:]]) if deep else None
    entries = [(f"d/{i}", *(lambda m, p, n=len(b): (m, n, p))(*containers.encode_entry(b, shared))) for i, b in enumerate(blobs)]
    data = containers.write_archive(entries, shared)
    assert [b for _, b in containers.read_archive(data)] == blobs
    index, found = containers.read_index(data)
    assert [e.method for e in index][1:4] == ["store", "zlib", "store"] and index[4].method == "program" and found == (shared or {})
    for bad, name in [(data[:-1], "TOO_SHORT"), (b"XXXX" + data[4:], "BAD_MAGIC"), (data + b"x", "COUNT_MISMATCH"), (data[:4] + b"\x09" + data[5:], "BAD_VERSION")]:
        with pytest.raises(FormatError) as e:
            containers.read_index(bad)
        assert e.value.name == name


def test_snapshots_and_program_files():
    snapshot = containers.Snapshot(dictionary.mine(CSV[:600]), "logs", (2, 1))
    code = snapshot.encode()
    assert containers.Snapshot.decode(code) == snapshot
    with pytest.raises(FormatError, match="HASH_MISMATCH"):
        containers.Snapshot.decode(code[:-1] + bytes([code[-1] ^ 1]))
    assert snapshot.merged({99: b"new"}).hash != snapshot.hash
    program = dictionary.compress_with_references(CSV, snapshot.patterns)
    external = containers.ProgramFile.decode(containers.ProgramFile(program, snapshot=snapshot.hash, urls=["x:y"], deflate=True).encode())
    assert external.source == "EXTERNAL" and external.execute(snapshot) == CSV
    with pytest.raises(VmError, match="DICTIONARY_UNAVAILABLE"):
        external.execute()
    with pytest.raises(VmError, match="HASH_MISMATCH"):
        external.execute(containers.Snapshot({0: b"other"}))
    hybrid = containers.ProgramFile(B().ref(leb.encode(0)).build(), dictionary={leb.encode(0): b"inline"}, snapshot=snapshot.hash)
    assert hybrid.source == "HYBRID" and hybrid.execute(snapshot) == b"inline" and hybrid.execute(snapshot, external_wins=True) == snapshot.patterns[0]


@pytest.mark.parametrize(("data", "name"), [(b"x", "TOO_SHORT"), (b"XXXX" + bytes(20), "BAD_MAGIC"), (b"MCAS\x07" + bytes(20), "BAD_VERSION"), (b"MCAS\x01\0\0\0\0\0junk", "BAD_PAYLOAD"), (b"MCAS\x01\0\x09\0\0\0" + zlib.compress(b"abcd"), "LENGTH_MISMATCH")])
def test_bad_blobs(data, name):
    with pytest.raises(FormatError) as e:
        containers.BlobFile.decode(data)
    assert e.value.name == name


@pytest.mark.parametrize("path", ["/etc/x", "../x", "a/../../x", "c:/x", "", "\\x"])
def test_unsafe_paths(path):
    with pytest.raises(FormatError):
        containers.safe_path(path)


def near_by_trying(data):
    """The near parse by walking back from each position: the nearest of the longest among 64 with the same hash."""
    key = lambda i: (int.from_bytes(data[i : i + 4], "little") * lz.MULTIPLIER % 2**32) >> 16
    out, at, literal = [], 0, 0
    while at + 4 <= len(data):
        tried, best, source = 0, 3, -1
        for c in range(at - 1, max(0, at - lz.WINDOW) - 1, -1):
            if tried == lz.MAX_TRIES:
                break
            if key(c) == key(at):
                tried += 1
                n = 0
                while at + n < len(data) and n < 258 and data[c + n] == data[at + n]:
                    n += 1
                if n > best:
                    best, source = n, c
        if source < 0:
            at += 1
            continue
        out += [lz.Token(literal, at - literal)] * (literal < at) + [lz.Token(at, best, at - source)]
        at += best
        literal = at
    return out + [lz.Token(literal, len(data) - literal)] * (literal < len(data))


def far_by_trying(data, shortest, window):
    out, at, literal = [], 0, 0
    while at < len(data):
        best, source = shortest - 1, -1
        for c in range(max(0, at - window), at):
            n = 0
            while at + n < len(data) and n < 258 and data[c + n] == data[at + n]:
                n += 1
            if n > best:
                best, source = n, c
        if source < 0:
            at += 1
            continue
        out += [lz.Token(literal, at - literal)] * (literal < at) + [lz.Token(at, best, at - source)]
        at += best
        literal = at
    return out + [lz.Token(literal, len(data) - literal)] * (literal < len(data))


def test_parses_against_every_candidate():
    rng = random.Random(21)
    base = bytes(rng.choice(b"abcdef") for _ in range(120))
    blobs = [b"", b"a", b"abc", b"a" * 700, b"abcab" * 30, bytes(range(256)) * 2] + [
        b"".join(base[a : a + rng.randint(1, 40)] + bytes([rng.randrange(97, 103)]) for a in (rng.randrange(110) for _ in range(rng.randint(1, 25)))) for _ in range(25)
    ]
    near, far = [near_by_trying(b) for b in blobs], [far_by_trying(b, 4, 90) for b in blobs]
    assert [lz.parse(b) for b in blobs] == near and [lz.parse_far(b, 4, 90) for b in blobs] == far
    assert [lz.parse_far(b, 3, 4096) for b in blobs] == [far_by_trying(b, 3, 4096) for b in blobs]
    assert [lz.parse_far(b, 10, 4096) for b in blobs] == [far_by_trying(b, 10, 4096) for b in blobs]
    for together in (1, 500, 1 << 19):  # blobs searched together do not see each other
        before, lz.TOGETHER = lz.TOGETHER, together
        assert list(lz.parse_many(blobs)) == near and list(lz.parse_far_many(blobs, 4, 90)) == far
        lz.TOGETHER = before


def test_outermost_patterns():
    found = dictionary.Outermost(2)
    assert [found.offer(p) for p in (b"abcdef", b"bcd", b"xyz", b"more")] == [True, True, False, False] and found.kept == [b"abcdef", b"xyz"]
