"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole and encoded once; the tokens' character offsets are then
intersected with the sorted spans of the assistant's texts by binary search. The template's control
strings are special tokens, so no token reaches over a turn's edge. Inside texts a control string gets a
``!`` after its first character (and one that already has some gets one more), which is undone when
the text is read back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, shuffle_partitions

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of the largest vocabulary file that is sent with the tasks.
MOST_VOCABULARY = 1 << 26
#: The template: BOS before a conversation, then for each turn the role between ROLE marks, the text, EOS.
BOS, EOS, ROLE, TEXT = "<s>", "</s>", "[INST]", "[/INST]"
#: A conversation longer than this is encoded in parts that end between two turns; the control strings
#: there separate tokens, so the parts' tokens are those of the whole.
PART_CHARS = 1 << 20

_ESCAPE = re.compile(r"(<!*)(?=/?s>)|(\[!*)(?=/?INST\])")
_UNESCAPE = re.compile(r"(<!*)!(?=/?s>)|(\[!*)!(?=/?INST\])")
_MARKS = re.compile("|".join(map(re.escape, (BOS, EOS, ROLE, TEXT))))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "!", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] or m[2], text)


def tokenizer_json(path: str) -> str:
    """The vocabulary file, read once on the driver; it travels with the tasks, so executors need no copy of their own."""
    if os.path.getsize(path) > MOST_VOCABULARY:
        raise ValueError(f"{path} has over {MOST_VOCABULARY} bytes")
    with open(path, encoding="utf-8") as file:
        return file.read()


def load_tokenizer(vocabulary: str):
    """A tokenizer, from the text of its file, whose special tokens are the template's control strings, with exact offsets."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (BOS, EOS, ROLE, TEXT)])
    return tokenizer


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a character with one of the sorted, disjoint spans."""
    if not spans:
        return np.zeros(len(starts), bool)
    first, last = np.array(spans).T
    k = np.searchsorted(last, starts, side="right")  # the first span that ends after the token's start
    inside = np.minimum(k, len(spans) - 1)
    return (k < len(spans)) & (first[inside] < ends) & (ends > starts)


_SCHEMA = "part int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, part, formatted, ids, starts, ends, loss.

    One row per conversation, or several numbered parts of a very long one, in order within a
    partition: the rendered text, the tokens with their character offsets in it, and which of them
    count for the loss (those of texts whose role is ``assistant``). Turns are in order of turn, null
    first, then role and text, so ties and repeated rows have a fixed order. Null roles and texts are
    empty; a null conv_id is a conversation like any other. Other columns are ignored; an empty table gives an empty
    result.

    Conversations are spread by a hash of their id and streamed in order, a part at a time in memory.
    """
    rows, encode = _in_order(turns), _encoder(turns, tokenizer, part_chars)
    return rows.mapInArrow(encode, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {_SCHEMA}")


def _in_order(turns: DataFrame) -> DataFrame:
    rows = turns.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    return rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _encoder(turns: DataFrame, tokenizer: str, part_chars: int):
    """Turns in order -> batches of formatted parts."""
    from pyspark.sql.pandas.types import to_arrow_type

    batch_type, vocabulary = to_arrow_type(turns.schema["conv_id"].dataType), tokenizer_json(tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_tokenizer(vocabulary)
        for parts in _bundles(_parts(batches, part_chars)):
            encoded = encoder.encode_batch([text for _, _, text, _ in parts], add_special_tokens=False)
            offsets = [np.array(e.offsets, dtype=np.int32).reshape(-1, 2) for e in encoded]
            masks = [mask_tokens(o[:, 0], o[:, 1], spans) for o, (_, _, _, spans) in zip(offsets, parts)]
            ends = np.cumsum([0, *map(len, offsets)]).astype(np.int32)
            flat = np.concatenate(offsets)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in parts], batch_type), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.string()),
                    lists(pa.array(np.concatenate([np.array(e.ids, dtype=np.int32) for e in encoded]))),
                    lists(pa.array(np.ascontiguousarray(flat[:, 0]))), lists(pa.array(np.ascontiguousarray(flat[:, 1]))), lists(pa.array(np.concatenate(masks))),
                ],
                names=["conv_id", "part", "formatted", "ids", "starts", "ends", "loss"],
            )

    return run


def _parts(batches: Iterable[pa.RecordBatch], part_chars: int) -> Iterator[tuple[object, int, str, list[tuple[int, int]]]]:
    """(conversation, part, rendered text, spans of assistant texts) from turns in order."""
    current, part, pieces, size, spans = None, -1, [], 0, []
    for batch in chunks(batches, 4096):
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if part < 0 or conv != current:
                if pieces:
                    yield current, part, "".join(pieces), spans
                current, part, pieces, size, spans = conv, 0, [BOS], len(BOS), []
            elif size > part_chars:
                yield current, part, "".join(pieces), spans
                part, pieces, size, spans = part + 1, [], 0, []
            head, body = f"{ROLE}{escape(role)}{TEXT}", escape(text)
            if role == "assistant" and body:
                spans.append((size + len(head), size + len(head) + len(body)))
            pieces.append(f"{head}{body}{EOS}")
            size += len(pieces[-1])
    if pieces:
        yield current, part, "".join(pieces), spans


def _bundles(parts: Iterable[tuple], chars: int = 1 << 18) -> Iterator[list[tuple]]:
    bundle, size = [], 0
    for p in parts:
        bundle.append(p)
        size += len(p[2])
        if size >= chars:
            yield bundle
            bundle, size = [], 0
    if bundle:
        yield bundle


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a rendered conversation, or a part of one, was made of."""
    pieces, marks = _MARKS.split(formatted), _MARKS.findall(formatted)
    out, at = [], 1 if marks[:1] == [BOS] else 0
    for k in range(at, len(marks), 3):
        if marks[k : k + 3] != [ROLE, TEXT, EOS] or pieces[k]:
            raise ValueError("not a rendered conversation")
        out.append((unescape(pieces[k + 1]), unescape(pieces[k + 2])))
    return out


def read_loss(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts under the loss mask: maximal stretches of masked tokens, unescaped."""
    a, b = starts[loss], ends[loss]
    if not len(a):
        return []
    new = np.concatenate(([True], a[1:] > np.maximum.accumulate(b)[:-1]))
    first = np.flatnonzero(new)
    return [unescape(formatted[x:y]) for x, y in zip(a[first], np.maximum.reduceat(b, first))]


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What formatted conversations hold, read back from text, offsets and mask: one row each, in the order of the parts.

    Empty in, empty out; other columns are ignored.
    """
    columns = formatted.select("conv_id", "part", "formatted", "starts", "ends", "loss")
    return columns.mapInArrow(_digester(formatted), f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, {_DIGEST}")


def _digester(rows: DataFrame):
    """Batches of formatted parts -> a digest of each conversation."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, names = None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def result(done: list) -> pa.RecordBatch:
            columns = [[s[k] for s in done] for k in range(6)]
            columns[2], columns[4] = ([h.hexdigest() for h in columns[k]] for k in (2, 4))
            types = [id_arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in chunks(batches, 256):
            done = []
            column = lambda name, i: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
            for i, (conv, part, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted")))):
                if part == 0:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for body in read_loss(text, column("starts", i), column("ends", i), column("loss", i).astype(bool)):
                    state[3] += len(body)
                    state[4].update(body.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if done:
                yield result(done)
        if state is not None:
            yield result([state])

    return run


def format_and_digest(turns: DataFrame, tokenizer: str = TOKENIZER, part_chars: int = PART_CHARS) -> DataFrame:
    """``digest_conversations`` of ``format_conversations`` in one pass: the formatted batches stay in their worker."""
    encode, digest = _encoder(turns, tokenizer, part_chars), _digester(turns)
    return _in_order(turns).mapInArrow(lambda batches: digest(encode(batches)), f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {_DIGEST}")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -1, formatted and read back; odd rows as in ``format_conversations``."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return format_and_digest(turns.unionByName(extra))
