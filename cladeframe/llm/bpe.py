"""Byte-level BPE: texts to packed token ids with the tiktoken library, and ids back to raw bytes.

Both directions are narrow maps over Arrow batches: no shuffle, one pass, memory bounded by ``CHUNK``
characters of text besides the batch itself.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts longer than this many characters are encoded piece by piece, cut at safe boundaries.
CHUNK = 1 << 18
#: A run of so many white-space characters is encoded without the pattern, whose matching of a run takes stack in proportion.
LONG_RUN = 1 << 12
_LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
#: Output batches are closed once they hold this many bytes.
OUT_BYTES = 8 << 20


def _ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a local rank file, without special tokens; loaded once per worker."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=_ranks(rank_file), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(rank_file: str) -> list[bytes]:
    """Bytes by id; None where an id is free. Workers that only decode need no more than this."""
    ranks = _ranks(rank_file)
    out: list = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def safe_pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """The text in pieces of about ``chunk`` characters, cut only where no match of the pattern can span.

    A cut is made before a plain space that follows a visible ASCII character. Of the patterns's
    alternatives only runs of white space hold a space that is not first, and those hold nothing visible;
    no alternative looks behind. So the matches of the pieces are those of the whole text. A stretch
    without such a place (one very long word, or a script that is written without spaces) stays whole, so memory follows the longest such stretch.
    """
    at = 0
    while len(text) - at > chunk:
        cut = at + chunk
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or "!" <= text[cut - 1] <= "~":
                break
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def runs_apart(text: str) -> Iterator[tuple[str, bool]]:
    """The text in stretches and whether each is one match: long runs of white space stand by themselves.

    Before something visible the pattern leaves a run's last character out of its match, at the text's end it doesn't; that character begins the next stretch.
    """
    at = 0
    for m in _LONG_RUN.finditer(text):
        if m.start() > at:
            yield text[at : m.start()], False
        at = m.end() if m.end() == len(text) else m.end() - 1
        yield text[m.start() : at], True
    if at < len(text):
        yield text[at:], False


def encode_text(text: str | None, rank_file: str, pattern: str, chunk: int = CHUNK) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    if not text:
        return b""
    enc = encoding(rank_file, pattern)
    by_pattern = lambda x: enc.encode_to_numpy(x, disallowed_special=()).astype("<u4", copy=False).tobytes()
    out = []
    for stretch, one in runs_apart(text) if len(text) >= LONG_RUN else [(text, False)]:
        if one:
            out.append(np.array(enc._encode_single_piece(stretch), "<u4").tobytes())
        elif len(stretch) <= chunk:
            out.append(by_pattern(stretch))
        else:
            out.extend(map(by_pattern, safe_pieces(stretch, chunk)))
    return b"".join(out)


def decode_ids(ids: bytes | None, rank_file: str) -> bytes:
    """The raw bytes that packed ids stand for; an unknown id raises KeyError."""
    if not ids:
        return b""
    table = token_bytes(rank_file)
    try:
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
    except (IndexError, TypeError) as e:
        raise KeyError("a token id that the rank file does not have") from e


def _mapped(df: DataFrame, column: str, outs: list[str], f) -> DataFrame:
    """``df`` with the binary columns ``outs`` that ``f`` makes of a column."""
    kept = [x for x in df.schema.fields if x.name not in outs]
    schema = T.StructType([*kept, *(T.StructField(out, T.BinaryType()) for out in outs)])
    names = [x.name for x in kept]

    def joined(rest: pa.RecordBatch, made: list[tuple[bytes, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rest.columns, *(pa.array([m[k] for m in made], pa.binary()) for k in range(len(outs)))], names=schema.names)

    def run(batches):
        for batch in batches:
            values, at = batch.column(column), 0
            made: list[tuple[bytes, ...]] = []
            held = 0
            rest = batch.select(names)
            for i in range(len(values)):
                made.append(x := f(values[i].as_py()))
                held += sum(map(len, x))
                if held >= OUT_BYTES:
                    yield joined(rest.slice(at, len(made)), made)
                    at, made, held = i + 1, [], 0
            if made:
                yield joined(rest.slice(at, len(made)), made)
            del batch, values, rest, made
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out_col: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``out_col``: the token ids of ``text_col``, packed as little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is merged separately; there are no special tokens, so their strings are
    ordinary text. A null text counts as empty and gets no ids. A column already named ``out_col`` is
    replaced; all other columns are kept, repeated rows too. An empty table gives an empty table.
    """
    return _mapped(df, text_col, [out_col], lambda x: (encode_text(x, rank_file, pattern, chunk),))


def decode(df: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the raw bytes of the packed ids (null or empty: no bytes); not decoded as UTF-8,
    as ids may end within a character. An id that the rank file lacks fails the job."""
    return _mapped(df, ids_col, [out_col], lambda x: (decode_ids(x, rank_file),))


def round_tripped(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", chunk: int = CHUNK) -> DataFrame:
    """:func:`encode` and then :func:`decode` of its ids, in one pass and one worker a task."""

    def both(text: str | None) -> tuple[bytes, bytes]:
        ids = encode_text(text, rank_file, pattern, chunk)
        return ids, decode_ids(ids, rank_file)

    return _mapped(df, text_col, [ids_col, decoded_col], both)


def unpacked(ids):
    """Native column: packed ids as ``array<long>``, for those who need single ids."""
    from pyspark.sql import functions as F

    n = (F.length(ids) / 4).cast("int")
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k, 1)), 16, 10).cast("long")
    at = lambda i: byte(i, 1) + byte(i, 2) * 256 + byte(i, 3) * 65536 + byte(i, 4) * 16777216
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<long>"))
