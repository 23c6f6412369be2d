"""Byte-level BPE with the tiktoken library: texts to token ids and back to bytes.

The rank file is read once on the driver and sent to the tasks; a vocabulary has a fixed size, and files over
``MAX_RANK_BYTES`` are refused. Each worker builds the encoder once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm.common import document_batches, text_slices, tidy

MAX_RANK_BYTES = 64 << 20
#: Longer texts are encoded in parts of about so many characters.
PART_CHARS = 1 << 16
# A safe boundary: a letter of a long-settled script, then an ASCII character that is no letter. Every match of
# the splitting pattern that holds the letter ends there, whatever follows, and none looks back.
_SAFE = re.compile(
    r"(?<=[A-Za-zÀ-ÖØ-öø-ſΑ-Ρα-ωА-яא-ת"
    r"अ-हぁ-ゔァ-ヺ一-龥가-힣])(?=[\x00-\x40\x5B-\x60\x7B-\x7F])"
)
#: Longer pieces without a safe boundary are split in Python: on a million blanks the library's splitter ends the process.
LONGEST_PIECE = 1 << 18
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(rank_bytes: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file (lines of base64 token and rank), one per process."""
    key = hashlib.sha256(rank_bytes + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        pairs = (line.split() for line in rank_bytes.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts of a text, cut at safe boundaries only; their encodings joined are that of the whole text."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def piece_ids(coder: tiktoken.Encoding, piece: str, longest: int = LONGEST_PIECE) -> Iterator[list[int]]:
    """Ids of a piece, however long; a piece above ``longest`` is cut at the ends of matches, found in Python.

    Matches that follow each other are encoded together, since between their ends they match alike; a single match that
    is too long for the splitter is one piece of the merges anyway.
    """
    if len(piece) <= longest:
        yield coder.encode_ordinary(piece)
        return
    start = end = 0
    for match in regex.finditer(coder._pat_str, piece):
        if match.end() - start > longest and end > start:
            yield coder.encode_ordinary(piece[start:end])
            start = end
        end = match.end()
        if end - start > longest:
            yield coder._encode_single_piece(piece[start:end])
            start = end
    if end > start:
        yield coder.encode_ordinary(piece[start:end])


def encode_text(coder: tiktoken.Encoding, text: str | None, size: int = PART_CHARS) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers; none for a null or empty text."""
    if not text:
        return b""
    return b"".join(np.array(ids, dtype="<u4").tobytes() for p in parts(text, size) for ids in piece_ids(coder, p))


def decode_ids(coder: tiktoken.Encoding, ids: bytes | None) -> bytes:
    """The bytes that packed ids stand for."""
    return coder.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist()) if ids else b""


def _rank_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        found = file.read(MAX_RANK_BYTES + 1)
    if len(found) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is over {MAX_RANK_BYTES} bytes")
    return found


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           part_chars: int = PART_CHARS, verify: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids (binary, little-endian unsigned 32-bit integers).

    Special tokens are not used: their strings are ordinary text. A null text has no tokens. With ``verify`` the ids
    are decoded at once, and a column round_trip tells whether they give the text.
    """
    document_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_rank_bytes(rank_path))
    chosen = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value, pattern)
        for batch in text_slices(batches, 1):
            texts = batch.column(1).to_pylist()
            ids = [encode_text(coder, text, part_chars) for text in texts]
            columns = [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if verify:
                columns.append(pa.array([
                    decode_ids(coder, i) == (text or "").encode() for i, text in zip(ids, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_tokens", "ids", "round_trip"][:3 + verify]
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary" + ", round_trip boolean" * verify)


def decode(tokens: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", result: str = "decoded",
           keep_ids: bool = False) -> DataFrame:
    """Replace the packed ids by the bytes they stand for, in a binary column ``result``, or add it if ids are kept.

    The bytes need not be UTF-8: ids may cut a character. Null ids give no bytes; an unknown id is an error.
    """
    document_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(_rank_bytes(rank_path))
    others = [c for c in tokens.columns if c != result and (keep_ids or c != ids_col)]
    chosen = tokens.select(F.col(ids_col).alias("_packed"), *others)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value, pattern)
        for batch in text_slices(batches, 0):
            found = [decode_ids(coder, ids) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(found, pa.binary())], names=[*others, result])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_packed"]
    return chosen.mapInArrow(run, ", ".join([*kept, f"`{result}` binary"]))
