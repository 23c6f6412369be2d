"""BPE with the tokenizers library where chunks that documents share are encoded once.

A rolling hash cuts every text into content-defined chunks, so equal passages give equal chunks wherever they stand. Digests of
all chunks are counted; those that occur more than once are encoded once, in a table, and every document takes their ids from
there. A chunk's own ids are not those it has inside a text: the split into words may run over its ends. So each
join is repaired: from the last boundary before the join that no later character can move, the text is encoded anew,
until a boundary is found that the chunk's own split has too. From there on both splits agree, since a match of the
pattern depends on no character before it, and the chunk's ids are taken. What lies between shared chunks is encoded
with the repair that leads to the next one. Without agreement a chunk is encoded with the text, so ids are always exact.

Where chunks with a single occurrence are is not known without a shuffle, but a Bloom filter of fixed size (``BLOOM_BITS``) of
the shared digests tells for most: a document without a hit is encoded where it is read, and only the others move. When
there are more shared chunks than the filter can tell apart, more documents move; results are the same.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm.common import ROW, document_batches, mix64, numbered, text_slices, tidy
from postlab.session import stored

MAX_MODEL_BYTES = 64 << 20
#: Bytes of the rolling hash's window, least and most bytes of a chunk; a cut where ``CUT_BITS`` bits of the hash are zero.
WINDOW, LEAST, MOST, CUT_BITS = 16, 256, 8192, 10
BLOOM_BITS = 1 << 26
BLOOM_HASHES = 4
#: Characters that a repair looks at beyond a join at first.
HEAD = 48
#: Characters that the library gets at once, if a match ends among them.
PIECE = 1 << 14
#: Texts up to this length go to the fast encoder in one piece; a run of a million blanks overflows its stack.
FAST = 1 << 18
#: A digest with more than 1/HOT of all shared occurrences is joined by broadcast; there are fewer than HOT of them.
HOT = 1000

# ---- fixed values ---------------------------------------------------------------------------------------------
#: The pattern by which byte-level tokenizers split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that stand for themselves in a byte-level vocabulary; the others, ascending, are the characters from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Characters that both encoders are known to class alike (checked one by one in the tests).
PLAIN = re.compile("[\x00-\x7E¡-ͷͺ-Ϳ΄-ΊΑ-ΡΣ-ԯא-ת‐-‧‰-⁞₠-₿←-⇿、-〾ぁ-ゖ゛-ヿ一-龥가-힣]*")
# ---- end of fixed values --------------------------------------------------------------------------------------


# ---- encoders -------------------------------------------------------------------------------------------------

class Coder:
    """A byte-level BPE tokenizer file: exact encoding in pieces of bounded size, and decoding."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(model)
        split, added = spec["pre_tokenizer"] or {}, spec.get("added_tokens") or []
        odd = [t for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"]]
        if (spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True)
                or split.get("add_prefix_space") or spec["normalizer"] or odd):
            raise ValueError("a byte-level BPE without prefix space, normalizer and stripping added tokens is needed")
        self.library = Tokenizer.from_str(model.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in added]
        #: A boundary so many characters before a cut stays, whatever follows: no added token reaches back to it.
        self.margin = max(map(len, self.special), default=0) + 2
        self.packed = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.fast = _same_merges(spec["model"])

    def split(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """The ids of a text, and where its matches start: (character, tokens before it), the end of the text included."""
        found = self.library.encode(text, add_special_tokens=False)
        words, spans = found.word_ids, found.offsets
        marks = [(spans[i][0], i) for i in range(len(words)) if i == 0 or words[i] != words[i - 1]]
        return found.ids, [*marks, (len(text), len(words))]

    def plain(self, text: str) -> list[int]:
        """The ids of a text."""
        if (self.fast and len(text) <= FAST and PLAIN.fullmatch(text)
                and not any(token in text for token in self.special)):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def chunk(self, text: str) -> tuple[bytes, int, int]:
        """Packed ids of a chunk, its last boundary that no later text moves, and the tokens before that."""
        ids, marks = self.split(text)
        tail, before = max((m for m in marks if m[0] <= len(text) - self.margin), default=(0, 0))
        return np.array(ids, dtype=self.packed).tobytes(), tail, before

    def join(self, text: str, shared: list[tuple[int, int, bytes, int, int]]) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        ``shared`` has chunks in ascending order: start and end in the text, and what ``chunk`` gave for it.
        """
        out: list[bytes] = []
        at = 0  # a boundary of the whole text's split; the ids before it are in ``out``
        for start, end, ids, tail, before in shared:
            if tail == 0 or at >= start + tail:
                continue
            at, own = (start, 0) if at == start else self._agree(text, at, start, end, out)
            if own is not None and at <= start + tail:
                out.append(_wide(np.frombuffer(ids, dtype=self.packed)[own:before]))
                at = start + tail
        self._encode_to_end(text, at, out)
        return b"".join(out)

    def _agree(self, text: str, at: int, start: int, end: int, out: list[bytes]) -> tuple[int, int | None]:
        """Encode from the boundary ``at`` until a boundary of the chunk's own split is met: that boundary and the
        chunk's tokens before it, or the boundary reached and None if the chunk ends first."""
        at = self._step(text, at, start, out)
        reach = HEAD
        while True:
            upto = min(start + reach, end)
            ids, marks = self.split(text[at:upto])
            settled = [(at + c, n) for c, n in marks if c <= upto - at - self.margin]
            own = {start + c: n for c, n in self.split(text[start:upto])[1] if c <= upto - start - self.margin}
            met = next((m for m in settled if m[0] >= start and m[0] in own), None)
            if met or settled:
                mark, n = met or settled[-1]
                out.append(_wide(np.array(ids[:n])))
                at = mark
            if met or upto == end:
                return at, own[at] if met else None
            reach *= 2

    def _step(self, text: str, at: int, target: int, out: list[bytes]) -> int:
        """Encode in pieces from the boundary ``at`` until less than a piece is left to ``target``."""
        piece = PIECE
        while target - at > piece:
            ids, marks = self.split(text[at:at + piece])
            mark, n = max(m for m in marks if m[0] <= piece - self.margin)
            out.append(_wide(np.array(ids[:n])))
            at, piece = at + mark, PIECE if mark else 2 * piece
        return at

    def _encode_to_end(self, text: str, at: int, out: list[bytes]) -> None:
        if len(text) - at > FAST:
            at = self._step(text, at, len(text), out)
        out.append(_wide(np.array(self.plain(text[at:]))))

    def decode(self, ids: bytes | None) -> str:
        """The text that packed 32-bit ids stand for."""
        return self.library.decode(np.frombuffer(ids or b"", dtype="<u4").tolist(), skip_special_tokens=False)


def _wide(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def _same_merges(table: dict):
    """The merges of a vocabulary as tiktoken ranks, several times as fast; None unless ids ascend with the merges."""
    import tiktoken

    if any(table.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix",
                                  "end_of_word_suffix")):
        return None
    others = [b for b in range(256) if b not in set(SHOWN)]
    letters = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(others)}
    vocab = table["vocab"]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in table["merges"]]
    if any(x >= y for x, y in zip(merged, merged[1:])) or len(merged) + 256 != len(vocab):
        return None
    ranks = {bytes(letters[ch] for ch in token): i for token, i in vocab.items()}
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def coder(model: bytes) -> Coder:
    """The encoder of a tokenizer file, one per process."""
    return Coder(model)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        found = file.read(MAX_MODEL_BYTES + 1)
    if len(found) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is over {MAX_MODEL_BYTES} bytes")
    return found


# ---- content-defined chunks -----------------------------------------------------------------------------------

_TABLE = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_FACTOR = 0x01000193


def cut_points(texts: pa.Array) -> tuple[bytes, list[list[int]]]:
    """The UTF-8 bytes of all texts of a batch and, for each text, the ends of its chunks in them, its start first.

    A cut stands where the hash of the ``WINDOW`` bytes before it has ``CUT_BITS`` zero bits, at the start of a character.
    Chunks have ``LEAST`` bytes or more but for the last one of a text, and ``MOST`` or fewer. An empty text has none.
    """
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8)[bounds[0]:bounds[-1]] if whole else np.zeros(0, np.uint8)
    bounds = (bounds - bounds[0]).tolist()
    hashed, width = _TABLE[data], 1
    while width < WINDOW:
        factor = np.uint32(pow(_FACTOR, width, 1 << 32))
        hashed = hashed[:-width] * factor + hashed[width:] if len(hashed) > width else hashed[:0]
        width *= 2
    inside = (data & 0xC0) == 0x80
    found = np.flatnonzero(hashed >> np.uint32(32 - CUT_BITS) == 0) + WINDOW
    found = found[found < len(data)]
    found = found[~inside[found]].tolist()
    cuts, at = [], 0
    for a, b in zip(bounds, bounds[1:]):
        ends = [a]
        while at < len(found) and found[at] < a + WINDOW:
            at += 1
        while at < len(found) and found[at] < b:
            _forced(ends, found[at], inside)
            if found[at] - ends[-1] >= LEAST:
                ends.append(found[at])
            at += 1
        _forced(ends, b, inside)
        cuts.append([*ends, b] if b > ends[-1] else ends)
    return data.tobytes(), cuts


def _forced(ends: list[int], upto: int, inside: np.ndarray) -> None:
    while upto - ends[-1] > MOST:
        cut = ends[-1] + MOST
        while inside[cut]:
            cut -= 1
        ends.append(cut)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _digests(batch_texts: pa.Array) -> Iterator[list[tuple[bytes, int, int, bytes]]]:
    """For each text its chunks: digest, start and end in the returned bytes of the batch."""
    data, cuts = cut_points(batch_texts)
    for ends in cuts:
        yield [(digest(data[a:b]), a - ends[0], b - ends[0], data[a:b]) for a, b in zip(ends, ends[1:])]


# ---- a filter of shared digests -------------------------------------------------------------------------------

def _places(digests: list[bytes], bits: int) -> np.ndarray:
    halves = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    steps = np.arange(BLOOM_HASHES, dtype=np.uint64)
    return (halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


class Bloom:
    """A set of digests with false alarms but no misses, of a size that does not depend on the data beyond ``BLOOM_BITS``."""

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray):
        self.bits = bits
        self.words = np.zeros(bits // 64, dtype=np.uint64)
        self.words[words] = values.view(np.uint64)

    def hits(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, dtype=bool)
        at = _places(digests, self.bits)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool).all(axis=1)


def bloom_filter(digests: DataFrame, count: int) -> Bloom:
    """The filter of a column of digests: bits are set in the tasks and joined by OR, word by word."""
    bits = min(BLOOM_BITS, max(1024, 1 << (16 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(_places(batch.column(0).to_pylist(), bits))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                values = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.astype(np.int64)), pa.array(values.view(np.int64))], names=["word", "bits"])

    table = digests.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    return Bloom(bits, table["word"].to_numpy(), table["bits"].to_numpy())


# ---- the operator ---------------------------------------------------------------------------------------------

def _chunk_digests(docs: DataFrame) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            found = [[c[0] for c in chunks] for chunks in _digests(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=[ROW, "digests"])

    return docs.select(ROW, "text").mapInArrow(run, f"{ROW} bigint, digests array<binary>")


def _shared_chunks(docs: DataFrame, model, bloom) -> DataFrame:
    """(digest, ids, tail, before) of every chunk that the filter knows, encoded once."""
    @tidy
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        for batch in text_slices(batches, 0):
            found = {c[0]: c[3] for chunks in _digests(batch.column(0)) for c in chunks}
            keys = list(found)
            keys = [k for k, hit in zip(keys, known.hits(keys)) if hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([found[k].decode() for k in keys], pa.string())],
                names=["digest", "chunk"])

    @tidy
    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        for batch in batches:
            coded = [own.chunk(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c[0] for c in coded], pa.binary()),
                 pa.array([c[1] for c in coded], pa.int32()), pa.array([c[2] for c in coded], pa.int32())],
                names=["digest", "ids", "tail", "before"])

    chunks = docs.select("text").mapInArrow(pick, "digest binary, chunk string").distinct()
    return chunks.mapInArrow(encode_chunks, "digest binary, ids binary, tail int, before int")


def _given(places: DataFrame, shared: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, given): for each row with shared chunks their numbers and encodings.

    Digests with more than 1/HOT of the shared occurrences are answered by broadcast, the others by a shuffled join.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    value = F.struct("ids", "tail", "before")
    hot = counts.where(F.col("n") * HOT > total).select("digest")
    most = shared.join(F.broadcast(hot), "digest").select(F.col("digest").alias("_hot_key"), value.alias("_hot"))
    others = shared.select(F.col("digest").alias("_cold_key"), value.alias("_cold"))
    at = places.select(ROW, F.posexplode("digests").alias("number", "digest"))
    marked = at.join(F.broadcast(most), F.col("digest") == F.col("_hot_key"), "left")
    quick = marked.where(F.col("_hot").isNotNull()).select(ROW, "number", F.col("_hot").alias("code"))
    slow = marked.where(F.col("_hot").isNull()).join(others, F.col("digest") == F.col("_cold_key")).select(
        ROW, "number", F.col("_cold").alias("code"))
    return quick.unionAll(slow).groupBy(ROW).agg(F.collect_list(F.struct("number", "code.*")).alias("given"))


def _row(own: Coder, text: str, chunks: list, given: list) -> bytes:
    """The ids of a text, with the encodings that are given for some of its chunks."""
    found = {g["number"]: g for g in given}
    shared, at = [], 0
    for number, (_, a, b, data) in enumerate(chunks):
        length = b - a if data.isascii() else len(data.decode())
        if number in found:
            g = found[number]
            shared.append((at, at + length, g["ids"], g["tail"], g["before"]))
        at += length
    return own.join(text, shared)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (binary, little-endian unsigned 32-bit integers).

    Ids are those of the tokenizers library without added special tokens at the ends, truncation or padding; the text of an
    added token inside a document is that token, as in the library. A null text counts as empty and has no ids. Repeated and
    null identifiers keep their rows. Chunks are known by a 128-bit digest.
    """
    spark = docs.sparkSession
    document_batches(spark)
    model = spark.sparkContext.broadcast(_model_bytes(model_path))
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").select(
        ROW, "id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    places = stored(_chunk_digests(rows.select(ROW, "text")), "chunks")
    counts = places.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.where("n > 1"), "shared-digests")
    bloom = spark.sparkContext.broadcast(bloom_filter(counts.select("digest"), counts.count()))
    shared = stored(_shared_chunks(rows, model, bloom), "shared-chunks")

    def parts(batches: Iterator[pa.RecordBatch], hit: bool) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in text_slices(batches, 2):
            chunks = list(_digests(batch.column(2)))
            flat = bloom.value.hits([c[0] for found in chunks for c in found])
            firsts = np.concatenate([[0], np.cumsum([len(found) for found in chunks])])
            sums = np.concatenate([[0], np.cumsum(flat)])
            chosen = np.flatnonzero((sums[firsts[1:]] > sums[firsts[:-1]]) == hit)
            yield batch.take(pa.array(chosen)), [chunks[i] for i in chosen]

    @tidy
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        for batch, _ in parts(batches, False):
            yield _coded(batch.column(1), [own.join(text, []) for text in batch.column(2).to_pylist()])

    @tidy
    def moving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in parts(batches, True):
            yield batch

    @tidy
    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        for batch in text_slices(batches, 1):
            found = zip(batch.column(1).to_pylist(), _digests(batch.column(1)), batch.column(2).to_pylist())
            yield _coded(batch.column(0), [_row(own, text, chunks, given or []) for text, chunks, given in found])

    result = f"`{id_col}` {kind}, n_tokens bigint, ids binary"

    def _coded(ids: pa.Array, coded: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary())],
            names=[id_col, "n_tokens", "ids"])

    moved = rows.mapInArrow(moving, f"{ROW} bigint, id {kind}, text string").join(
        _given(places, shared, counts), ROW, "left").select("id", "text", "given")
    return rows.mapInArrow(alone, result).unionAll(moved.mapInArrow(assembled, result))


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", result: str = "decoded") -> DataFrame:
    """Replace packed ids by the text they stand for, special tokens included, in a column ``result``.

    Null ids give an empty text; bytes that are no UTF-8 give replacement characters and unknown ids nothing, as in the
    library.
    """
    document_batches(tokens.sparkSession)
    model = tokens.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    others = [c for c in tokens.columns if c not in (result, ids_col)]
    chosen = tokens.select(F.col(ids_col).alias("_packed"), *others)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        for batch in text_slices(batches, 0):
            found = [own.decode(ids) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string())], names=[*others, result])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_packed"]
    return chosen.mapInArrow(run, ", ".join([*kept, f"`{result}` string"]))
