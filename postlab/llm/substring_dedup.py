"""Repeated passages by relative Lempel-Ziv parsing against all documents.

The reference is the text of all documents in the order of their identifiers, words in place of characters. A factor is
a run of windows of a document whose earliest sources run on in the reference (see README); factors of ``window`` words or more are
duplicate spans. The phrase index of the reference is cut into blocks, each a range of phrase hashes and held by one
task, so every document is looked up in every block that can have a phrase of it, and in no other:

1. Anchors. Of every ``window`` consecutive words, the phrase of ``ANCHOR`` words with the smallest hash is the
   window's anchor; equal windows have equal anchors. Only anchors that occur twice go on.
2. Windows. The windows of such anchors, known by 96 bits of hash, go to the index block of their anchor, where each finds
   its earliest occurrence. A window that has an earlier one extends the factor before it if its source is the next
   word of that factor's source, else it opens a factor. Since every window is looked up, windows that lie across
   the end of one factor and the begin of the next are found as well.
3. Spans. The factors of a document meet its text, and the words that they cover are removed.

Before anything is sent, a task keeps the first of equal phrases that it has seen itself and settles the others, so a
passage that a third of all documents hold reaches its block once per task and flush. Copies of a whole text
skip the second step: the earliest holds all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm.common import ROW, Words, document_batches, mix64, numbered, text_slices, tidy, views
from postlab.llm.exact_dedup import merge_runs
from postlab.session import stored_alone

#: Words of an anchor.
ANCHOR = 8
#: Phrases that a task collects before it sends them, and phrases of an index block.
FLUSH = 1 << 19
BLOCK = 1 << 19
_SECOND_BASE = np.uint64(0xD1B54A32D192ED03)
_PACKED = "part int, a binary, b binary, c binary, d binary, e binary"
FACTORS = "array<struct<start:int,length:int,source:bigint,source_start:int>>"


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    rows = [(part, *(x.tobytes() for x in arrays), *[b""] * (5 - len(arrays))) for part, *arrays in rows]
    return _rows(rows, ["part", *"abcde"], [pa.int32(), *[pa.binary()] * 5])


def _by_block(block: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """Rows (block, arrays) of entries; within a block in the order given."""
    order = np.argsort(block, kind="stable")
    block, arrays = block[order], [a[order] for a in arrays]
    begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
    return [(int(block[s]), *(a[s:e] for a in arrays)) for s, e in zip(begin, [*begin[1:], len(block)])]


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first words of all windows, the word at which the anchor of each begins, phrase hashes, text of each word."""
    phrases, span = words.windows(ANCHOR), window - ANCHOR + 1
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    start = np.arange(max(0, len(words.hash) - window + 1))
    start = start[start + window <= words.first[1:][text[start]]]
    if not len(start):
        return start, start, phrases, text
    least = np.lib.stride_tricks.sliding_window_view(phrases, span)[start].argmin(axis=1)
    return start, start + least, phrases, text


def _block_of(phrase: np.ndarray, blocks: int) -> np.ndarray:
    # anchors have small hashes, so these are scrambled first
    return ((mix64(phrase ^ _SECOND_BASE) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


# ---- 1: anchors ---------------------------------------------------------------------------------------------------

def _shared_anchors(docs: DataFrame, window: int, blocks: int) -> DataFrame:
    """(doc, places): the words of each document at which an anchor begins that occurs elsewhere too, packed."""
    @tidy
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            phrase, doc, place = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(phrase, kind="stable")
            phrase, doc, place = phrase[order], doc[order], place[order]
            first = np.concatenate([[True], phrase[1:] != phrase[:-1]])
            single = first & np.concatenate([first[1:], [True]])
            block = _block_of(phrase, blocks)
            rows = _by_block(block[first], (phrase[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32), doc[first], place[first])
            # of a phrase seen twice, all places are settled
            if not single.all():
                rows.append((-1 - int(block[~single][0]), np.zeros(0, np.uint32), doc[~single], place[~single]))
            return _pack(rows)

        for batch in text_slices(batches, 1, 1 << 20):
            words = Words(batch.column(1))
            _, anchor, phrases, text = _anchors(words, window)
            anchor = np.unique(anchor)
            if len(anchor):
                doc = np.asarray(batch.column(0))[text[anchor]]
                held.append((phrases[anchor], doc, (anchor - words.first[text[anchor]]).astype(np.uint32)))
                count += len(anchor)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    def homeward(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """What a block has found, packed by the task that will gather each document's places."""
        home = (mix64(doc.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        rows = [(h, d.tobytes(), p.tobytes()) for h, d, p in _by_block(home, doc, place)]
        return _rows(rows, ["home", "docs", "places"], [pa.int32(), pa.binary(), pa.binary()])

    @tidy
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list] = {}
        for batch in batches:
            columns = (views(batch.column(i + 1), kind) for i, kind in enumerate((np.uint32, np.int64, np.uint32)))
            for part, phrase, doc, place in zip(batch.column(0).to_pylist(), *columns):
                if part < 0:
                    yield homeward(doc, place)
                else:
                    packed.setdefault(part, []).append((phrase, doc, place))
        while packed:
            _, rows = packed.popitem()
            phrase, doc, place = (np.concatenate(c) for c in zip(*rows))
            order = np.argsort(phrase, kind="stable")
            same = phrase[order][1:] == phrase[order][:-1]
            shared = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            if len(shared):
                yield homeward(doc[shared], place[shared])

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list] = {}
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), views(batch.column(1), np.int64), views(batch.column(2), np.uint32))
            for home, doc, place in rows:
                packed.setdefault(home, []).append((doc, place))
        while packed:
            _, rows = packed.popitem()
            found = _by_block(*(np.concatenate(c) for c in zip(*rows)))
            for start in range(0, len(found), 1000):
                yield _rows([(d, p.tobytes()) for d, p in found[start:start + 1000]], ["doc", "places"], [pa.int64(), pa.binary()])

    sent = docs.select("doc", "text").mapInArrow(collect, _PACKED).repartition(blocks, "part")
    back = sent.mapInArrow(match, "home int, docs binary, places binary").repartition(blocks, "home")
    return back.mapInArrow(gather, "doc bigint, places binary")


# ---- 2: windows ----------------------------------------------------------------------------------------------------

def factors(doc: np.ndarray, start: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> list[np.ndarray]:
    """Greedy factors of windows with sources: doc, first window, number of windows, source and its first word.

    A factor goes on as long as the next window of the document follows and its source does so too.
    """
    order = np.lexsort((start, doc))
    doc, start, source, source_start = (x[order] for x in (doc, start, source, source_start))
    goes_on = (
        (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1)
        & (source[1:] == source[:-1]) & (source_start[1:] == source_start[:-1] + 1))
    begin = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(doc) else np.zeros(0, int)
    count = np.diff(np.append(begin, len(doc)))
    return [doc[begin], start[begin], source[begin], source_start[begin], count.astype(np.uint32)]


def _settle(phrase: np.ndarray, second: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list]:
    """Which windows are the first of their kind, in the order given, and the factors of the others."""
    order = np.lexsort((start, doc, second, phrase))
    p, s = phrase[order], second[order]
    first = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
    source = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later, source = order[~first], source[~first]
    # a row that repeats an identifier has a number of its own, so the source is a smaller (doc, start)
    return order[first], factors(doc[later], start[later], doc[source], start[source])


def _windows(docs: DataFrame, window: int, blocks: int) -> DataFrame:
    """(doc, start, count, source, source_start): the factors of each document, in windows. ``docs`` has doc, text, places."""
    @tidy
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            block, phrase, second, doc, start = (np.concatenate(c) for c in zip(*held))
            first, settled = _settle(phrase, second, doc, start)
            first = first[np.lexsort((start[first], doc[first]))]
            rows = _by_block(block[first], phrase[first], second[first], doc[first], start[first])
            if len(settled[0]):
                rows.append((-1 - int(block[0]), *settled))
            return _pack(rows)

        for batch in text_slices(batches, 1, 1 << 20):
            words = Words(batch.column(1))
            start, anchor, phrases, text = _anchors(words, window)
            marked = np.zeros(len(words.hash) + 1, dtype=bool)
            for begin, places in zip(words.first, views(batch.column(2), np.uint32)):
                marked[begin + places.astype(np.int64)] = True
            chosen = marked[anchor]
            start, anchor = start[chosen], anchor[chosen]
            if len(start):
                second = (words.windows(window, _SECOND_BASE)[start] >> np.uint64(32)).astype(np.uint32)
                held.append((
                    _block_of(phrases[anchor], blocks), words.windows(window)[start], second,
                    np.asarray(batch.column(0))[text[start]], (start - words.first[text[start]]).astype(np.uint32)))
                count += len(start)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    names, kinds = ["doc", "start", "source", "source_start", "count"], (np.int64, np.uint32, np.int64, np.uint32, np.uint32)

    window_kinds = (np.uint64, np.uint32, np.int64, np.uint32)

    def unpacked(arrays: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int64) if k is np.int64 else a.astype(np.int32)) for a, k in zip(arrays, kinds)], names=names)

    @tidy
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list] = {}
        for batch in batches:
            for row, part in enumerate(batch.column(0).to_pylist()):
                one = batch.slice(row, 1)
                if part < 0:
                    yield unpacked([views(one.column(i + 1), kind)[0] for i, kind in enumerate(kinds)])
                else:
                    held = [views(one.column(i + 1), kind)[0] for i, kind in enumerate(window_kinds)]
                    packed.setdefault(part, []).append(held)
        while packed:
            _, rows = packed.popitem()
            yield unpacked(_settle(*(np.concatenate(c) for c in zip(*rows)))[1])

    sent = docs.select("doc", "text", "places").mapInArrow(collect, _PACKED).repartition(blocks, "part")
    return sent.mapInArrow(match, "doc bigint, start int, source bigint, source_start int, count int")


# ---- 3: spans --------------------------------------------------------------------------------------------------------

def _cut(text: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[int, int, bytes]:
    """Number of words, number of words in the spans, and the other words with one blank between them."""
    words = text.split()
    if not len(starts):
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    kept = np.cumsum(edge[:-1]) == 0
    return len(words), int(len(words) - kept.sum()), b" ".join([words[i] for i in np.flatnonzero(kept)])


def _spans(docs: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept_text, factors) from id, text, parts (factors in windows) and copy_of."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            rows = []
            for identifier, text, parts, copy_of in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                if copy_of is not None:
                    n = len(data.split())
                    spans = [(0, n, copy_of, 0)] if n >= window else []
                elif parts:
                    table = np.array([tuple(p.values()) for p in parts], dtype=np.int64)
                    merged = np.stack(_merge(table), axis=1)
                    spans = [(int(s), int(c) + window - 1, int(d), int(p)) for s, c, d, p in merged]
                else:
                    spans = []
                spans.sort()
                at = np.array([s[:2] for s in spans], dtype=np.int64).reshape(-1, 2)
                n, removed, kept = _cut(data, at[:, 0], at[:, 1])
                rows.append((identifier, n, removed, kept.decode(), [
                    {"start": s, "length": c, "source": d, "source_start": p} for s, c, d, p in spans]))
            yield _rows(rows, ["id", "n_words", "n_removed", "kept_text", "factors"], [
                batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([
                    ("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", "parts", "copy_of").mapInArrow(
        run, f"id {kind}, n_words bigint, n_removed bigint, kept_text string, factors {FACTORS}")


def _merge(table: np.ndarray) -> list[np.ndarray]:
    """Join factors (start, count, source, source_start) that index blocks have found in pieces."""
    table = table[np.argsort(table[:, 0], kind="stable")]
    start, count, source, place = table.T
    goes_on = (start[1:] == start[:-1] + count[:-1]) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + count[:-1])
    begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return [start[begin], np.add.reduceat(count, begin), source[begin], place[begin]]


# ---- all --------------------------------------------------------------------------------------------------------------

def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(id, n_words, n_removed, kept_text, factors) of every row.

    Words are runs of characters other than blank and \\\\x09-\\\\x0D. A word is removed if a window of ``window``
    consecutive words of its document covers it whose words also begin earlier: in a document of smaller identifier, or
    earlier in the same one. Windows are judged on the input. ``kept_text`` joins the other words by one blank;
    ``factors`` lists the duplicate spans (start and length in words, and the row number and word where the
    earlier text begins; a factor that overlaps the one before starts at its first window). A null text has no
    words. Rows that share an identifier, or have none, are ordered after each other, null last.
    """
    if window < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words at least")
    document_batches(docs.sparkSession)
    docs = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    rows = docs.select(F.col(ROW).alias("doc"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(docs.sparkSession.sparkContext.defaultParallelism, size // 36 // BLOCK)
    copies = stored_alone(lambda: merge_runs(rows, "doc", "text", keep="smallest").where("NOT kept").select(
        "doc", F.col("keep_id").alias("copy_of")), "copies")

    shared = _shared_anchors(rows, window, blocks)
    found = _windows(rows.join(copies, "doc", "left_anti").join(shared, "doc"), window, blocks)
    parts = found.groupBy("doc").agg(F.collect_list(F.struct("start", "count", "source", "source_start")).alias("parts"))
    extra = parts.withColumn("copy_of", F.lit(None).cast("bigint")).unionByName(
        copies.withColumn("parts", F.lit(None).cast(parts.schema["parts"].dataType)))
    done = _spans(docs.join(extra, docs[ROW] == extra["doc"], "left"), window)
    return done.withColumnRenamed("id", id_col)
