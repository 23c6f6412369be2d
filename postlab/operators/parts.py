"""Looking up the words of whole documents without sending any token through a shuffle by word.

Documents are dealt out to parts by their key, once, as rows. A part's distinct words are joined with the word table and their values
come back to the part; there every token finds its value by position in an Arrow array. What is moved is each document once and each
word once per part, never a row per token and never a vector per token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from postlab.session import stored, stored_by

#: Tokens of a part, about: a task holds the texts of one part. A word is sent once to every part that has it.
PART_TOKENS = 8_000_000
#: Tokens of a part that are looked up at once, about; the documents of a key stay together.
WORK_TOKENS = 1_000_000
#: Documents that are stored by part are taken in so many rounds at most, a task's part for each core at least: a round's words lie on disk at once.
ROUNDS = 4
#: Tokens whose vectors are added up at once.
SLICE_TOKENS = 65536
#: Stands between the tokens of a document on its way.
_BETWEEN = "\x1f"


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number per distinct value, null included."""
    encoded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    return encoded.indices.to_numpy(zero_copy_only=False).astype("int64")


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; a sort is many times faster here than the hashing of ``np.unique``."""
    numbers = np.sort(numbers)
    return numbers[np.r_[True, numbers[1:] != numbers[:-1]]] if len(numbers) else numbers


def tallied(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and how often each occurs."""
    numbers = np.sort(numbers)
    first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, dtype="int64")
    return numbers[first], np.diff(np.r_[first, len(numbers)])


def flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The entries of all lists one after the other, and the length of each list; a null list has none."""
    whole = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype("int64")
    return whole.flatten(), sizes


def _packed(docs: DataFrame, tokens: str) -> DataFrame:
    """The tokens of a document as one text, ``_line``, which takes half the room of an array on its way.

    Documents that a text cannot tell apart keep their array: those without tokens, with a null among them, or with the
    separator in a token. The others have an empty one, not null: for every row Spark's Arrow writer goes over all null lists before it.
    """
    unsafe = (F.size(tokens) < 1) | F.exists(tokens, lambda w: w.isNull() | w.contains(_BETWEEN))
    return docs.withColumn("_line", F.when(unsafe, None).otherwise(F.array_join(tokens, _BETWEEN))).withColumn(
        tokens, F.when(F.col("_line").isNull(), F.col(tokens)).otherwise(F.array().cast(docs.schema[tokens].dataType)))


def _unpacked(lines: pa.Array, lists: pa.Array) -> pa.Array:
    """The tokens of each document, from its text if it has one."""
    if lines.null_count == len(lines):
        return lists
    return pc.if_else(lines.is_valid(), pc.split_pattern(lines, _BETWEEN).cast(lists.type), lists)


def _whole(tokens: str) -> Column:
    """The tokens of a document that ``_packed`` may have made a text."""
    return F.when(F.col("_line").isNull(), F.col(tokens)).otherwise(F.split("_line", _BETWEEN))


def n_parts(spark: SparkSession, n_tokens: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n_tokens // PART_TOKENS))


@dataclass(frozen=True)
class Dealt:
    """Documents that are stored by part: (_part, keys, tokens, columns, _line). Whoever looks their words up moves none of them.

    ``part`` is the part of a row with these keys, ``parts`` the number of buckets, ``names`` the parts that are meant. ``counts``
    (_part, word, n, df) are the words of each part, how often they occur and in how many rows: the tokens are read once for them.
    """

    frame: DataFrame
    keys: list[str]
    tokens: str
    part: Column
    parts: int
    names: tuple[int, ...]
    counts: DataFrame

    @property
    def docs(self) -> DataFrame:
        """The documents as they were."""
        return self.frame.withColumn(self.tokens, _whole(self.tokens)).drop("_part", "_line")

    def rounds(self) -> list[Dealt]:
        """All parts, some at a time."""
        size = max(self.frame.sparkSession.sparkContext.defaultParallelism, -(-len(self.names) // ROUNDS))
        some = [self.names[i:i + size] for i in range(0, len(self.names), size)]
        return [replace(self, frame=self.frame.where(F.col("_part").isin(*names)), names=names) for names in some]


def own_names(spark: SparkSession, parts: int) -> list[int]:
    """A name for each of so many buckets, else the hash puts several parts into one and leaves others empty."""
    tried = spark.range(40 * parts).select(F.col("id").cast("int").alias("name"))
    return sorted(r["name"] for r in tried.groupBy(F.pmod(F.hash("name"), F.lit(parts))).agg(F.min("name").alias("name")).collect())


def deal(docs: DataFrame, keys: list[str], n_tokens: int, tokens: str = "tokens") -> Dealt:
    """Store ``docs`` by part; ``n_tokens`` is about the number of their tokens."""
    spark = docs.sparkSession
    parts = n_parts(spark, n_tokens)
    names = own_names(spark, parts)
    part = F.element_at(F.lit(names), F.pmod(F.xxhash64(*keys), F.lit(len(names))).cast("int") + 1).alias("_part")
    others = [c for c in docs.columns if c not in keys and c != tokens]
    packed = _packed(docs.select(part, *keys, tokens, *others), tokens)
    frame = stored_by(packed, parts, "_part", "parts")
    return Dealt(frame, keys, tokens, part, parts, tuple(names), stored(_part_counts(frame, tokens), "words"))


def _part_counts(frame: DataFrame, tokens: str) -> DataFrame:
    """(_part, word, n, df) of packed documents that are stored by part."""
    def merged(some: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(some).group_by("word").aggregate([("n", "sum"), ("df", "sum")])
        return found.select(["word", "n_sum", "df_sum"]).rename_columns(["word", "n", "df"])

    def counted(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            entries, sizes = flat(pa.chunked_array([_unpacked(batch.column("_line"), batch.column(tokens))]))
            code, words = _encoded(entries)
            row = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
            code, n_words = code[code >= 0], max(1, len(words))
            pairs = distinct(row * n_words + code)
            held.append(pa.table({"word": words, "n": np.bincount(code, minlength=len(words)),
                                  "df": np.bincount(pairs % n_words, minlength=len(words))}))
            if sum(map(len, held[1:])) > max(len(held[0]), SLICE_TOKENS):
                held = [merged(held)]
        whole = merged(held)
        for start in range(0, len(whole), SLICE_TOKENS):
            cut = whole.slice(start, SLICE_TOKENS).combine_chunks()
            part = pa.array(np.full(len(cut), key[0].as_py(), dtype="int32"))
            yield pa.RecordBatch.from_arrays([part, *(cut[c].chunk(0) for c in cut.column_names)], ["_part", *cut.column_names])

    some = frame.select("_part", tokens, "_line")
    return some.groupBy("_part").applyInArrow(counted, "_part int, word string, n bigint, df bigint")


@dataclass
class Matches:
    """The tokens of a part: ``row`` of the documents, ``pos`` from 0, ``word``, and ``at``, the row of the word table or -1.

    A word with several rows in the table gives several entries, as a join would. ``code`` is the place of a token's word among ``words``.
    """

    docs: pa.Table
    keys: list[str]
    row: np.ndarray
    pos: np.ndarray
    code: np.ndarray
    words: pa.Array
    at: np.ndarray
    table: pa.Table

    @cached_property
    def word(self) -> pa.Array:
        return self.words.take(pa.array(self.code))

    def value(self, name: str) -> pa.Array:
        """A column of the word table for every entry, null where the word is unknown."""
        return self.table[name].combine_chunks().take(pa.array(self.at, mask=self.at < 0))

    @cached_property
    def group(self) -> np.ndarray:
        """The number of each document's key: rows of the same key count together."""
        if len(self.keys) == 1:
            return _codes(self.docs[self.keys[0]])
        both = np.column_stack([_codes(self.docs[k]) for k in self.keys])
        return np.unique(both, axis=0, return_inverse=True)[1].reshape(-1)

    @cached_property
    def groups(self) -> int:
        return int(self.group.max(initial=-1)) + 1

    @cached_property
    def null_key(self) -> np.ndarray:
        """Documents with a null in their key, which meet nothing in a join on it."""
        found = np.zeros(len(self.docs), dtype=bool)
        for k in self.keys:
            found |= self.docs[k].is_null().to_numpy()
        return found

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the ``weights`` of the entries of each key."""
        return np.bincount(self.group[self.row], weights=weights, minlength=self.groups)

    def first_rows(self) -> np.ndarray:
        """The first document of each key."""
        return np.unique(self.group, return_index=True)[1]

    def in_order(self, rank: Callable[[], np.ndarray]) -> np.ndarray:
        """The entries by key, position, and, where there are several, by ``rank()`` of their values."""
        owner = self.group[self.row]
        if len(self.docs) == self.groups and len(self.table) == len(pc.unique(self.table["word"])):
            return np.argsort(owner, kind="stable")
        return np.lexsort((rank(), self.pos, owner))

    def keys_of(self, rows: np.ndarray) -> dict[str, pa.Array]:
        return {k: self.docs[k].combine_chunks().take(pa.array(rows)) for k in self.keys}


def matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors as rows of ``dim`` numbers, and where entries are missing, if any are; those are 0."""
    entries, sizes = flat(pa.chunked_array([vectors]))
    values = entries.cast("float64").to_numpy(zero_copy_only=False)
    if (sizes == dim).all() and not entries.null_count:
        return values.reshape(-1, dim), None
    filled, holes = np.zeros((len(sizes), dim)), np.ones((len(sizes), dim), dtype=bool)
    starts, there = np.cumsum(sizes) - sizes, entries.is_valid().to_numpy(zero_copy_only=False)
    for i, (start, size) in enumerate(zip(starts, np.minimum(sizes, dim))):
        own = slice(start, start + size)
        filled[i, :size], holes[i, :size] = np.where(there[own], values[own], 0.0), ~there[own]
    return filled, holes


def vector_sums(owner: np.ndarray, at: np.ndarray, vectors: np.ndarray, groups: int) -> np.ndarray:
    """The sum of the ``vectors`` at ``at`` for each owner."""
    total = np.zeros((groups, vectors.shape[1]))
    order = np.argsort(owner, kind="stable")
    owner, at = owner[order], at[order]
    for start in range(0, len(at), SLICE_TOKENS):
        some = owner[start:start + SLICE_TOKENS]
        first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
        total[some[first]] += np.add.reduceat(vectors[at[start:start + SLICE_TOKENS]], first, axis=0)
    return total


def _rows_of(words: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the rows of ``names`` that equal each of the ``words`` begin in the third array, and how many they are."""
    known = pc.unique(names).drop_null()
    of = pc.fill_null(pc.index_in(names, value_set=known, skip_nulls=True), len(known)).to_numpy(zero_copy_only=False).astype("int64")
    counts = np.r_[np.bincount(of, minlength=len(known))[:len(known)], 0]
    code = pc.fill_null(pc.index_in(words, value_set=known, skip_nulls=True), len(known)).to_numpy(zero_copy_only=False).astype("int64")
    return (np.cumsum(counts) - counts)[code], counts[code], np.argsort(of, kind="stable")


def _pairs(code: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For words given by number (-1: null) each meeting as two positions, and -1 beside a word that meets none."""
    first, times, order = (np.r_[x, 0] for x in rows)  # -1 takes the last
    place = np.arange(len(code))
    if (times <= 1).all():
        return place, np.where(times > 0, order[first], -1)[code]
    hits = times[code]
    if (hits <= 1).all():
        return place, np.where(hits > 0, order[first[code]], -1)
    place = np.repeat(place, np.maximum(hits, 1))
    ends = np.cumsum(np.maximum(hits, 1))
    nth = np.arange(len(place)) - np.repeat(ends - np.maximum(hits, 1), np.maximum(hits, 1))
    return place, np.where(hits[place] > 0, order[first[code[place]] + nth * (hits[place] > 0)], -1)


def _encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each value among the distinct ones (-1: null), and those."""
    found = values.dictionary_encode()
    return pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False).astype("int64"), found.dictionary


def met(values: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ``values`` meets which of the ``names``: each pair as two positions, and -1 beside a value that meets none."""
    code, known = _encoded(values)
    return _pairs(code, _rows_of(known, names))


def _entries(docs: pa.Table, code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and word of each token; ``code`` has all tokens, and -1 for null."""
    row = np.repeat(np.arange(len(docs)), sizes)
    pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if (code < 0).any():
        place = np.flatnonzero(code >= 0)
        code, row, pos = code[place], row[place], pos[place]
    return row, pos, code


def _matched(docs: pa.Table, table: pa.Table, keys: list[str], tokens: str, words: pa.Array | None = None,
             rows: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
             entries: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Matches:
    """The matches of some documents; ``words``, ``rows`` (``_rows_of``) and ``entries`` (``_entries``) if they are known."""
    if words is None:
        values, sizes = flat(docs[tokens])
        code, words = _encoded(values)
        rows = _rows_of(words, table["word"].combine_chunks())
        entries = _entries(docs, code, sizes)
    row, pos, code = entries
    place, at = _pairs(code, rows)
    if len(place) > len(code):
        code, row, pos = code[place], row[place], pos[place]
    return Matches(docs, keys, row, pos, code, words, at, table)


def _coded(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_entries`` of documents that have their tokens' numbers as ``_codes``."""
    values, sizes = flat(docs["_codes"])
    return _entries(docs, values.to_numpy(zero_copy_only=False).astype("int64"), sizes)


def _nullable(made: pa.Table) -> pa.Table:
    """Lists that may not hold nulls as lists that may, which is what a schema text stands for."""
    def plain(kind: pa.DataType) -> pa.DataType:
        return pa.list_(plain(kind.value_type)) if pa.types.is_list(kind) else kind

    return made.cast(pa.schema([(f.name, plain(f.type)) for f in made.schema]))


def _short(table: DataFrame) -> DataFrame:
    """Vectors whose entries are whole in single precision go as such, in ``_single``: half the room, and nothing is lost."""
    if "vector" not in table.columns or table.schema["vector"].dataType.simpleString() != "array<double>":
        return table
    whole = F.coalesce(F.forall("vector", lambda x: x == x.cast("float").cast("double")), F.lit(False))
    return table.withColumn("_single", F.when(whole, F.col("vector").cast("array<float>"))).withColumn(
        "vector", F.when(~whole, F.col("vector")))


def _long(table: pa.Table) -> pa.Table:
    """The vectors of a word table in double precision again."""
    if "_single" not in table.column_names:
        return table
    single, vector = table["_single"].combine_chunks(), table["vector"].combine_chunks()
    there = single.is_valid()
    if "_whole" in table.column_names:
        there, table = pc.fill_null(table["_whole"].combine_chunks(), False), table.drop_columns("_whole")
    whole = single.cast(vector.type)
    if not pc.all(there, min_count=0).as_py():
        whole = pc.if_else(there, whole, vector)
    return table.set_column(table.schema.get_field_index("vector"), "vector", whole).drop_columns("_single")


def _united(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables, with ``_table``, the number of theirs. Vectors are ``_short``; lists that a row has not are empty
    instead of null (see ``_packed``), and ``_whole`` says which vectors are in single precision."""
    given = [_short(t).withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    kinds = {f.name: f.dataType for t in given for f in t.schema if isinstance(f.dataType, ArrayType)}
    united = None
    for t in given:
        if "_single" in t.columns:
            whole = F.col("_single").isNotNull()
            t = t.withColumn("_whole", whole).withColumns({
                "vector": F.when(whole, F.array().cast(kinds["vector"])).otherwise(F.col("vector")),
                "_single": F.coalesce("_single", F.array().cast(kinds["_single"]))})
        t = t.withColumns({name: F.array().cast(kind) for name, kind in kinds.items() if name not in t.columns})
        united = t if united is None else united.unionByName(t, allowMissingColumns=True)
    return united


def _slices(docs: pa.Table, keys: list[str], tokens: str) -> Iterator[pa.Table]:
    """The documents of a part by about ``WORK_TOKENS`` tokens; those of one key come together."""
    sizes = pc.fill_null(pc.list_value_length(docs[tokens]), 0).to_numpy().astype("int64")
    if sizes.sum() <= WORK_TOKENS:
        yield docs
        return
    empty = pa.table({}).schema
    group = Matches(docs, keys, sizes[:0], sizes[:0], sizes[:0], pa.array([], pa.string()), sizes[:0], empty.empty_table()).group
    own = np.bincount(group, weights=sizes).astype("int64")
    of = ((np.cumsum(own) - own) // WORK_TOKENS)[group]
    for i in np.unique(of):
        yield docs.take(pa.array(np.flatnonzero(of == i)))


def in_parts(docs: DataFrame | Dealt, keys: list[str], tables: list[DataFrame] | Callable[[DataFrame], list[DataFrame]],
             make: Callable[..., pa.Table], schema: str,
             tokens: str = "tokens", words: DataFrame | None = None, columns: tuple[str, ...] = (),
             beside: DataFrame | None = None) -> DataFrame:
    """What ``make`` gives for the documents of each part, with the rows of each of ``tables`` (word, values) that their tokens have.

    ``make`` gets the ``Matches`` of each table, whose documents have the keys, the tokens and ``columns``; what it returns has the
    columns of ``schema``. ``words`` is the vocabulary (word, n) of the documents; without it the tokens are counted. ``tables``
    may be a function that makes them from the documents as they are dealt out: (_part, keys, tokens), a key in one part only.
    ``make`` may be called several times for a part, for all documents of some keys each. The rows of ``beside``, which has the
    keys and more, go to the part of their key; ``make`` gets those of the whole part as a table, after the matches. For documents
    that are stored by part the words' values are stored by part too, so neither shuffle stands beside the result.
    """
    own = [tokens, *(c for c in columns if c != tokens)]
    known = docs if isinstance(docs, Dealt) else None
    if known:
        if keys != known.keys or tokens != known.tokens:
            raise ValueError("documents are dealt out by other columns")
        part, parts = known.part, known.parts
        dealt, docs = known.frame.select("_part", *keys, *own, "_line"), known.docs
    else:
        total = F.sum("n") if words is not None else F.sum(F.greatest(F.size(tokens), F.lit(0)))
        n_tokens = (words if words is not None else docs).agg(total.alias("n")).first()["n"] or 0
        parts = n_parts(docs.sparkSession, n_tokens)
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("_part")
        dealt = _packed(docs.select(part, *keys, *own), tokens).repartition(parts, "_part")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[pa.Array]] = {}
        for batch in batches:  # all columns come along: so Spark deals the documents out once and reads them twice
            entries, sizes = flat(pa.chunked_array([_unpacked(batch.column("_line"), batch.column(tokens))]))
            of = np.repeat(batch.column("_part").to_numpy(), sizes)
            for p in np.unique(batch.column("_part").to_numpy()):
                mine = entries if (of == p).all() else entries.filter(pa.array(of == p))
                some = found.setdefault(int(p), [])
                some.append(pc.unique(mine))
                if sum(map(len, some[1:])) > max(len(some[0]), SLICE_TOKENS):
                    some[:] = [pc.unique(pa.concat_arrays(some))]
        for p, some in found.items():
            held = pc.unique(pa.concat_arrays(some)).drop_null()
            for start in range(0, len(held), SLICE_TOKENS):
                cut = held.slice(start, SLICE_TOKENS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), p, dtype="int32")), cut], ["_part", "word"])

    if known:
        needed = known.counts.where(F.col("_part").isin(*known.names)).select("_part", "word")
    else:
        needed = dealt.mapInArrow(named, "_part int, word string")
    if callable(tables):
        tables = tables(dealt.withColumn(tokens, _whole(tokens)))
    united = _united(tables)
    values = needed.join(united, "word").select("_part", *united.columns)
    n_tables = len(tables)
    if beside is not None:
        same = beside.select(*[F.col(k).cast(docs.schema[k].dataType).alias(k) for k in keys],
                             *[c for c in beside.columns if c not in keys])
        rows = same.select(part, F.lit(n_tables).alias("_table"), F.struct(*same.columns).alias("_beside"))
        if known:
            rows = rows.where(F.col("_part").isin(*known.names))
        lists = {f.name: F.array().cast(f.dataType) for f in values.schema if isinstance(f.dataType, ArrayType)}
        values = values.unionByName(rows.withColumns(lists), allowMissingColumns=True)
    values = stored_by(values, parts, "_part", "values") if known else values.repartition(parts, "_part")

    def reduced(own: pa.Table, given: pa.Table) -> pa.Table:
        of = given["_table"].combine_chunks()
        more = []
        if "_beside" in given.column_names:
            more = [pa.Table.from_struct_array(given["_beside"].combine_chunks().filter(pc.equal(of, n_tables)))]
            given = given.drop_columns("_beside")
        found = [_long(given.filter(pc.equal(of, i))) for i in range(n_tables)]
        texts = _unpacked(own["_line"].combine_chunks(), own[tokens].combine_chunks())
        own = own.set_column(own.schema.get_field_index(tokens), tokens, texts).drop_columns("_line")
        entries, sizes = flat(own[tokens])
        code, words = _encoded(entries)
        rows = [_rows_of(words, t["word"].combine_chunks()) for t in found]
        ends = pa.array(np.r_[0, np.cumsum(sizes)].astype("int32"))
        own = own.append_column("_codes", pa.ListArray.from_arrays(ends, pa.array(code.astype("int32"))))
        return pa.concat_tables([
            _nullable(make(*[_matched(some, t, keys, tokens, words, r, entries) for t, r in zip(found, rows)], *more))
            for some in _slices(own, keys, tokens) for entries in [_coded(some)]])

    return dealt.groupBy("_part").cogroup(values.groupBy("_part")).applyInArrow(reduced, schema)


def lists(found: Matches, order: np.ndarray, values: pa.Array) -> pa.Array:
    """For each document the ``values`` of its key in this order of entries; an empty list without any, or with a null in the key."""
    sizes = np.bincount(found.group[found.row][order], minlength=found.groups)
    ends = np.r_[0, np.cumsum(sizes)].astype("int32")
    if not (order == np.arange(len(order))).all() or len(order) != len(values):
        values = values.take(pa.array(order))
    of_keys = pa.ListArray.from_arrays(pa.array(np.r_[ends, ends[-1:]]), values)  # the last one is empty
    if not found.null_key.any() and len(found.docs) == found.groups and (found.group == np.arange(found.groups)).all():
        return of_keys[:-1]
    return of_keys.take(pa.array(np.where(found.null_key, found.groups, found.group)))


def text_rank(values: pa.Array) -> np.ndarray:
    return pc.rank(values, tiebreaker="dense").to_numpy().astype("int64")


def fields(docs: DataFrame, names: list[str]) -> str:
    """The named columns of a frame as a schema text."""
    return ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
