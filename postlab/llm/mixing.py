"""Mix sources to target weights, in DataFrame operations only.

1. Words are counted; every source gets a target number of words from its weight.
2. The words of a source, document after document in a hashed order, are packed into blocks of a fixed length.
3. A source gets as many slots as reach its target. The slots are thrown at the output shards, so the numbers of
   slots that a source has in the shards are a multinomial draw whose sum is fixed: the mix meets the targets
   and not only in the mean.
4. The slots of a source, numbered shard after shard, run through a pseudorandom permutation of its
   block indices, a new one for each pass over the source; a block is used again only after all others.
5. Slots and blocks are joined by (source, block index). A document's words are what its pieces of blocks give.

All draws are arithmetic on identifiers, so a second run gives the same mix however the tables are split. The
sums that run along a source are computed in levels of at most ``FAN`` entries, so no source is one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlab.session import stored

# ---- fixed values -----------------------------------------------------------------------------------------
WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
PRIME = 2147483647
FACTORS = (1103515245, 1013904223, 69621)
# ---- end of fixed values ----------------------------------------------------------------------------------
#: The table of sources, with the keys of its permutations, is broadcast and numbered in one task, so its size is bounded.
MAX_SOURCES = 20_000
#: Entries of a running sum that one task adds up, and slots that one row stands for before they are dealt out.
FAN = 1024
#: Documents of a source that share a running sum, on average over all sources.
GROUP_ROWS = 64
ROUNDS = 20
#: Slots of a task that permutes them.
PART_SLOTS = 1 << 17


def mixed(x: Column, salt: Column) -> Column:
    """A pseudorandom number from 0 to ``PRIME`` - 1. Plain arithmetic, so any SQL engine gives the same."""
    first = F.pmod(x + salt * 1000003, F.lit(PRIME)).cast("bigint")
    return F.aggregate(
        F.array(*[F.lit(k).cast("bigint") for k in FACTORS]), first, lambda y, k: (y * y + k * y + 11) % PRIME)


def round_keys(size: Column, salt: Column, rounds: int = ROUNDS) -> Column:
    """What the rounds of a permutation of 0 … size - 1 need: per round the sum of mirror images and a number."""
    def key(r: Column) -> Column:
        number = mixed(r, salt)
        return F.struct(
            F.pmod(number * PRIME + mixed(r + rounds, salt), size).alias("sum"), number.alias("number"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(rounds - 1).cast("bigint")), key)


def permuted(x: Column, size: Column, keys: Column) -> Column:
    """A permutation of 0 … size - 1, by swap-or-not rounds: x meets its mirror image, one bit decides for both."""
    def turn(at: Column, key: Column) -> Column:
        mirror = F.pmod(key["sum"] - at, size)
        spread = (F.greatest(at, mirror) % PRIME * FACTORS[0] + key["number"]) % PRIME
        return F.when(spread * spread % PRIME % 2 == 1, mirror).otherwise(at)

    return F.aggregate(keys, x.cast("bigint"), turn)


def starts(totals: DataFrame, keys: list[str], index: str, value: str, size: int) -> DataFrame:
    """Add ``start``: the sum of ``value`` over the smaller indices (0 … size - 1, unique) of the same keys."""
    order = Window.orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    if size <= FAN:
        return totals.withColumn("start", F.coalesce(F.sum(value).over(order.partitionBy(*keys)), F.lit(0)))
    upper = f"{index}_above"
    fine = totals.withColumn(upper, F.floor(F.col(index) / FAN))
    coarse = starts(fine.groupBy(*keys, upper).agg(F.sum(value).alias(value)), keys, upper, value, -(-size // FAN))
    inner = F.coalesce(F.sum(value).over(order.partitionBy(*keys, upper)), F.lit(0))
    return (
        fine.withColumn("inner", inner)
        .join(coarse.select(*keys, upper, F.col("start").alias("base")), [*keys, upper])
        .withColumn("start", F.col("base") + F.col("inner")).drop(upper, "inner", "base")
    )


def targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, src, source_size, target) of a table (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn. Targets share the sum of all sizes
    by weight, none above ``most`` times its source's size; what is cut off goes to the others by weight.
    If sources are ordered by ``most * size / weight``, the cut ones are the first of them, so one pass of
    running sums finds the level at which the others share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("src", F.row_number().over(by_name).cast("bigint")).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("top", F.col("source_size") * most)
    order = Window.orderBy(F.col("top") / F.col("weight"), "src")
    everything = Window.partitionBy()
    share = (
        F.sum("source_size").over(everything)
        - F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).cast("double") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    shared = numbered.withColumn("share", share).withColumn(
        "level", F.when(F.col("share") * F.col("weight") <= F.col("top"), F.struct(F.col("top") / F.col("weight"), "src", "share")))
    level = F.min("level").over(everything)["share"]
    return shared.select(
        "source", "src", "source_size",
        F.least(F.col("top").cast("double"), level * F.col("weight")).alias("target"))


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               row: Column | None = None) -> DataFrame:
    """(id, source, size, row), written once; ``row`` tells rows of equal identifiers apart. A null text has size 0."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    row = F.monotonically_increasing_id() if row is None else row
    return stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), row.alias("row")), "sizes")


class Mix:
    """A mix over a table of ``word_sizes``: ``sources``, ``slots``, ``pieces`` and their join ``taken``."""

    def __init__(self, sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, block: int = 64,
                 shard_slots: int = 4096, seed: int = 1):
        self.sizes, self.block, self.seed = sizes, block, seed
        totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        sources = stored(totals, "sources")
        found = sources.agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("n_docs")).head()
        if found[0] > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.n_groups = max(1, -(-(found[2] or 0) // GROUP_ROWS))
        self.n_shards = max(1, -(-(found[1] or 0) // (block * shard_slots)))
        self.n_parts = max(sizes.sparkSession.sparkContext.defaultParallelism, (found[1] or 0) // (block * PART_SLOTS))
        n_blocks = F.ceil(F.col("source_size") / block)
        # blocks hold source_size / n_blocks words on average
        n_slots = F.when(F.col("source_size") > 0, F.round(n_blocks * F.col("target") / F.col("source_size"))).otherwise(0)
        self.sources = targets(sources.drop("n_docs"), weights, most).select(
            "*", n_blocks.cast("bigint").alias("n_blocks"), n_slots.cast("bigint").alias("n_slots"))
        self.with_source = sizes.join(
            F.broadcast(self.sources), sizes["source"].eqNullSafe(self.sources["source"])
        ).select("id", sizes["source"], "size", "row", "src", "source_size", "target")

    @property
    def counts(self) -> DataFrame:
        """(src, shard, n): how many slots each source has in each shard."""
        last = F.floor((F.col("n_slots") - 1) / FAN)
        chunks = self.sources.where("n_slots > 0").select(
            "src", "n_slots", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk")
        ).repartition(F.col("src"), F.col("chunk"))
        thrown = chunks.select("src", F.explode(F.sequence(
            F.col("chunk") * FAN, F.least((F.col("chunk") + 1) * FAN, F.col("n_slots")) - 1)).alias("j"))
        shard = mixed(F.col("j"), F.col("src") * 7 + self.seed) % self.n_shards
        return thrown.groupBy("src", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))

    @property
    def slots(self) -> DataFrame:
        """(shard, src, j, turn, block): the block index of each slot; j numbers a source's slots through the shards."""
        placed = starts(self.counts, ["src"], "shard", "n", self.n_shards)
        # the rows are few until they are exploded: without a number of partitions they would meet in one task
        spread = placed.repartition(self.n_parts, "src", "shard")
        numbered = spread.select("shard", "src", F.explode(
            F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("j"))
        n = F.col("n_blocks")
        turns = self.sources.where("n_slots > 0").withColumn("turn", F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_slots") - 1) / n))))
        keys = round_keys(n, F.col("src") * 1009 + F.col("turn") * 31 + self.seed)
        passes = F.broadcast(turns.select("src", "n_blocks", "n_slots", "turn", keys.alias("keys")))
        return numbered.join(F.broadcast(self.sources.select("src", "n_blocks")), "src").withColumn(
            "turn", F.floor(F.col("j") / n)
        ).drop("n_blocks").join(passes, ["src", "turn"]).select(
            "shard", "src", "j", "turn", permuted(F.col("j") % n, n, F.col("keys")).alias("block"))

    @property
    def pieces(self) -> DataFrame:
        """(src, block, row, id, first, n_words): the words of a document, from ``first``, that lie in a block."""
        whole = self.sizes.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
        number = F.coalesce(F.col("id").cast("bigint"), F.lit(-1)) if whole else F.xxhash64("id")
        order = F.pmod(number, F.lit(PRIME))
        placed = self.with_source.where("size > 0").withColumn(
            "grp", mixed(order, F.lit(self.seed + 3)) % self.n_groups)
        totals = placed.groupBy("src", "grp").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("src", "grp").orderBy("id", "row").rowsBetween(Window.unboundedPreceding, -1)
        begin = F.col("start") + F.col("inside")
        at, end = F.col("at"), F.col("at") + F.col("size")
        lower = F.greatest(at, F.col("block") * self.block)
        return (
            placed.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
            .join(starts(totals, ["src"], "grp", "words", self.n_groups).drop("words"), ["src", "grp"])
            .select("src", "row", "id", "size", begin.alias("at"))
            .withColumn("block", F.explode(F.sequence(
                F.floor(at / self.block), F.floor((end - 1) / self.block))))
            .select("src", "block", "row", "id", (lower - at).alias("first"),
                    (F.least(end, (F.col("block") + 1) * self.block) - lower).alias("n_words"))
        )

    @property
    def taken(self) -> DataFrame:
        """(shard, src, j, turn, block, row, id, first, n_words): the pieces of the block in each slot."""
        return self.slots.join(self.pieces, ["src", "block"])

    def per_row(self) -> DataFrame:
        """(id, source, size, source_size, target, taken, row) of every row."""
        sums = self.taken.groupBy("row").agg(F.sum("n_words").alias("taken"))
        return self.with_source.join(sums, "row", "left").select(
            "id", "source", "size", "source_size", "target",
            F.coalesce(F.col("taken"), F.lit(0)).cast("bigint").alias("taken"), "row")


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                **settings) -> DataFrame:
    """The mix as rows of ``docs``: a row for each time that words of a document are used, with the words used then.

    A document is used at most ``most`` times. Where all its words are used, its text is unchanged; else the
    pieces that are used follow each other in their order, cut before the white space of a word.
    """
    whole = stored(docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("tag")), "mixed")
    text = F.col("doc").getField(text_col)
    named = whole.select(
        F.col("doc").getField(id_col).alias("id"), text.alias("text"),
        F.col("doc").getField(source_col).alias("source"), "tag")
    mix = Mix(word_sizes(named, "id", "text", "source", F.col("tag")), **settings)
    used = mix.taken.groupBy(F.col("row").alias("tag"), "turn").agg(F.array_sort(F.collect_list(F.struct("first", "n_words"))).alias("parts"))
    words = F.regexp_extract_all(text, F.lit(SPACED_WORD), 0)
    cut = F.array_join(F.flatten(F.transform(
        "parts", lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["n_words"].cast("int")))), "")
    count = F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["n_words"])
    new = F.when(count == F.regexp_count(text, F.lit(WORD)), text).otherwise(cut)
    kept = [new.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return whole.join(used, "tag").select(*kept)
