"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every row goes to one of many small runs. A run is a sorted list of distinct entries (digest, identifier that stays, size of
the group), kept as pieces of a few hundred entries: the pieces of a run after round r are named by the first r hexadecimal
digits of the digest, so that they in order are the run, and no piece grows while the runs do. Runs meet in binomial rounds of
16: in round r those meet whose numbers agree but for their r-th digit in base 16. Each splits its pieces by the next digit of
the digest and sends them to the run that results, where the sorted pieces of equal name are merged, and of each stretch of
equal entries the one that stays goes on with the sum of the sizes. In the end one run is left, its pieces spread over all
tasks. On the way back every run takes the final identifier from the run it went into. A group of any size reaches a task as
one entry per run at most, or as the rows of one first run, so no group of copies makes a task large.

Two texts count as equal if SHA-256, length in bytes and a second, independent 64-bit hash agree; the three
are compared together in every merge.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.session import stored, stored_alone

KEY = ["digest", "n_bytes", "second"]
ENTRY = [*KEY, "missing", "id", "row"]
#: Runs that meet in a round: one hexadecimal digit of the run number, and one of the digest for the pieces.
MEET = 16


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def _fingerprint(text: Column) -> list[Column]:
    value = _text(text)
    return [F.unhex(F.sha2(value, 256)).alias("digest"), F.octet_length(value).alias("n_bytes"),
            F.xxhash64(value).alias("second")]


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(reduce(and_, [a[k] == b[k] for k in KEY]), F.lit(False))


def _digit(digest: Column, place: int) -> Column:
    """One hexadecimal digit of a digest, counted from 0."""
    return F.substring(F.hex(F.substring(digest, place // 2 + 1, 1)), place % 2 + 1, 1)


def _merge(pieces: DataFrame, keep: str) -> DataFrame:
    """(run, piece, entries): the sorted lists of each piece merged, with one entry for equal ones.

    ``pieces`` has (run, piece, lists); the sort of lists that are sorted in themselves only merges them.
    """
    found = F.col("found")
    sorted_ = pieces.select("run", "piece", F.sort_array(F.flatten("lists")).alias("found"))
    starts = sorted_.withColumn("starts", F.filter(
        F.sequence(F.lit(0), F.size(found) - 1), lambda i: ~_same(F.get(found, i), F.get(found, i - 1))))

    def one(at: Column, number: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), number + 1), F.size(found))
        best = F.get(found, end - 1 if keep == "largest" else at)
        n = F.aggregate(F.slice(found, at + 1, end - at), F.lit(0).cast("bigint"), lambda total, e: total + e["n"])
        return F.struct(*[best[name].alias(name) for name in ENTRY], n.alias("n"))

    return starts.select("run", "piece", F.transform("starts", one).alias("entries"))


def first_runs(rows: DataFrame, keep: str) -> DataFrame:
    """(run, piece, entries) of rows (run, digest, n_bytes, second, missing, id, row): each run is one piece."""
    entry = F.struct(*ENTRY, F.lit(1).cast("bigint").alias("n"))
    return _merge(rows.groupBy("run").agg(F.collect_list(entry).alias("entries")).select(
        "run", F.lit("").alias("piece"), F.array("entries").alias("lists")), keep)


def meet(runs: DataFrame, place: int, keep: str) -> DataFrame:
    """Round ``place``, from 0 on: runs whose numbers agree but for the last digit become one."""
    digits = F.array(*[F.lit(f"{d:X}") for d in range(MEET)])
    split = runs.select(
        F.floor(F.col("run") / MEET).alias("run"), "piece",
        F.explode(F.transform(digits, lambda d: F.struct(
            d.alias("digit"), F.filter("entries", lambda e: _digit(e["digest"], place) == d).alias("entries")))).alias("part"))
    return _merge(
        split.where(F.size("part.entries") > 0)
        .groupBy("run", F.concat("piece", "part.digit").alias("piece"))
        .agg(F.collect_list("part.entries").alias("lists")), keep)


def merge_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
               run_rows: int = 256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the identifier that stays, ``smallest`` or ``largest``. A null text counts as empty. A null
    identifier stays only if its group has no other. Of rows that repeat identifier and text exactly one is
    kept. ``run_rows`` is the mean number of rows of a first run.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    rows = stored(docs.select(
        F.col(id_col).alias("id"), *_fingerprint(F.col(text_col)),
        F.monotonically_increasing_id().alias("row"),
    ), "digests")
    runs = max(1, -(-rows.count() // run_rows))
    known = F.col("id").isNotNull()
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs))).withColumn(
        "missing", known if keep == "largest" else ~known)

    level = stored(first_runs(rows, keep), "run")
    levels = [level]
    while runs > 1:
        level = stored(meet(level, len(levels) - 1, keep), "run")
        runs = -(-runs // MEET)
        levels.append(level)

    # an entry that met no equal one is its own answer, so only groups of several rows are sent down
    entries = [one.select("run", F.inline("entries")) for one in levels]
    answer = entries.pop().select("run", *KEY, F.struct("id", "row").alias("entry"), "n").where("n > 1")
    while entries:
        child = entries.pop().select(F.col("run").alias("child"), F.floor(F.col("run") / MEET).alias("run"), *KEY)
        answer = child.join(answer, ["run", *KEY]).select(F.col("child").alias("run"), *KEY, "entry", "n")
    own = F.struct("id", "row")
    found = rows.join(answer, ["run", *KEY], "left").withColumn("entry", F.coalesce("entry", own))
    return found.select(
        F.col("id").alias(id_col), F.col("entry.id").alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        (F.col("row") == F.col("entry.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                **sizes: int) -> DataFrame:
    """The rows of ``docs`` that ``merge_runs`` keeps, with all their columns."""
    kept = stored_alone(lambda: merge_runs(docs, id_col, text_col, keep, **sizes).where("kept").select(
        F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")), "kept")
    # one struct column, so that names in ``docs`` cannot clash with the two keys
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_id"),
        F.sha2(_text(F.col(text_col)), 256).alias("_sha"))
    same = F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha"))
    return whole.join(kept, same, "left_semi").dropDuplicates(["_id", "_sha"]).select("_doc.*")
