"""Repeated runs of lines, by prefix doubling over line-ID sequences, in DataFrame functions only.

Every document is a sequence of line ids (hashes of its lines; blank lines have none), and every position begins a
suffix of its document's sequence. Prefix doubling ranks suffixes by their first 1, 2, 4, … lines: the rank of 2h lines is
that of the pair of ranks of the two halves. Ranks ascend as suffixes do, so suffixes of equal rank are an interval of
the suffix array, in which the longest common prefix reaches that depth. Suffixes that are alone at a depth leave, as
nothing that begins there is repeated at a greater one. A depth between two powers is ranked by the power below it and what
is left. ``suffix_array`` gives the order and, for each suffix, the longest common prefix with the one before it.

In an interval all suffixes but the first by document and line begin a later copy. A window of at least ``min_words``
words that is a later copy is deleted. Ranking ends at the depth of ``min_words`` lines: a line has a word at least, so
a longer window consists of windows of that depth that are later copies themselves, with words enough. All depths up to
there are looked at, so a run of any length goes if it has the words. Windows with copies that follow each other are
joined to maximal runs (``runs``). The first copy of a line always stays, and so does a line that is repeated
alone but has fewer words.

A document all of whose lines are later copies stays, with an empty text. Lines are compared without the blanks around
them. Null texts stay null; ids are of any type, null ids come first, and rows with the same id follow each other by their
texts' hashes. Other columns are kept as they are, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import lookup

MIN_WORDS = 5
#: Columns of a window: document and dense position, lines in the text that it spans, words, its interval's rank and first position.
WINDOW = ["d", "pos", "at", "last", "words", "rank", "fd", "fpos"]


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """Adds a unique long integer that ascends with ids: the id itself where ids are unique integers, else one that is stored."""
    rows, ids = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).head()
    if rows == ids and docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    tie = common.free_name(docs, "tie")
    hashed = docs.withColumn(tie, F.xxhash64("text"))
    spread = hashed.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return common.stored(spread.drop(tie).withColumn(name, F.monotonically_increasing_id()), "numbered")


def lines(docs: DataFrame, key: str) -> DataFrame:
    """(d, pos, at, words, h1, h2) of each line that isn't blank: pos counts those, at all lines; h1 and h2 are the line's id."""
    cut = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line")))
    rows = docs.select(F.col(key).alias("d"), F.posexplode(F.filter(cut, lambda x: x["line"] != "")).alias("pos", "item"))
    line = F.col("item.line")
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return rows.select("d", "pos", F.col("item.at").alias("at"), words.alias("words"), F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def _ranked(rows: DataFrame, of: list[str], total: int, name: str) -> DataFrame:
    """The rows whose ``of`` occurs more than once, with its rank and the first position that has it.

    Distinct values alone are sorted, so a value that very many rows have is one row of the sort.
    """
    place = F.min(F.struct("d", "pos"))
    found = rows.groupBy(*of).agg(F.count("*").alias("n"), place.alias("first")).where("n > 1")
    found = found.repartitionByRange(*of).sortWithinPartitions(*of).withColumn("_rank", F.monotonically_increasing_id())
    found = common.stored(found.select(*of, "_rank", F.col("first.d").alias("_fd"), F.col("first.pos").alias("_fpos"), "n"), name + "-ranks")
    out = lookup(rows, found, of, "n", total, "inner").drop("rank", "fd", "fpos")
    return common.stored(out.withColumnsRenamed({"_rank": "rank", "_fd": "fd", "_fpos": "fpos"}).select(*WINDOW), name)


def windows(docs: DataFrame, key: str, min_words: int = MIN_WORDS) -> dict[int, DataFrame]:
    """For each number of lines up to ``min_words``, the windows of so many that are repeated."""
    rows = common.stored(lines(docs, key).withColumn("last", F.col("at")), "lines")
    total = rows.count()
    found = {1: _ranked(rows, ["h1", "h2"], total, "windows-1")}
    # two lines at least, for the blank lines between them
    for size in range(2, max(2, min_words) + 1):
        half = 1 << (size - 1).bit_length() - 1
        rest = found[size - half].select("d", (F.col("pos") - half).alias("pos"), F.col("last").alias("_last"), F.col("words").alias("_words"), F.col("rank").alias("rank_2"))
        pairs = found[half].withColumnRenamed("rank", "rank_1").join(rest, ["d", "pos"])
        pairs = pairs.withColumn("last", F.col("_last")).withColumn("words", F.col("words") + F.col("_words")).drop("_last", "_words")
        found[size] = _ranked(common.stored(pairs, f"pairs-{size}"), ["rank_1", "rank_2"], total, f"windows-{size}")
    return found


def _later(levels: dict[int, DataFrame], min_words: int) -> DataFrame:
    """(d, at, last, fd, shift) of the windows that are later copies; shift is how far the first copy is from them."""
    later = [x.where((F.col("words") >= min_words) & ((F.col("fd") != F.col("d")) | (F.col("fpos") != F.col("pos")))) for x in levels.values()]
    out = later[0]
    for x in later[1:]:
        out = out.unionByName(x)
    return out.select("d", "at", "last", "fd", (F.col("fpos") - F.col("pos")).alias("shift"))


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """Ranges (at, last) of each ``by``, with those that touch joined."""
    order = W.partitionBy(*by).orderBy("at", "last")
    reach = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.coalesce(F.col("at") > reach + 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("range", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "range").agg(F.min("at").alias("at"), F.max("last").alias("last")).drop("range")


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(document, first_line, last_line, copied_from): maximal runs of lines that a document repeats from one place."""
    docs = numbered(docs, key := common.free_name(docs, "number"))
    found = _merged(_later(windows(docs, key, min_words), min_words), ["d", "fd", "shift"])
    return found.select(F.col("d").alias("document"), F.col("at").alias("first_line"), F.col("last").alias("last_line"), F.col("fd").alias("copied_from"))


def suffix_array(docs: DataFrame, depth: int = MIN_WORDS) -> DataFrame:
    """(document, line, rank, lcp) of all suffixes whose first line is repeated, to a depth of ``depth`` lines.

    ``rank`` sorts them by their first lines, as far as those are repeated, and then by document and line; ``lcp`` is how
    many first lines a suffix shares with the one before it. Both count to ``depth`` at most.
    """
    docs = numbered(docs, key := common.free_name(docs, "number"))
    levels = windows(docs, key, depth)
    rows = levels[1].select("d", "pos", "at", F.col("rank").alias("rank_1"))
    for size in range(2, depth + 1):
        rows = rows.join(levels[size].select("d", "pos", F.col("rank").alias(f"rank_{size}")), ["d", "pos"], "left")
    ranks = [f"rank_{size}" for size in range(1, depth + 1)]
    # suffixes share no line with those of another first line, so each first line's may be sorted by itself
    order = W.partitionBy("rank_1").orderBy(*(F.col(r).asc_nulls_first() for r in ranks[1:]), "d", "pos")
    lcp = F.lit(0)
    for r in reversed(ranks):
        lcp = F.when(F.lag(r).over(order) == F.col(r), 1 + lcp).otherwise(0)
    return rows.select(F.col("d").alias("document"), F.col("at").alias("line"), F.struct(*ranks, "d", "pos").alias("rank"), lcp.alias("lcp"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, report: str | None = None) -> DataFrame:
    """``docs`` without the lines that are later copies; ``report`` names a column for the ranges of lines deleted."""
    columns = docs.columns
    docs = numbered(docs, key := common.free_name(docs, "number"))
    gone = _merged(_later(windows(docs, key, min_words), min_words).select("d", "at", "last").distinct(), ["d"])
    name = common.free_name(docs, report or "deleted")
    gone = gone.groupBy(F.col("d").alias(key)).agg(F.array_sort(F.collect_list(F.struct("at", "last"))).alias(name))
    rows = docs.join(gone, key, "left")
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(name)))
    return rows.withColumn("text", text).select(*columns, *([name] if report else []))


def without(text: Column, ranges: Column) -> Column:
    """``text`` without the lines of ``ranges``."""
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.exists(ranges, lambda r: i.between(r["at"], r["last"])))
    return F.array_join(kept, "\n")


SQL = """
with numbered as (
  select doc_id, ln - 1 as ln, trim(line, ' ') as line
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as ln from documents)
), sequences as (
  select *, row_number() over (partition by doc_id order by ln) as pos, length(line) - length(replace(line, ' ', '')) + 1 as words
  from numbered where line <> ''
), spans as (
  select doc_id, ln, list(line) over w as run, list(words) over w as words, list(ln) over w as lns
  from sequences window w as (partition by doc_id order by pos rows between current row and 7 following)
), cut as (
  -- every number of lines up to 8; five lines have the five words that a longer run's windows need
  select size, doc_id, ln, list_slice(run, 1, size) as run, list_sum(list_slice(words, 1, size)) as words, lns[size] as last_ln
  from spans, range(1, 9) sizes(size) where len(run) >= size
), placed as (
  select *, row_number() over (partition by size, run order by doc_id, ln) as copy from cut
), gone as (
  select distinct doc_id, unnest(range(ln, last_ln + 1)) as ln from placed where copy > 1 and words >= 5
)
select d.doc_id, count(*) as n_lines, count(g.ln) as n_deleted,
  coalesce(string_agg(l.raw, chr(10) order by l.ln) filter (where g.ln is null), '') as text
from documents d
join (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(0, len(string_split(text, chr(10))))) as ln from documents) l on l.doc_id = d.doc_id
left join gone g on g.doc_id = l.doc_id and g.ln = l.ln
group by d.doc_id
"""
