"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A text's sketch is the set of all hashes of its word shingles that lie below a fixed fraction of the hash range. Unlike
a sketch of fixed size it grows with the text: sketches of very unequal documents stay comparable, and the share of one
sketch found in another estimates how much of one text the other contains. A text none of whose hashes is that small
has its smallest one as a stand-in, so that no text with words has an empty sketch. ``merge`` drops a stand-in
once it isn't needed, so the merged sketches of any texts are the sketch of all their shingles. With stand-ins, which only
texts of few shingles have, likeness of sketches is 1 or 0: whether the smallest hashes are equal. ``compare_with_edits``
has a containment beside it that is exact for those: where either sketch is a stand-in, it counts all shingles of both
texts, so a short passage that stands whole in a long text is contained in it.

Words are what white space separates, in lower case; a text of fewer words than a shingle is one shingle. Null and
empty texts have no shingles and the fingerprint "". Two texts without shingles have likeness 1, one with and one
without 0. Ids may be of any type that has an order; null ids sort first, repeated ids by their texts' hashes. Other
columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from . import common

SHINGLE = 5
#: One in so many hashes is kept, a power of two.
SCALE = 8
#: Documents that one bucket of neighbouring ids holds, roughly.
BUCKET_ROWS, BUCKETS = 2000, 100_000


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Adds the sketch of column ``text``: a sorted array of 48-bit hash values, ``name``.

    The words stand in a column that the shingles refer to more than once, which keeps the optimizer from working the
    words out again for each shingle.
    """
    w = f"{name}_words"
    zeros = scale.bit_length() - 1
    df = with_hashes(df, text, f"{name}_all", shingle, w)
    kept = f"filter({name}_all, h -> h < {1 << (48 - zeros)}L)"
    least = f"if(size({name}_all) = 0, array(), array(array_min({name}_all)))"
    df = df.withColumn(name, F.expr(f"array_sort(array_union({kept}, cast({least} as array<bigint>)))"))
    return df.drop(w, f"{name}_all")


def with_hashes(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, words_name: str = "_words") -> DataFrame:
    """Adds the hashes of all shingles of column ``text``, repeats included, and the column of its words."""
    w = words_name
    df = df.withColumn(w, F.filter(words(F.col(text)), lambda x: x != ""))
    grams = ", ".join(f"get({w}, i + {k})" for k in range(shingle))
    hashes = f"transform(if(size({w}) = 0, array(), sequence(0, greatest(size({w}) - {shingle}, 0))), i -> shiftrightunsigned(xxhash64({grams}), 16))"
    return df.withColumn(name, F.expr(f"cast({hashes} as array<bigint>)"))


def stands_in(sketch: Column, scale: int = SCALE) -> Column:
    """Whether a sketch is a stand-in: its one hash isn't below the threshold."""
    return (F.size(sketch) == 1) & (F.get(sketch, F.lit(0)) >= F.lit(1 << (48 - (scale.bit_length() - 1))))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of all shingles of two texts, from their sketches."""
    both = F.array_sort(F.array_union(a, b))
    kept = F.filter(both, lambda h: h < F.lit(1 << (48 - (scale.bit_length() - 1))))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the larger one has; 1 if neither has any."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise((F.size(a) == F.size(b)).cast("double"))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of both texts that they have in common; 1 if neither has any."""
    common_part = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common_part
    return F.when(every > 0, common_part / every).otherwise(F.lit(1.0))


def spelt(sketch: Column) -> Column:
    """12 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 12, "0"))), "")


def _edges(docs: DataFrame) -> list[str]:
    """First ids of the buckets, as text: some of the table's ids, the smallest among them, in ascending order.

    Quantiles are floating-point numbers, which do for cutting; each part's smallest id is then read as it is. Of ids
    that aren't integers, those with certain hashes begin buckets.
    """
    ids = docs.where("doc_id is not null").select(_key(docs).alias("id"))
    rows = ids.count()
    if not rows:
        return []
    n = max(1, min(BUCKETS, rows // BUCKET_ROWS))
    if ids.schema["id"].dataType != LongType():
        # about as many as buckets
        chosen = ids.where(F.pmod(F.xxhash64("id"), F.lit(-(-rows // n))) == 0) if n > 1 else ids.limit(0)
        chosen = chosen.unionByName(ids.agg(F.min("id").alias("id"))).distinct().orderBy("id")
        return [r["id"] for r in chosen.select(F.col("id").cast("string")).collect()]
    inner = sorted(set(ids.stat.approxQuantile("id", [k / n for k in range(1, n)], 1 / (5 * n)))) if n > 1 else []
    cuts = F.split(F.lit(",".join(map(repr, inner))), ",").cast("array<double>") if inner else F.array().cast("array<double>")
    rows = _placed(ids.select("id", cuts.alias("cuts")), "cuts", F.col("id").cast("double"), len(inner), "part")
    # as many rows as buckets
    return list(map(str, sorted(r["first"] for r in rows.groupBy("part").agg(F.min("id").alias("first")).collect())))


def _key(docs: DataFrame) -> Column:
    """The id as it is compared: a long if it is an integer, else as it stands."""
    return F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.col("doc_id")


def _placed(rows: DataFrame, edges: str, key: Column, n: int, name: str) -> DataFrame:
    """Adds how many of the ``n`` ascending values in column ``edges`` are up to ``key``, by binary search."""
    # a column for each step keeps the plan's expressions small
    rows, at = rows.withColumn(name, F.lit(0)), F.col(name)
    for k in reversed(range(max(1, n.bit_length()))):
        rows = rows.withColumn(name, F.when((at + (1 << k) <= n) & (F.get(edges, at + ((1 << k) - 1)) <= key), at + (1 << k)).otherwise(at))
    return rows


def with_next(docs: DataFrame, keep: list[str], ahead: dict[str, str]) -> DataFrame:
    """Columns ``keep`` of each document, and of the next one in ascending order of ids those of ``ahead``, renamed by it.

    The last is followed by the first. Documents are dealt into buckets of neighbouring ids; each bucket's first id is a
    table id, so a row can tell by its own id that it must also stand, as a guest, at the end of the bucket before.
    """
    edges = _edges(docs)
    # rows with a null id have a bucket of their own before all others
    nulls = int(not edges or not docs.where("doc_id is null").isEmpty())
    tie, place, starts, own, bucket = (common.free_name(docs, x) for x in ("tie", "place", "edges", "own_key", "bucket"))
    rows = docs.select("doc_id", *[c for c in dict.fromkeys([*keep, *ahead]) if c != "doc_id"])
    rows = rows.withColumn(own, _key(docs))
    kind = rows.schema[own].dataType.simpleString()
    rows = rows.withColumn(starts, F.from_json(F.lit(json.dumps(edges)), "array<string>").cast(f"array<{kind}>"))
    rows = _placed(rows, starts, F.col(own), len(edges), bucket)
    rows = rows.withColumn(bucket, F.col(bucket) - 1 + nulls)
    first = F.get(starts, F.col(bucket) - nulls).eqNullSafe(F.col(own))
    before = F.pmod(F.col(bucket) - 1, F.lit(len(edges) + nulls))
    at = F.struct(F.col(bucket).alias("b"), F.lit(0).alias("g"))
    places = F.when(first, F.array(at, F.struct(before.alias("b"), F.lit(1).alias("g")))).otherwise(F.array(at))
    rows = rows.withColumn(tie, F.xxhash64("text") if "text" in rows.columns else F.lit(0)).withColumn(place, F.explode(places)).drop(starts, own, bucket)
    order = Window.partitionBy(f"{place}.b").orderBy(f"{place}.g", F.col("doc_id").asc_nulls_first(), tie)
    rows = rows.select("*", *(F.lead(c).over(order).alias(name) for c, name in ahead.items()))
    return rows.where(F.col(f"{place}.g") == 0).select(*keep, *ahead.values())


def edited(text: Column, following: Column, n_chars: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as many first characters of ``following``, or all it has."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.left(text, n_chars.cast("int") - half), F.left(following, half))


def compare_with_edits(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edit, and their likeness; see ``edited``."""
    rows = docs.select("doc_id", common.text_or_empty(F.col("text")).alias("text"))
    rows = with_sketch(rows, "text", "own", shingle, scale)
    rows = with_next(rows, ["doc_id", "text", "own"], {"text": "following", "own": "next"})
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("following"), F.col("n_chars")))
    rows = with_sketch(rows, "edit", "changed", shingle, scale)
    own, changed, following = F.col("own"), F.col("changed"), F.col("next")
    in_edit, in_next = (stands_in(own, scale) | stands_in(x, scale) for x in (changed, following))
    # only texts of which a sketch says too little are cut into shingles once more
    needed = {"text": in_edit | in_next, "edit": in_edit, "following": in_next}
    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edit", "UTF-8"), 256).alias("edited_sha256"), "own", "changed", "next", *(F.when(c, F.col(k)).otherwise("").alias(k) for k, c in needed.items()))
    for k in needed:
        rows = with_hashes(rows, k, f"{k}_all", shingle, f"{k}_words")
    whole, whole_edit, whole_next = (F.array_distinct(f"{k}_all") for k in needed)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelt(own).alias("fingerprint"),
        spelt(changed).alias("edited_fingerprint"),
        containment(own, changed).alias("near_edited"),
        containment(own, following).alias("near_next"),
        resemblance(own, changed).alias("resemblance_edited"),
        resemblance(own, following).alias("resemblance_next"),
        F.when(in_edit, containment(whole, whole_edit)).otherwise(containment(own, changed)).alias("contained_edited"),
        F.when(in_next, containment(whole, whole_next)).otherwise(containment(own, following)).alias("contained_next"),
    )
