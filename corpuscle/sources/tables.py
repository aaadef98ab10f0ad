"""Readers and writers of artifacts."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Folders under the shared one into which ``fresh_dir`` puts new paths, the innermost last; each thread has its own.
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own on a single machine, as in tests.

    A cluster without that setting is refused: each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; whoever writes to it makes it.

    All paths of an application are in one folder, which is deleted when its driver ends.
    """
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        p, fs = _path(spark, own)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return "/".join([own, *_SCRATCH.get(), f"{name}-{uuid.uuid4().hex}"])


#: Folders of applications that are to be deleted.
_OWN: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside goes to one folder, which is deleted at the end; results must be written elsewhere before."""
    path = fresh_dir(spark, "scratch")
    before = _SCRATCH.set((*_SCRATCH.get(), path.rsplit("/", 1)[1]))
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        delete(spark, path)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the numbers 0, 1, 2, … in ``order``: places inside ranges that are sorted apart, and the sizes of the ranges before."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed, "numbered").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.col("_range"), 33)
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside).drop("_range", "_before", "_at")


def by_id(rows: DataFrame, key: str, value) -> dict | None:
    """The first row whose ``key`` is ``value``, or None; the filter reaches the files."""
    found = rows.where(F.col(key) == F.lit(value)).limit(1).collect()
    return found[0].asDict(recursive=True) if found else None


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the folder that all executors share."""
    return stored(df, "cut")


def raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, text, metadata, error) of the .json, .txt and .md files right in ``folder``, in order of paths.

    The stem, from which ids are made, is a file's name without its ending; of files that have one in common it is the
    whole name, so that their ids differ.
    JSON strings are texts; JSON objects have theirs in text, content, body or article, the first that isn't empty, and
    metadata in the object of that name and all other plain values. Other files are whole texts. Files that start with a
    dot or an underscore are left out, as Spark does. A file that can't be read as JSON has an error and no text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    files = files.where(F.lower("path").rlike(r"\.(json|txt|md)$"))
    name, whole = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.regexp_extract("path", r"([^/]+)$", 1)
    # names alone are read for this, and at most as many rows as clashes are joined
    several = files.select(name.alias("_stem")).groupBy("_stem").agg(F.count("*").alias("_n")).where("_n > 1")
    files = files.join(several, name == F.col("_stem"), "left")
    rows = files.select("path", F.when(F.col("_n") > 1, whole).otherwise(name).alias("stem"), F.lower("path").endswith(".json").alias("is_json"), F.decode("content", "UTF-8").alias("body"))
    return parsed_documents(rows).orderBy("path")


def parsed_documents(rows: DataFrame) -> DataFrame:
    """Adds text, metadata and error to rows with ``is_json`` and ``body``."""
    v = F.when(F.col("is_json"), F.try_parse_json("body"))
    rows = rows.withColumn("_v", v).withColumn("_kind", F.schema_of_variant("_v"))
    field = lambda k: F.nullif(F.try_variant_get("_v", f"$.{k}", "string"), F.lit(""))
    found = F.coalesce(*(field(k) for k in ("text", "content", "body", "article")), F.lit(""))
    is_object = F.col("_kind").startswith("OBJECT")
    text = F.when(~F.col("is_json"), F.col("body")).when(F.col("_kind") == "STRING", F.try_variant_get("_v", "$", "string")).when(is_object, found)
    own = F.coalesce(F.from_json(F.try_variant_get("_v", "$.metadata", "string"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    top = F.coalesce(F.when(is_object, F.col("_v")).cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    nested = lambda x: F.coalesce(F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    plain = F.map_filter(top, lambda k, x: ~k.isin("text", "content", "body", "article", "metadata") & ~nested(x) & ~F.array_contains(F.map_keys(own), k))
    plain = F.transform_values(plain, lambda _, x: F.try_variant_get(x, "$", "string"))
    metadata = F.when(is_object, F.map_concat(own, plain)).otherwise(F.create_map().cast("map<string,string>"))
    error = F.when(F.col("is_json") & text.isNull(), F.lit("no JSON string or object"))
    return rows.withColumns({"text": text, "metadata": metadata, "error": error}).drop("_v", "_kind")


def typed_array(spark: SparkSession, path: str, schema: T.StructType, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON array that have the schema and are ``valid``, and the rest, with the text of what could not be read.

    A file that holds something else than an array is refused.
    """
    first = _first_character(spark, path)
    if first is not None and first != "[":
        raise ValueError(f"{path} holds no JSON array")
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = F.col("_corrupt").isNull() & F.coalesce(valid, F.lit(False))
    return rows.where(good).drop("_corrupt"), rows.where(~good)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question) from a JSON list of strings, or of objects with question or text."""
    body = spark.read.text(path, wholetext=True).select(F.posexplode(F.expr("cast(try_parse_json(value) as array<variant>)")).alias("question_id", "v"))
    text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.coalesce(F.try_variant_get("v", "$.question", "string"), F.try_variant_get("v", "$.text", "string"), F.lit("")))
    return body.select("question_id", text.alias("question"))


# ---- artifacts: folders of immutable versions, and numbered manifests that say which of them count --------------

MANIFEST = re.compile(r"_manifest-(\d{10})")
#: A part of an artifact below so many bytes is small; an append rewrites small parts with its own once there are so many.
SMALL, MANY_SMALL = 32 << 20, 16
#: Seconds for which ``vacuum`` leaves what no manifest names, as a write under way may be about to.
AGE = 86_400


class Conflict(Exception):
    """Another writer replaced what this one was about to build on."""


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What was committed last, or as ``version``: version, parts, by, schema, key and inputs; None if nothing was."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    found = [int(m[1]) for s in fs.listStatus(p) if (m := MANIFEST.fullmatch(s.getPath().getName()))]
    if version is None and not found:
        return None
    if version is not None and version not in found:
        raise ValueError(f"{path} has no version {version}")
    number = max(found) if version is None else version
    stream = fs.open(_path(spark, f"{path}/_manifest-{number:010d}")[0])
    try:
        return {"version": number, **json.loads(bytes(stream.readAllBytes()))}
    finally:
        stream.close()


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """An artifact as it is now, or as it was in ``version``; later writes don't change what was loaded.

    A folder that ``save`` hasn't written is read as plain Parquet.
    """
    found = manifest(spark, path, version)
    return spark.read.parquet(path) if found is None else _parts(spark, path, found, found["parts"])


def _parts(spark: SparkSession, path: str, found: dict, parts: list[dict]) -> DataFrame:
    schema = T.StructType.fromJson(found["schema"])
    if not parts:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/{x['folder']}" for x in parts]
    if not any(x["by"] for x in parts):
        return spark.read.schema(schema).parquet(*folders)
    # each part has its own partition folders
    frames = [spark.read.schema(schema).parquet(f).select(*schema.names) for f in folders]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def saved(spark: SparkSession, path: str) -> bool:
    """Whether an artifact is there: something was committed, or written as plain Parquet, and not cleared since."""
    found = manifest(spark, path)
    return bool(found["parts"]) if found else exists(spark, f"{path}/_SUCCESS")


def save(df: DataFrame, path: str, by: tuple[str, ...] = (), append: bool = False, key: str | None = None, inputs: dict | None = None, once: tuple[str, int] | None = None) -> int:
    """Writes an artifact as a whole, or appends to it, and gives its version.

    Rows go to a new folder that nothing names yet; a rename that fails if its target exists then makes the next manifest,
    in one step. So a write that fails or is cut off leaves what was there, readers see all of a write or nothing
    of it, and of two writers at a time each gets a version of its own: appends keep both, and of two whole writes the
    later one counts. ``key`` and ``inputs`` say what the artifact was made from.

    ``once`` is a writer's name and the number of its write, which rises: a write whose number the writer has reached
    already adds nothing, so a stream's batch may be replayed.
    """
    if once and (now := manifest(df.sparkSession, path)) and _reached(now, once):
        return now["version"]
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    before, merged = manifest(spark, path) if append else None, []
    if append and before is None and saved(spark, path):
        df = load(spark, path).unionByName(df, allowMissingColumns=True)
    elif before is not None:
        small = [x for x in before["parts"] if x["bytes"] < SMALL]
        if len(small) >= MANY_SMALL:
            merged = small
            df = _parts(spark, path, before, small).unionByName(df, allowMissingColumns=True)
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{path}/{name}")
        part = {"folder": name, "bytes": size(spark, f"{path}/{name}"), "by": list(by)}
        version = _commit(spark, path, [part], df.schema, append, [x["folder"] for x in merged], key, inputs, once)
    except Exception:
        delete(spark, f"{path}/{name}")
        raise
    if version is None:  # another run of the same write came first
        delete(spark, f"{path}/{name}")
        return manifest(spark, path)["version"]
    return version


def written(spark: SparkSession, path: str, once: tuple[str, int]) -> bool:
    """Whether a writer has come to this number of its writes; see ``save``."""
    return _reached(manifest(spark, path), once)


def _reached(found: dict | None, once: tuple[str, int]) -> bool:
    return found is not None and found.get("writers", {}).get(once[0], -1) >= once[1]


def clear(spark: SparkSession, path: str) -> None:
    """Makes an artifact one without rows that isn't ``saved``; earlier versions stay as they are."""
    if saved(spark, path):
        _commit(spark, path, [], load(spark, path).schema, False, [], None, None)


def _commit(spark: SparkSession, path: str, parts: list[dict], schema: T.StructType, append: bool, merged: list[str], key: str | None, inputs: dict | None, once: tuple[str, int] | None = None) -> int | None:
    """The new version; None if ``once`` was reached meanwhile."""
    while True:
        now = manifest(spark, path)
        if once and _reached(now, once):
            return None
        writers = {**(now or {}).get("writers", {}), **(dict([once]) if once else {})}
        kept, fields = [], list(schema.fields)
        if append and now is not None:
            if not set(merged) <= {x["folder"] for x in now["parts"]}:
                raise Conflict(path)
            kept = [x for x in now["parts"] if x["folder"] not in merged]
            earlier = T.StructType.fromJson(now["schema"]).fields if now["parts"] else []
            fields = [*earlier, *(f for f in fields if f.name not in {e.name for e in earlier})]
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        body = {"parts": [*kept, *parts], "schema": nullable.jsonValue(), "key": key, "inputs": inputs or {}, "writers": writers, "at": time.time()}
        number = now["version"] + 1 if now else 1
        if _put(spark, f"{path}/_manifest-{number:010d}", json.dumps(body)):
            return number


def _put(spark: SparkSession, path: str, body: str) -> bool:
    """Makes a file as a whole; False if there is one already."""
    target, fs = _path(spark, path)
    draft, _ = _path(spark, f"{path.rsplit('/', 1)[0]}/_draft-{uuid.uuid4().hex}")
    stream = fs.create(draft)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), no_options)
    except Exception:
        fs.delete(draft, False)
        if fs.exists(target):
            return False
        raise
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 1, age: float = AGE) -> int:
    """Deletes all but the last ``keep`` versions and what only those had; gives the number of folders that went.

    Who still reads an older version loses it, so this is never done by ``save``.
    """
    p, fs = _path(spark, path)
    found = sorted(int(m[1]) for s in fs.listStatus(p) if (m := MANIFEST.fullmatch(s.getPath().getName())))
    old, kept = found[: -max(1, keep)], found[-max(1, keep) :]
    named = {x["folder"] for v in kept for x in manifest(spark, path, v)["parts"]}
    for v in old:
        delete(spark, f"{path}/_manifest-{v:010d}")
    gone = 0
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith(("v-", "_draft-")) and name not in named and s.getModificationTime() <= (time.time() - age) * 1000:
            gone += fs.delete(s.getPath(), True)
    return gone


def artifact_size(spark: SparkSession, path: str) -> int:
    """Bytes of an artifact's current version."""
    found = manifest(spark, path)
    return size(spark, path) if found is None else sum(x["bytes"] for x in found["parts"])


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _first_character(spark: SparkSession, path: str) -> str | None:
    """The first character of a file that isn't white space; None for a folder and an empty file."""
    p, fs = _path(spark, path)
    if not fs.getFileStatus(p).isFile():
        return None
    stream = fs.open(p)
    try:
        while (code := stream.read()) >= 0:
            if code > 32 and code not in (0xEF, 0xBB, 0xBF):
                return chr(code)
    finally:
        stream.close()
    return None


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    p, fs = _path(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def run_id(kind: str = "eval") -> str:
    return f"{kind}_{uuid.uuid4().hex[:8]}"
