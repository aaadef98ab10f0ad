"""The engine's entry points: index a corpus, ask it broad and narrow questions, and evaluate answers.

Every stage's result is a table under one folder, committed as a whole with a key: a digest of the stage's parameters and of
what it was made from. A stage whose table has the key that it would get now is skipped; any other is made anew, and with it
what depends on it. Extraction asks only for chunks that have no result yet under the same parameters, by their texts,
so a run that was cut off, a corpus that has grown and failures that are tried again cost only what is new.

A log of events says which chunks and stages are done; resets void what they say, and clear the tables.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig, checked_criteria, checked_question
from ..functions import jsons as js
from ..functions import text as tx
from ..operators import chunking, claims, community, costs, evaluate, extract, graph, reports, state, vector
from ..providers import MODES, PROMPTS, TEXT, CompletionProvider, Embedder, HashedEmbedder, RuleModel, completed, task, used
from ..sources import tables

TABLES = {"chunking": "chunks", "extraction": "extractions", "graph_construction": "edges", "community_detection": "membership", "summarization": "reports", "embedding": "vectors"}
RUNS = "run_id string, kind string, at timestamp, status string, questions long, criteria array<string>, details string"
USAGE = "at timestamp, task string, model string, calls long, prompt_tokens long, completion_tokens long"
REPORTS = "community_id string, title string, summary string, impact_rating double, rating_explanation string, findings array<struct<summary:string,explanation:string>>, level string"
NO_DATA = "No community reports are available at this level."
NOTHING_HELPFUL = "The corpus holds nothing that helps to answer this question."


class Cancelled(Exception):
    """The run was told to stop."""


@dataclass
class Hooks:
    """What is called on the driver as a run goes on; any may be left out."""

    #: A stage and how many per cent of all stages are done with it.
    progress: Callable[[str, float], None] | None = None
    #: The result of a batch of extracted chunks: counts, success rate, seconds, chunks a second.
    chunks: Callable[[dict], None] | None = None
    #: While a stage runs: a task's name, and how many prompts were answered and have failed so far.
    asked: Callable[[str, int, int], None] | None = None
    #: A level and the number of its reports.
    reports: Callable[[str, int], None] | None = None

    def call(self, name: str, *values) -> None:
        if (hook := getattr(self, name)) is not None:
            hook(*values)


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def _content(rows: DataFrame, *columns: str) -> str:
    """Says whether rows are the same, in any order: their number, and the sums of two hashes of each."""
    hashes = [F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)")).cast("string").alias(f"h{k}") for k in range(2)]
    return ":".join(map(str, rows.agg(F.count("*").alias("n"), *hashes).head()))


@dataclass
class Engine:
    spark: SparkSession
    root: str
    config: EngineConfig = field(default_factory=EngineConfig)
    provider: CompletionProvider = field(default_factory=RuleModel)
    embedder: Embedder | None = None
    hooks: Hooks = field(default_factory=Hooks)
    tokenizer: tx.Tokenizer = tx.WHITE_SPACE
    #: Rows with text and a key to rows (key, pos, kind, parts) of records.
    parse: Callable[[DataFrame, str], DataFrame] = extract.records

    def __post_init__(self):
        self.embedder = self.embedder or HashedEmbedder(self.config.embedding_dim)
        self.tag, self.stopped, self.running, self.warmed = f"engine-{uuid.uuid4().hex}", False, {}, {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return tables.load(self.spark, self.path(name))

    def has(self, name: str) -> bool:
        return tables.saved(self.spark, self.path(name))

    def key(self, name: str) -> str | None:
        """What a table was made from; None where there is none."""
        found = tables.manifest(self.spark, self.path(name))
        return found["key"] if found and found["parts"] else None

    def made(self, name: str, key: str, run: Callable[[], None]) -> None:
        """Makes a table unless it is there with this key."""
        if self.key(name) != key:
            run()

    def ask(self, rows: DataFrame, name: str) -> DataFrame:
        """The provider's responses to the prompts of a task, stored; ``Hooks.asked`` hears of them as tasks end.

        What they took goes to the table of usage, from the stored rows, so that no call counts twice.
        """
        answered, failed = (self.spark.sparkContext.accumulator(0) for _ in range(2))
        out = completed(rows, "prompt", self.provider, self.config.attempts, mode=MODES.get(name, TEXT), most=self.config.concurrency, answered=answered, failed=failed, usage=True)
        with self.watched(name, lambda: (answered.value, failed.value)):
            out = tables.cut_lineage(out)
        sums = (F.coalesce(F.sum(c), F.lit(0)) for c in ("prompt_tokens", "completion_tokens"))
        self.note_usage(name, *out.agg(F.count("prompt_tokens"), *sums).head())
        return out.drop("prompt_tokens", "completion_tokens")

    def ask_once(self, name: str, prompt: str) -> str:
        """The provider's response to one prompt, on the driver."""
        answer = self.provider.complete([prompt])[0]
        self.note_usage(name, 1, *used(prompt, answer))
        return str(answer)

    def note_usage(self, name: str, calls: int, prompt_tokens: int, completion_tokens: int) -> None:
        """Adds a line for the calls of a task; a provider without the name of a model has no cost."""
        if calls:
            model = getattr(self.provider, "model", None)
            row = self.spark.createDataFrame([(datetime.now(timezone.utc), name, model, calls, prompt_tokens, completion_tokens)], USAGE)
            cost = F.when(F.col("model").isNotNull(), F.col("cost_usd")).alias("cost")
            tables.save(costs.priced(row).select(*row.columns, cost), self.path("usage"), append=True)

    def usage(self, by: tuple[str, ...] = ("task",)) -> DataFrame:
        """Tokens and cost of all calls so far, by task or model."""
        rows = self.read("usage") if self.has("usage") else self.spark.createDataFrame([], USAGE + ", cost double")
        return evaluate.token_usage(rows, list(by))

    def warm(self, *names: str) -> None:
        """Keeps tables in the executors' memory (what doesn't fit on their disks): the reports, if none is named.

        Spark knows what it keeps by the files read, so a table that has been written anew is read anew.
        """
        for name in names or ("reports",):
            self.invalidate(name)
            self.warmed[name] = self.read(name).persist()
            self.warmed[name].count()

    def invalidate(self, *names: str) -> None:
        """Lets go of what ``warm`` keeps: all tables, if none is named."""
        for name in names or tuple(self.warmed):
            if (kept := self.warmed.pop(name, None)) is not None:
                kept.unpersist()

    @contextmanager
    def watched(self, name: str, counts: Callable[[], tuple[int, int]], every: float = 0.1) -> Iterator[None]:
        """Calls ``Hooks.asked`` whenever counts have changed, from a thread of its own, and once more at the end."""
        if self.hooks.asked is None:
            yield
            return
        over, last = threading.Event(), [None]

        def look():
            now = counts()
            if now != last[0]:
                last[0] = now
                self.hooks.call("asked", name, *now)

        def run():
            while not over.wait(every):
                look()

        watcher = threading.Thread(target=run, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            over.set()
            watcher.join()
            look()

    def cancel(self) -> None:
        """Stops a run from another thread: its Spark jobs, and what would come after them."""
        self.stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def stage(self, name: str, run: Callable[[], None]) -> None:
        """One stage of ``index``, whose jobs ``cancel`` can stop."""
        if self.stopped:
            raise Cancelled(name)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            run()
        except Exception as e:
            if self.stopped:
                raise Cancelled(name) from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        self.hooks.call("progress", name, 100.0 * (state.STAGES.index(name) + 1) / len(state.STAGES))

    # ---- indexing ----

    def index(self, docs: DataFrame, max_chunks: int | None = None, retry_failed: bool = False, force: bool = False) -> None:
        """``docs`` has doc_id (any order) and text, and is the whole corpus.

        ``retry_failed`` asks again for chunks that have failed, ``force`` does all stages anew.
        """
        if force:
            self.reset_all()
        job = self.log("index", "running")
        try:
            self.stage("chunking", lambda: self.made("chunks", self.chunks_key(docs, max_chunks), lambda: self.chunk(docs, max_chunks)))
            self.stage("extraction", lambda: self.extract(retry_failed))
            self.stage("graph_construction", lambda: self.made("edges", self.graph_key(), self.build_graph))
            self.stage("community_detection", lambda: self.made("membership", self.membership_key(), self.cluster))
            self.stage("summarization", lambda: self.made("reports", self.reports_key(), self.report))
            self.stage("embedding", lambda: self.made("vectors", self.vectors_key(), self.embed))
        except Exception as e:
            self.log("index", "cancelled" if isinstance(e, Cancelled) else "failed", job, details=str(e)[:500])
            raise
        self.log("index", "completed", job)

    # What a table's content follows from. Providers, embedders and tokenisers count by their ``key``, if they have one.

    def chunks_key(self, docs: DataFrame, max_chunks: int | None = None) -> str:
        c = self.config
        return _digest("chunks", _content(docs, "doc_id", "text"), c.chunk_size, c.chunk_overlap, max_chunks or 0, getattr(self.tokenizer, "key", ""))

    def asked_key(self) -> str:
        """The parameters under which a chunk's extraction counts as done."""
        return _digest("extract", self.config.gleaning_rounds, [PROMPTS[k] for k in ("extract", "more", "continue")], getattr(self.provider, "key", ""))

    def graph_key(self) -> str:
        """By the responses themselves, so that chunks which fail once more change nothing."""
        found = self.extracted().where("text is not null")
        return _digest("graph", _content(found, "chunk_id", "chunk_ord", "round", "text"), self.config.min_entity_mentions, getattr(self.parse, "__name__", ""))

    def membership_key(self) -> str:
        c = self.config
        return _digest("membership", self.key("edges"), c.max_cluster_size, c.max_levels, c.seed)

    def reports_key(self) -> str:
        return _digest("reports", self.key("membership"), self.config.context_window, PROMPTS["report"], getattr(self.provider, "key", ""))

    def vectors_key(self) -> str:
        return _digest("vectors", self.key("chunks"), self.config.embedding_dim, getattr(self.embedder, "key", type(self.embedder).__name__))

    def chunk(self, docs: DataFrame, max_chunks: int | None = None) -> None:
        c = self.config
        stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
        rows = chunking.chunk(docs, stem, c.chunk_size, c.chunk_overlap, limit=max_chunks, tokenizer=self.tokenizer)
        # chunks are numbered in the order of documents, however many a document has
        tables.save(tables.numbered(rows, ["doc_id", "chunk_index"], "chunk_ord"), self.path("chunks"), key=self.chunks_key(docs, max_chunks))
        self.note(state.COMPLETE, "chunking")

    def cluster(self) -> None:
        c, nodes, edges = self.config, self.read("nodes"), self.read("edges")
        found = community.hierarchy(nodes.select("node_id"), edges.select("src", "dst", "weight"), c.max_cluster_size, c.max_levels, c.seed)
        tables.save(found, self.path("membership"), ("level",), key=self.membership_key(), inputs={"edges": self.key("edges")})
        self.note(state.COMPLETE, "community_detection")

    def embed(self) -> None:
        rows = self.embedder.embedded(self.read("chunks").select("chunk_ord", "chunk_id", "doc_id", "text", "token_count"), "text", "embedding")
        rows = vector.checked(rows.withColumnRenamed("chunk_ord", "vec_id"), self.config.embedding_dim)
        tables.save(rows, self.path("vectors"), key=self.vectors_key(), inputs={"chunks": self.key("chunks")})
        self.note(state.COMPLETE, "embedding")

    def extracted(self) -> DataFrame:
        """(chunk_id, chunk_ord, round, text, error): what is known of today's chunks under today's parameters.

        Results are found by a chunk's id and text, so those of chunks that have moved in the corpus still count.
        """
        chunks = self.read("chunks").select("chunk_id", "chunk_ord", F.md5("text").alias("content"))
        found = self.read("extractions").where(F.col("asked") == self.asked_key()).drop("chunk_ord")
        return found.join(chunks, ["chunk_id", "content"]).select("chunk_id", "chunk_ord", "round", "text", "error")

    def extract(self, retry_failed: bool = False) -> None:
        """Asks for the records of each chunk that has none yet, and for more in later rounds, while the model says so."""
        began = time.perf_counter()
        chunks = self.read("chunks").select("chunk_id", "chunk_ord", "text")
        todo = chunks
        if self.has("extractions"):
            seen = self.extracted().where("round = 0").select("chunk_id", F.col("text").isNull().alias("failed")).groupBy("chunk_id").agg(F.min("failed").alias("failed"))
            ids = state.pending(chunks, seen.where("not failed"), seen.where("failed"), "chunk_id", retry_failed)
            todo = chunks.join(ids, "chunk_id", "left_semi")
            if todo.isEmpty():
                self.note(state.COMPLETE, "extraction")
                return
        out = self.answers(todo)
        tables.save(out, self.path("extractions"), append=True)
        self.note_extracted(out)
        self.note(state.COMPLETE, "extraction")
        self.hooks.call("chunks", self.batch(out, time.perf_counter() - began))

    def answers(self, todo: DataFrame) -> DataFrame:
        """(chunk_id, chunk_ord, content, round, text, error, asked): the responses of all rounds on chunks, stored."""
        asked = self.ask(todo.withColumn("prompt", task("extract", text="text")), "extract")
        content = F.md5("text").alias("content")
        rounds = [asked.select("chunk_id", "chunk_ord", content, F.lit(0).alias("round"), F.col("response").alias("text"), "error")]
        active = asked.where("response is not null").select("chunk_id", "chunk_ord", "text")
        for k in range(1, self.config.gleaning_rounds + 1):
            more = self.ask(active.withColumn("prompt", task("more", text="text")), "more").where("response = 'YES'")
            found = self.ask(more.drop("response", "error").withColumn("prompt", task("continue", text="text")), "continue")
            rounds.append(found.select("chunk_id", "chunk_ord", content, F.lit(k).alias("round"), F.col("response").alias("text"), "error"))
            active = found.where("response is not null").select("chunk_id", "chunk_ord", "text")
        out = rounds[0]
        for r in rounds[1:]:
            out = out.unionByName(r)
        return tables.cut_lineage(out.withColumn("asked", F.lit(self.asked_key())))

    def note_extracted(self, extractions: DataFrame, once: tuple[str, int] | None = None) -> None:
        first = extractions.where("round = 0")
        self.note_all(first.select("chunk_id", F.when(F.col("text").isNull(), state.FAILED).otherwise(state.EXTRACTED).alias("event"), F.col("error").alias("detail")), once)

    def extract_arriving(self, docs: DataFrame, checkpoint: str) -> StreamingQuery:
        """Chunks and extracts documents of a stream, (doc_id, text), as they arrive, up to what is there now.

        ``index`` finds their results when it comes to the same chunks, and asks for none of them. The checkpoint is where
        the stream goes on; the id that Spark keeps in it and a batch's number say which batches are in the tables.
        """

        def take(rows: DataFrame, number: int) -> None:
            self.extract_batch(rows, (self.spark.sparkContext.getLocalProperty("sql.streaming.queryId"), number))

        query = docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def extract_batch(self, docs: DataFrame, once: tuple[str, int]) -> None:
        """Extracts a batch of documents; one that is replayed after it was cut off, at any place, adds what is missing.

        A chunk that has a result under today's parameters, failed ones included, isn't asked again. Calls of a batch that
        was cut off before its results were written are made again.
        """
        c, began = self.config, time.perf_counter()
        stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
        rows = chunking.chunk(docs, stem, c.chunk_size, c.chunk_overlap, tokenizer=self.tokenizer)
        rows = rows.select("chunk_id", F.lit(None).cast("long").alias("chunk_ord"), "text", F.md5("text").alias("content")).dropDuplicates(["chunk_id", "content"])
        mine = lambda: self.read("extractions").where(F.col("asked") == self.asked_key())
        if not tables.written(self.spark, self.path("extractions"), once):
            todo = rows.join(mine().select("chunk_id", "content"), ["chunk_id", "content"], "left_anti") if self.has("extractions") else rows
            out = self.answers(todo.select("chunk_id", "chunk_ord", "text"))
            tables.save(out, self.path("extractions"), append=True, once=once)
            self.hooks.call("chunks", self.batch(out, time.perf_counter() - began))
        if not tables.written(self.spark, self.path("state"), once):
            self.note_extracted(mine().join(rows.select("chunk_id", "content"), ["chunk_id", "content"], "left_semi"), once)

    def batch(self, extractions: DataFrame, seconds: float) -> dict:
        """Counts, success rate and throughput of a batch of extractions."""
        records = self.parse(extractions.where("text is not null"), "chunk_id").groupBy("chunk_id").pivot("kind", ["entity", "relationship", "claim"]).count()
        rows = extractions.where("round = 0").select("chunk_id", F.col("text").isNotNull().alias("extraction_completed")).join(records, "chunk_id", "left").na.fill(0)
        rows = rows.withColumnsRenamed({"entity": "entities", "relationship": "relationships", "claim": "claims"})
        return extract.batch_result(rows, seconds).head().asDict()

    def rounds_completed(self) -> DataFrame:
        """(chunk_id, rounds_completed): the last round of each chunk that gave a response; null if none did."""
        return self.extracted().groupBy("chunk_id").agg(F.max(F.when(F.col("text").isNotNull(), F.col("round"))).alias("rounds_completed"))

    def build_graph(self) -> None:
        key = self.graph_key()
        raw = self.extracted().where("text is not null").withColumn("key", F.struct("chunk_ord", "round"))
        rows = self.parse(raw, "key").select("*", "key.chunk_ord", "key.round")
        keep = lambda df: df.select("*", "key.chunk_ord", "key.round")
        entities = extract.merged_rounds(keep(extract.entities(rows, "key")), [extract.normal("name")], "chunk_ord")
        pairs = extract.merged_rounds(keep(extract.relationships(rows, "key")), [extract.normal("source_entity"), extract.normal("target_entity")], "chunk_ord")
        said = keep(extract.claims(rows, "key"))
        # later rounds come after earlier ones in a chunk
        place = lambda df: df.withColumn("pos", F.struct("round", "pos"))
        nodes = graph.nodes(place(entities), place(said), self.config.min_entity_mentions)
        tables.save(nodes, self.path("nodes"), key=key)
        nodes = self.read("nodes")
        edges = graph.edges(place(pairs), nodes)
        inputs = {"chunks": self.key("chunks"), "extractions": tables.manifest(self.spark, self.path("extractions"))["version"]}
        tables.save(graph.combined_degrees(edges, graph.degrees(nodes, edges)), self.path("edges"), key=key, inputs=inputs)
        self.note(state.COMPLETE, "graph_construction")

    def report(self) -> None:
        """Reports level by level from the finest, so that a community's children have theirs when it needs them."""
        nodes, edges, membership = self.read("nodes"), self.read("edges"), self.read("membership").select("node_id", "level", "community_id")
        links = community.parents(membership)
        levels, made = sorted(r["level"] for r in membership.select("level").distinct().collect()), None
        for level in reversed(levels):
            members = membership.where(F.col("level") == level)
            raw = reports.raw_context(members, nodes, edges, community.internal_edges(edges.select("src", "dst"), members), self.config.context_window)
            below = made if made is not None else None
            mine = links.join(members.select(F.col("community_id").alias("parent")).distinct(), "parent", "left_semi")
            if below is None:
                sub = raw.select("community_id", F.lit(None).cast("string").alias("sub")).where("false")
            else:
                sub = reports.sub_context(mine, below.select("community_id", "level", "title", "summary", "impact_rating"))
            rows = reports.chosen_context(raw, sub, self.config.context_window, below is not None)
            sizes = members.groupBy("community_id").agg(F.count("*").cast("int").alias("node_count"))
            rows = self.ask(rows.join(sizes, "community_id").withColumn("prompt", task("report", context="context")), "report")
            found = reports.parsed_reports(rows).join(rows.select("community_id", tx.count_tokens("context").alias("context_tokens"), "was_truncated", "used_sub"), "community_id").withColumn("level", F.lit(level))
            found = tables.cut_lineage(found)
            made = found if made is None else made.unionByName(found)
            self.hooks.call("reports", level, found.count())
        if made is None:  # no communities
            made = self.spark.createDataFrame([], REPORTS)
        tables.save(made, self.path("reports"), ("level",), key=self.reports_key(), inputs={"membership": self.key("membership")})
        self.note(state.COMPLETE, "summarization")

    def current(self, name: str) -> bool:
        """Whether a table is there and was made from what its inputs are now."""
        found = tables.manifest(self.spark, self.path(name))
        if not found or not found["parts"]:
            return False
        for other, was in found["inputs"].items():
            if other == "extractions":
                if tables.manifest(self.spark, self.path(other))["version"] != was and found["key"] != self.graph_key():
                    return False
            elif self.key(other) != was or not self.current(other):
                return False
        return True

    def status(self) -> dict:
        """Which stages are done, the next one, and which kinds of questions can be answered."""
        done = {s: self.current(t) for s, t in TABLES.items()}
        following = next((s for s in state.STAGES if not done[s]), None)
        return {"done": done, "next": following, **state.ready(done)}

    def sizes(self) -> dict[str, dict[str, int] | None]:
        """Rows and bytes of each stored table, None where there is none."""
        names = (*TABLES.values(), "nodes")
        return {n: {"rows": self.read(n).count(), "bytes": tables.artifact_size(self.spark, self.path(n))} if self.has(n) else None for n in names}

    def report_by_id(self, community_id: str) -> dict | None:
        return tables.by_id(self.read("reports"), "community_id", community_id)

    def reports_page(self, level: str, page: int = 1, size: int = 20) -> tuple[int, DataFrame]:
        """The number of a level's reports, and one page of them by community."""
        return state.counted(self.read("reports").where(F.col("level") == level), ["community_id"], page, size)

    # ---- state ----

    def note(self, event: str, stage: str | None = None) -> None:
        """Adds a line to the log of the run's state."""
        tables.save(self.spark.createDataFrame([(self.root, time.time_ns(), event, stage, None, None)], state.EVENTS), self.path("state"), append=True)

    def note_all(self, chunks: DataFrame, once: tuple[str, int] | None = None) -> None:
        """Adds a line for each chunk: (chunk_id, event, detail)."""
        rows = chunks.select(F.lit(self.root).alias("run"), F.lit(time.time_ns()).alias("at"), "event", F.lit("extraction").alias("stage"), "chunk_id", "detail")
        tables.save(rows, self.path("state"), append=True, once=once)

    def mark_extracted(self, chunk_ids: list[str]) -> None:
        self.note_all(self.spark.createDataFrame([(c, state.EXTRACTED, None) for c in chunk_ids], "chunk_id string, event string, detail string"))

    def mark_failed(self, chunk_ids: list[str], error: str) -> None:
        self.note_all(self.spark.createDataFrame([(c, state.FAILED, error) for c in chunk_ids], "chunk_id string, event string, detail string"))

    def reset_stage(self, stage: str) -> None:
        """The stage is done anew in the next run; resetting extraction forgets what is known of chunks."""
        for name in (TABLES[stage], *(["nodes"] if stage == "graph_construction" else [])):
            tables.clear(self.spark, self.path(name))
        self.note(state.RESET, stage)

    def reset_all(self) -> None:
        """All stages are done anew in the next run."""
        for name in (*TABLES.values(), "nodes"):
            tables.clear(self.spark, self.path(name))
        self.note(state.RESET_ALL)

    def chunk_states(self) -> DataFrame:
        """(chunk_id, status, detail): extracted, or failed with its error, for chunks of today's corpus."""
        return state.chunk_states(self.read("state")).drop("run").join(self.read("chunks").select("chunk_id"), "chunk_id", "left_semi")

    def stage_states(self) -> DataFrame:
        """(stage, done, completed_at) by the log."""
        return state.stage_states(self.read("state")).drop("run")

    def progress(self) -> dict:
        """Chunks in all, extracted, failed and pending, and per cent done."""
        return state.progress(self.read("chunks"), self.chunk_states(), "chunk_id").head().asDict()

    def vacuum(self, keep: int = 1, age: float = tables.AGE) -> int:
        """Deletes tables' versions but for the last ``keep``; gives the number of folders that went."""
        names = (*TABLES.values(), "nodes", "runs", "evaluations", "state", "usage")
        return sum(tables.vacuum(self.spark, self.path(n), keep, age) for n in names if tables.manifest(self.spark, self.path(n)))

    # ---- runs ----

    def log(self, kind: str, status: str, run: str | None = None, questions: int = 0, criteria: tuple[str, ...] = (), details: str = "") -> str:
        """Adds a line to the log of runs, of which a run's last one counts; gives the run's id."""
        run = run or tables.run_id("eval" if kind == "evaluation" else "job")
        row = (run, kind, datetime.now(timezone.utc), status, questions, list(criteria), details)
        self.running[run] = row
        tables.save(self.spark.createDataFrame([row], RUNS), self.path("runs"), append=True)
        return run

    def runs(self, kind: str) -> DataFrame:
        """Each run of a kind as it was last seen; those of this engine as they are in memory."""
        columns = ["kind", "at", "status", "questions", "criteria", "details"]
        here = self.spark.createDataFrame([r for r in self.running.values() if r[1] == kind], RUNS)
        if not self.has("runs"):
            return here
        stored = state.latest(self.read("runs").where(F.col("kind") == kind), "run_id", "at", *columns)
        return state.merged_runs(here, stored.select(*here.columns), "run_id")

    def jobs(self, limit: int = 20) -> DataFrame:
        """The latest indexing runs first."""
        return state.newest(self.runs("index"), "at", limit)

    def evaluations(self, page: int = 1, size: int = 20) -> tuple[int, DataFrame]:
        """The number of all evaluations, and one page of them, the latest first."""
        return state.counted(self.runs("evaluation"), [F.desc("at"), "run_id"], page, size)

    def evaluation(self, run: str) -> DataFrame:
        """A saved evaluation's summary by criterion."""
        return self.read("evaluations").where(F.col("run_id") == run)

    # ---- questions ----

    def ask_global(self, question: str, level: str | None = None) -> dict:
        """Map each report of a level to scored points, fill a window with the best, and answer from that."""
        question, level, c = checked_question(question), level or self.config.level, self.config
        found = self.read("reports").where(F.col("level") == level)
        if found.isEmpty():
            return {"answer": NO_DATA, "communities": 0, "points": 0, "helpful": 0, "context_tokens": 0, "context": ""}
        contexts = reports.map_context(found, c.context_window)
        mapped = self.ask(contexts.withColumn("prompt", task("points", question=F.lit(question), context="context")), "points")
        points = reports.map_points(mapped)
        m = reports.map_totals(reports.map_metrics(mapped, points, c.helpfulness_threshold), mapped).head()
        helpful = reports.helpful(points, c.helpfulness_threshold)
        lines = reports.reduce_context(helpful, c.context_window - len(question.split())).orderBy("rank")
        context = "\n".join(r["line"] for r in lines.select("line").collect())  # at most one context window
        answer = self.ask_once("answer", f"TASK: answer\n### question\n{question}\n### context\n{context}") if context else NOTHING_HELPFUL
        return {"answer": answer, "communities": m["communities"], "points": m["points"], "helpful": m["helpful"], "context_tokens": m["context_tokens"], "context": context}

    def ask_local(self, question: str) -> dict:
        """The nearest chunks, as many as fit the window, with citations."""
        question, c = checked_question(question), self.config
        asked = self.embedder.embedded(self.spark.range(1).select(F.lit(question).alias("q")), "q", "embedding").head()["embedding"]
        rows = self.read("vectors")
        best = vector.top_k(rows, list(asked), c.top_k)
        hits = best.drop("rank").join(rows.select("vec_id", F.col("doc_id").cast("string").alias("source"), "text"), "vec_id")
        kept = vector.cited_context(hits, c.context_window, [F.desc("score"), "vec_id"], self.tokenizer).orderBy("rank").collect()  # at most one context window
        context = "\n\n---\n\n".join(r["cited"] for r in kept)
        answer = self.ask_once("answer", f"TASK: answer\n### question\n{question}\n### context\n{context}") if kept else NOTHING_HELPFUL
        return {"answer": answer, "chunks": [(r["rank"], r["vec_id"], r["score"]) for r in kept], "context": context}

    # ---- evaluation ----

    def judge(self, answers: DataFrame, criteria: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(question_id, question, global, local) to results by question and criterion, and by criterion; the latter are saved."""
        criteria, asked = checked_criteria(criteria), answers.count()
        run = self.log("evaluation", "running", questions=asked, criteria=criteria)
        rows = evaluate.grid(answers, criteria, self.config.eval_runs).withColumn("coin", evaluate.coin("question_id", "criterion", "run_index", seed=self.config.seed))
        shown = lambda c: tx.truncated(F.col(c), tx.tokens(c), 1500)
        first, second = shown("global"), shown("local")
        rows = rows.withColumn("prompt", task("judge", question="question", criterion="criterion", a=F.when(F.col("coin") == 1, first).otherwise(second), b=F.when(F.col("coin") == 1, second).otherwise(first)))
        rows = tables.cut_lineage(evaluate.unswapped(evaluate.parsed_judgments(self.ask(rows, "judge"))))
        results = evaluate.criterion_results(rows)
        summary = evaluate.summary(results)
        tables.save(summary.withColumn("run_id", F.lit(run)), self.path("evaluations"), append=True)
        rates = summary.agg(js.dumped(F.map_from_entries(F.collect_list(F.struct("criterion", "mean_win_rate"))))).head()[0]
        self.log("evaluation", "completed", run, asked, criteria, rates)
        return results, self.evaluation(run).drop("run_id")

    def compare_claims(self, answers: DataFrame, distance: float = 0.7) -> tuple[DataFrame, DataFrame]:
        """The same answers compared by their claims: a row for each question, and one over all."""
        long = answers.select("question_id", "question", F.explode(F.create_map(F.lit("global"), "global", F.lit("local"), "local")).alias("system", "answer"))
        long = long.withColumn("key", F.struct("question_id", "system")).withColumn("prompt", task("claims", question="question", answer=tx.truncated(F.col("answer"), tx.tokens("answer"), 3000)))
        found = claims.parsed(self.ask(long, "claims"), "key").select("key.question_id", "key.system", "pos", "claim")
        kept = tables.cut_lineage(claims.deduplicated(found, ["question_id", "system"]))
        counts = kept.groupBy("question_id", "system").agg(F.count("*").alias("claims"))
        clusters = claims.cluster_counts(kept, ["question_id", "system"], (distance,)).drop("threshold")
        rows = claims.comparison(counts.join(clusters, ["question_id", "system"]))
        rows = tables.cut_lineage(rows)
        return rows, claims.batch(rows).crossJoin(evaluate.compared_counts_p(rows).select("p_value"))  # one row each
