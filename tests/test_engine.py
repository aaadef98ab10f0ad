"""Index, questions and evaluation end to end with the offline providers."""

import os
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpuscle import permits
from corpuscle.config import EngineConfig, checked_criteria, checked_question, checked_questions
from corpuscle.functions import jsons as js
from corpuscle.operators import state
from corpuscle.plans.engine import NO_DATA, Cancelled, Engine, Hooks
from corpuscle.providers import Answer, RuleModel, TransientError, completed, messages
from corpuscle.sources import tables

TEXTS = ["Alice met Bob near London. Alice wrote to NASA about Paris and Bob.", "Bob works with Carol in Paris. Carol knows Alice from London.", "Dora lives alone in Quito.", ""]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), EngineConfig(max_levels=2, gleaning_rounds=1, eval_runs=3))
    assert e.status()["next"] == "chunking"
    e.index(docs)
    return e


def test_index(engine):
    assert engine.status()["fully_indexed"] and engine.status()["next"] is None
    assert engine.read("chunks").count() == 3
    nodes = {r.node_id: r for r in engine.read("nodes").collect()}
    assert nodes["alice"].mention_count == 2 and "quito" in nodes
    levels = engine.read("membership").groupBy("level").agg(F.countDistinct("node_id").alias("n")).collect()
    assert {r.n for r in levels} == {len(nodes)} and len(levels) == 2
    reports = engine.read("reports").collect()
    assert len(reports) == engine.read("membership").select("level", "community_id").distinct().count()
    assert all(0 <= r.impact_rating <= 10 and r.findings for r in reports)


def versions(e):
    return {n: (tables.manifest(e.spark, e.path(n)) or {"version": 0})["version"] for n in ("chunks", "extractions", "edges", "membership", "reports", "vectors")}


def changed(e, run):
    before = versions(e)
    run()
    return {n for n, v in versions(e).items() if v != before[n]}


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_resume(engine, spark):
    """The same corpus, in whatever order of rows, changes nothing."""
    assert changed(engine, lambda: engine.index(corpus(spark, TEXTS).orderBy("text"))) == set()
    assert engine.status()["fully_indexed"]


EVERY = {"chunks", "extractions", "edges", "membership", "reports", "vectors"}


def test_what_depends_on_a_change_is_made_anew(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    class Counting(RuleModel):
        def _extract(self, prompt):
            asked.add(1)
            return super()._extract(prompt)

    def extractions(run):
        before = asked.value
        return changed(e, run), asked.value - before

    long = " ".join(f"Word{k} Alice Bob" for k in range(60))
    e = small(spark, tmp_path, provider=Counting())
    # part of the corpus first, then all of it
    assert extractions(lambda: e.index(corpus(spark, [*TEXTS, long]), max_chunks=2)) == (EVERY, 2)
    assert e.read("chunks").count() == 2 and e.status()["fully_indexed"]
    assert extractions(lambda: e.index(corpus(spark, [*TEXTS, long]))) == (EVERY, 2)
    assert e.read("chunks").select("doc_id").distinct().count() == 4 and e.status()["fully_indexed"]
    # another size of chunks: only the text that is cut anew is asked for
    e.config = EngineConfig(max_levels=2, gleaning_rounds=1, eval_runs=2, chunk_size=150, chunk_overlap=0)
    assert extractions(lambda: e.index(corpus(spark, [*TEXTS, long]))) == (EVERY, 2)
    # new documents before the others: chunks are numbered anew, and only the new ones are asked for
    docs = corpus(spark, [*TEXTS, long]).union(spark.createDataFrame([(-1, "Zora knows Alice")], "doc_id long, text string"))
    assert extractions(lambda: e.index(docs)) == (EVERY, 1)
    assert e.read("nodes").where("node_id = 'zora'").count() == 1
    assert e.read("vectors").count() == e.read("chunks").count() == 6
    # a setting of one stage: that one, and what it feeds
    e.config = replace(e.config, max_levels=1, level="c0")
    assert extractions(lambda: e.index(docs)) == ({"membership", "reports"}, 0)
    e.config = replace(e.config, min_entity_mentions=2)
    assert extractions(lambda: e.index(docs)) == ({"edges", "membership", "reports"}, 0)
    e.config = replace(e.config, gleaning_rounds=0)
    assert extractions(lambda: e.index(docs)) == ({"extractions", *(["edges", "membership", "reports"])}, 6)
    assert extractions(lambda: e.index(docs)) == (set(), 0)
    # a document that is gone leaves the graph
    assert extractions(lambda: e.index(corpus(spark, TEXTS)))[1] == 0 and e.read("nodes").where("node_id = 'zora'").count() == 0


def test_what_is_tried_again_reaches_the_graph(spark, tmp_path):
    class Refusing(RuleModel):
        def _extract(self, prompt):
            if "Quito" in prompt:
                raise ValueError("refused")
            return super()._extract(prompt)

    e = small(spark, tmp_path, provider=Refusing())
    e.index(corpus(spark, TEXTS))
    ids = lambda: {r.node_id for r in e.read("nodes").collect()}
    assert "quito" not in ids() and e.progress()["failed"] == 1 and e.progress()["extracted"] == 2
    # it fails once more: nothing follows from that
    assert changed(e, lambda: e.index(corpus(spark, TEXTS), retry_failed=True)) == {"extractions"} and e.status()["fully_indexed"]
    e.provider = RuleModel()
    assert changed(e, lambda: e.index(corpus(spark, TEXTS))) == set()
    assert changed(e, lambda: e.index(corpus(spark, TEXTS), retry_failed=True)) == {"extractions", "edges", "membership", "reports"}
    assert "quito" in ids() and e.progress()["failed"] == 0 and e.progress()["extracted"] == 3
    # extraction by itself leaves what depends on it out of date
    e.config = replace(e.config, gleaning_rounds=0)
    e.extract()
    assert e.status()["next"] == "graph_construction" and not e.status()["global_ready"]


def test_marks_and_resets(spark, tmp_path):
    e = small(spark, tmp_path)
    docs = corpus(spark, TEXTS)
    e.index(docs)
    states = lambda: {r.chunk_id: (r.status, r.detail) for r in e.chunk_states().collect()}
    done = lambda: {r.stage for r in e.stage_states().where("done").collect()}
    one = sorted(states())[0]
    assert {s for s, _ in states().values()} == {"extracted"} and done() == set(state.STAGES)
    e.mark_failed([one], "by hand")
    assert states()[one] == ("failed", "by hand")
    e.mark_extracted([one])
    assert states()[one] == ("extracted", None)
    e.reset_stage("community_detection")
    assert done() == set(state.STAGES) - {"community_detection"} and e.status()["next"] == "community_detection"
    assert changed(e, lambda: e.index(docs)) == {"membership"} and done() == set(state.STAGES)
    e.reset_stage("extraction")
    assert states() == {} and e.status()["next"] == "extraction" and e.read("chunks").count() == 3
    e.index(docs)
    assert len(states()) == 3 and e.status()["fully_indexed"]
    e.reset_all()
    assert done() == set() and e.status()["next"] == "chunking" and not e.status()["local_ready"]
    assert changed(e, lambda: e.index(docs, force=True)) == EVERY and done() == set(state.STAGES)
    assert e.vacuum(age=-1) > 5 and e.ask_global("Who knows Alice and Bob?", "c0")["helpful"] > 0


def test_hooks_hear_of_prompts_while_a_stage_runs(spark, tmp_path):
    class Slow(RuleModel):
        def _extract(self, prompt):
            time.sleep(0.4)
            if "Quito" in prompt:
                raise ValueError("refused")
            return super()._extract(prompt)

    e = small(spark, tmp_path, provider=Slow())
    heard, ended = [], []
    e.hooks = Hooks(asked=lambda name, answered, failed: heard.append((name, answered, failed, bool(ended))), chunks=lambda batch: ended.append(batch))
    e.chunk(corpus(spark, [*TEXTS, *(f"Text {k} of Ada" for k in range(9))]))
    tables.save(e.read("chunks").repartition(12), e.path("chunks"), key=e.key("chunks"))
    e.extract()
    counts = [(a, f) for name, a, f, over in heard if name == "extract" and not over]
    assert len(counts) >= 3 and counts == sorted(counts, key=sum) and counts[-1] == (11, 1) and any(0 < sum(c) < 12 for c in counts)


def test_extraction_of_arriving_documents(spark, tmp_path, monkeypatch):
    asked = []
    e = Engine(spark, str(tmp_path / "e"), EngineConfig(max_levels=2, gleaning_rounds=0), hooks=Hooks(asked=lambda name, ok, bad: asked.append((name, ok))))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(1)
    prompts = lambda: max((n for name, n in asked if name == "extract"), default=0)
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema(docs.schema).parquet(source)
    docs.where("doc_id < 2").write.parquet(source)
    # the run ends between its two writes; the batch is replayed
    with monkeypatch.context() as m:
        m.setattr(Engine, "note_extracted", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            e.extract_arriving(stream(), check)
    assert e.read("extractions").count() == prompts() == 2 and not e.has("state")
    asked.clear()
    query = e.extract_arriving(stream(), check)
    assert e.read("extractions").count() == e.read("state").where("event = 'extracted'").count() == 2 and prompts() == 0
    # a batch that was taken in as a whole
    e.extract_batch(docs.where("doc_id < 2"), (query.id, 0))
    assert tables.written(spark, e.path("extractions"), (query.id, 0))
    assert e.read("extractions").count() == e.read("state").count() == 2 and prompts() == 0
    # repeated rows, and rows that are known
    docs.where("doc_id > 0").union(docs.where("doc_id = 2")).write.mode("append").parquet(source)
    e.extract_arriving(stream(), check)
    assert sorted(r.chunk_id for r in e.read("extractions").collect()) == ["doc_0_0000", "doc_1_0000", "doc_2_0000"] and prompts() == 1
    asked.clear()
    e.index(docs)
    assert prompts() == 0 and e.status()["fully_indexed"] and "quito" in {r.node_id for r in e.read("nodes").collect()}
    assert e.progress()["extracted"] == 3


def test_permits(spark, tmp_path):
    """Two hundred partitions, three calls at a time at most, in any of them; what a task holds goes back when it ends."""

    class Model:
        def complete(self, prompts):
            mine = tmp_path / f"{os.getpid()}-{time.time_ns()}"
            mine.touch()
            time.sleep(0.05)
            (tmp_path / f"seen-{time.time_ns()}-{os.getpid()}").write_text(str(sum(not f.name.startswith("seen") for f in tmp_path.iterdir())))
            mine.unlink()
            return prompts

    rows = spark.range(400).selectExpr("cast(id as string) as p").repartition(200)
    out = completed(rows, "p", Model(), most=3)
    assert out.rdd.getNumPartitions() == 200 and out.where("response = p").count() == 400
    lent = permits.lender(spark, "Model", 3)
    assert 1 < lent.peak <= 3 and max(int(f.read_text()) for f in tmp_path.glob("seen*")) <= 3
    with pytest.raises(ValueError):
        with lent.permits.one():
            raise ValueError
    with pytest.raises(ConnectionError):
        with replace(lent.permits, token=b"x" * permits.TOKEN_BYTES).one():
            pass
    time.sleep(0.2)
    assert lent.lent == 0


def test_questions(engine):
    g = engine.ask_global("Who knows Alice and Bob?", "c0")
    assert g["helpful"] > 0 and "[Score: " in g["context"] and g["answer"]
    assert engine.ask_global("Who is there?", "c4")["answer"] == NO_DATA
    v = engine.ask_local("Where does Dora live in Quito?")
    assert v["chunks"][0][0] == 1 and v["context"].startswith("[Source: ") and [s for _, _, s in v["chunks"]] == sorted((s for _, _, s in v["chunks"]), reverse=True)


def test_evaluation(engine, spark):
    answers = spark.createDataFrame([(1, "q one", "a long answer with many words. And a second claim.", "short answer here"), (2, "q two", "same words", "same words")], "question_id int, question string, global string, local string")
    results, summary = engine.judge(answers, ["Diversity"])
    r = {x.question_id: x for x in results.collect()}
    assert (r[1].win_rate, r[1].majority, r[2].win_rate, r[2].ties) == (1.0, "global", 0.5, 3)
    assert summary.head().p_value == 0.125
    rows, batch = engine.compare_claims(answers)
    assert {x.question_id: x.winner for x in rows.collect()}[1] == "global" and batch.head().questions == 1


def test_usage(spark, tmp_path):
    """Tokens of each call once: those a provider states, else by white space; no call, no tokens; retries don't add up."""

    class Billed:
        model = "gpt-4o-mini-tuned"

        def __init__(self):
            self.calls = 0

        def complete(self, prompts):
            self.calls += 1
            if self.calls == 1:
                raise TransientError("busy")
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [Answer("yes indeed", 1_000_000 * len(p), 2_000_000) for p in prompts]

    rows = spark.createDataFrame([(1, "a"), (2, "bb bb"), (3, "bad")], "id int, p string").coalesce(1)
    got = {r.id: r for r in completed(rows, "p", Billed(), wait=0.0, usage=True).collect()}
    assert [(got[k].prompt_tokens, got[k].completion_tokens) for k in (1, 2, 3)] == [(1_000_000, 2_000_000), (5_000_000, 2_000_000), (None, None)]
    answers = completed(rows.where("id < 3"), "p", Billed(), wait=0.0, usage=True, mode="yes_no").collect()
    assert {r.response for r in answers} == {"YES"} and {r.completion_tokens for r in answers} == {2_000_000}
    plain = completed(spark.createDataFrame([("TASK: more\n### text\nabc",)], "p string"), "p", RuleModel(), usage=True).head()
    assert (plain.prompt_tokens, plain.completion_tokens) == (5, 1)

    e = Engine(spark, str(tmp_path / "usage"), provider=Billed())
    assert e.usage().count() == 0
    e.ask(rows.withColumnRenamed("p", "prompt"), "extract")
    e.ask(rows.where("false").withColumnRenamed("p", "prompt"), "report")
    assert e.provider.calls == 0  # tasks have copies of it
    e.provider.calls = 1
    assert e.ask_once("answer", "one two") == "yes indeed"
    used = {r.task: r for r in e.usage().collect()}
    assert set(used) == {"extract", "answer"}
    assert (used["extract"].prompt_tokens, used["extract"].completion_tokens) == (6_000_000, 4_000_000)
    assert used["extract"].cost == pytest.approx(6 * 0.15 + 4 * 0.60) and used["answer"].cost == pytest.approx(7 * 0.15 + 2 * 0.60)
    assert e.usage(("model",)).head().cost == pytest.approx(13 * 0.15 + 6 * 0.60)


def test_usage_of_an_index(engine, spark):
    """All chunks were asked once, however often the corpus was indexed since; the offline model costs nothing."""
    by = {r.task: r for r in engine.usage().collect()}
    assert {"extract", "more", "report"} <= set(by) and all(r.cost is None for r in by.values())
    before = engine.usage().agg(F.sum("prompt_tokens")).head()[0]
    engine.index(corpus(spark, TEXTS))
    assert engine.usage().agg(F.sum("prompt_tokens")).head()[0] == before


def test_warm(engine, spark):
    plan = lambda name: engine.read(name)._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(str, engine.read("reports").collect()))
    engine.warm()
    engine.warm("reports", "nodes")
    assert all("InMemoryTableScan" in plan(n) for n in ("reports", "nodes")) and "InMemoryTableScan" not in plan("edges")
    assert sorted(map(str, engine.read("reports").collect())) == rows
    # written anew: what is kept is not what is read
    tables.save(engine.read("nodes").limit(1), engine.path("copy"))
    copy = Engine(spark, engine.root)
    copy.warm("copy")
    tables.save(engine.read("nodes"), engine.path("copy"))
    assert copy.read("copy").count() == engine.read("nodes").count() > 1
    engine.invalidate()
    copy.invalidate("copy")
    assert not any("InMemoryTableScan" in plan(n) for n in ("reports", "nodes"))


def test_provider_failures(spark):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def complete(self, prompts):
            self.calls += 1
            if self.calls == 1:
                raise TransientError("busy")
            if any("bad" in p for p in prompts):
                raise ValueError("x" * 600)
            return [p.upper() for p in prompts]

    rows = completed(spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1), "p", Flaky(), wait=0.0).collect()
    assert [r.response for r in rows] == ["A", None, "C"] and len(rows[1].error) == 500 and rows[0].error is None
    assert RuleModel().complete(["TASK: more\n### text\nabc"]) == ["YES"]


def test_settings():
    for bad in ({"chunk_size": 50}, {"chunk_overlap": 301}, {"chunk_size": 100, "chunk_overlap": 100}, {"level": "c9"}, {"top_k": 0}, {"max_levels": 6}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    with pytest.raises(ValueError):
        checked_question(" a ")
    with pytest.raises(ValueError):
        checked_questions(["short"])
    with pytest.raises(ValueError):
        checked_criteria(["diversity", "Diversity"])
    assert len(checked_criteria(None)) == 4


def small(spark, path, **more):
    return Engine(spark, str(path), EngineConfig(max_levels=2, gleaning_rounds=1, eval_runs=2), **more)


def test_hooks_jobs_and_sizes(spark, tmp_path):
    seen = {"progress": [], "chunks": [], "reports": []}
    hooks = Hooks(**{k: (lambda *v, k=k: seen[k].append(v)) for k in seen})
    e = small(spark, tmp_path, hooks=hooks)
    e.index(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert [s for s, _ in seen["progress"]] == list(state.STAGES) and seen["progress"][-1][1] == 100.0
    (batch,) = seen["chunks"][0]
    assert (batch["total"], batch["successful"], batch["success_rate"]) == (3, 3, 1.0) and batch["entities"] > 5 and batch["chunks_per_second"] > 0
    assert sorted(level for level, _ in seen["reports"]) == ["c0", "c1"]
    assert [(r.kind, r.status) for r in e.jobs().collect()] == [("index", "completed")]
    again = small(spark, tmp_path)
    assert [r.status for r in again.jobs().collect()] == ["completed"] and again.jobs().head().run_id.startswith("job_")
    sizes = e.sizes()
    assert sizes["chunks"]["rows"] == 3 and sizes["nodes"]["bytes"] > 0 and small(spark, tmp_path / "none").sizes()["chunks"] is None
    total, page = e.reports_page("c0", 1, 1)
    assert total == e.read("reports").where("level = 'c0'").count() and page.count() == 1
    one = page.head().community_id
    assert e.report_by_id(one)["community_id"] == one and e.report_by_id("no") is None
    assert {r.rounds_completed for r in e.rounds_completed().collect()} <= {0, 1}


def test_failed_chunks_are_asked_again(spark, tmp_path):
    class Broken(RuleModel):
        def _extract(self, prompt):
            if "Quito" in prompt:
                raise ValueError("refused")
            return super()._extract(prompt)

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    e = small(spark, tmp_path, provider=Broken())
    e.chunk(docs)
    e.extract()
    failed = lambda: e.read("extractions").where("text is null").count()
    assert failed() == 1
    e.provider = RuleModel()
    before = e.read("extractions").count()
    e.extract()
    assert e.read("extractions").count() == before
    e.extract(retry_failed=True)
    done = e.read("extractions").where("round = 0 and text is not null")
    assert done.select("chunk_id").distinct().count() == 3 and failed() == 1
    e.extract(retry_failed=True)
    assert e.read("extractions").where("round = 0").count() == 4


def test_cancel(spark, tmp_path):
    e = small(spark, tmp_path)
    e.hooks = Hooks(progress=lambda stage, _: e.cancel() if stage == "chunking" else None)
    with pytest.raises(Cancelled):
        e.index(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert e.status()["done"]["chunking"] and not e.status()["done"]["extraction"]
    assert e.jobs().head().status == "cancelled"
    e.stopped = False
    e.hooks = Hooks()
    e.index(spark.createDataFrame([(0, "x")], "doc_id long, text string"))
    assert e.status()["fully_indexed"]


def test_evaluations_are_saved_and_listed(spark, tmp_path):
    e = small(spark, tmp_path)
    answers = spark.createDataFrame([(1, "q one", "a long answer with many words", "short"), (2, "q two", "x y z", "x")], "question_id int, question string, global string, local string")
    e.judge(answers, ["Diversity"])
    e.judge(answers, ["directness"])
    open_run = e.log("evaluation", "running", questions=9)
    total, page = e.evaluations(1, 2)
    assert total == 3 and [r.run_id for r in page.collect()][0] == open_run and page.collect()[1].criteria == ["directness"]
    other = small(spark, tmp_path)
    total, page = other.evaluations()
    assert total == 3 and sorted(r.status for r in page.collect()) == ["completed", "completed", "running"]
    run = page.where("status = 'completed'").orderBy("at").head()
    assert run.criteria == ["diversity"] and '"diversity":1.0' in run.details and other.evaluation(run.run_id).head().mean_win_rate == 1.0


def test_many_chunks_of_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(7_000_000_000_000, " ".join(["Word"] * 160_000)), (7_000_000_000_001, "Other words")], "doc_id long, text string")
    e = Engine(spark, str(tmp_path), EngineConfig(chunk_size=100, chunk_overlap=0))
    e.chunk(docs)
    rows = e.read("chunks").orderBy("chunk_ord").select("doc_id", "chunk_index", "chunk_ord").collect()
    assert [r.chunk_ord for r in rows] == list(range(1601)) and [r.chunk_index for r in rows] == [*range(1600), 0]


def test_provider_modes(spark):
    class Model:
        def complete(self, prompts):
            return ["text"] * len(prompts)

        def complete_json(self, prompts):
            return ['{"a": 1}'] * len(prompts)

    rows = spark.createDataFrame([("a",), ("b",)], "p string").repartition(8)
    ask = lambda **more: [r.response for r in completed(rows, "p", Model(), **more).collect()]
    assert ask() == ["text"] * 2 and ask(mode="json") == ['{"a": 1}'] * 2 and ask(mode="yes_no") == ["NO"] * 2
    assert completed(rows, "p", Model(), most=3).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert messages("p", "s", [("assistant", "x")]) == [{"role": "system", "content": "s"}, {"role": "assistant", "content": "x"}, {"role": "user", "content": "p"}]
    day = spark.sql("select timestamp'2024-03-01 12:30:00' as at").select(js.dumped(F.struct("at"))).head()[0]
    assert day.startswith('{"at":"2024-03-01T12:30:00')
