"""Operators on small rows, against plain Python and the semantics they state."""

import itertools
import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import subwords
from corpuscle.functions import text as tx
from corpuscle.operators import chunking, claims, community, costs, evaluate, extract, graph, reports, state, vector


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).head()[0]


# ---- tokens ----


@pytest.mark.parametrize("n, want", [(0, []), (1, [0]), (600, [0]), (601, [0, 500]), (1100, [0, 500]), (1101, [0, 500, 1000]), (1300, [0, 500, 1000])])
def test_chunk_starts(spark, n, want):
    words = [f"w{k % 97}" for k in range(n)]
    docs = spark.createDataFrame([(1, "  ".join(words))], "doc_id long, text string")
    rows = chunking.chunk(docs, F.lit("d")).orderBy("chunk_index").collect()
    assert [r.text for r in rows] == [" ".join(words[s : s + 600]) for s in want]
    plain = " ".join(words)
    assert all(plain[r.start_char : r.end_char] == r.text and r.total_chunks == len(want) for r in rows)
    assert [r.chunk_id for r in rows] == [f"d_{k:04d}" for k in range(len(want))]


def test_chunk_parameters(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    for size, overlap in ((0, 0), (5, 5), (5, 6), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunk(docs, F.lit("d"), size, overlap)
    assert [r.text for r in chunking.chunk(docs, F.lit("d"), 3, 1).orderBy("chunk_index").collect()] == ["a b c", "c d e", "e f g"]
    assert chunking.chunk(docs, F.lit("d"), 3, 1, limit=2).count() == 2 and chunking.chunk(docs, F.lit("d"), 3, 1, limit=0).count() == 3


def test_fill_stops_at_first_overflow(spark):
    rng = random.Random(0)
    rows = [(g, k, rng.randint(0, 9)) for g in range(5) for k in range(20)]
    df = spark.createDataFrame(rows, "g int, k int, c int")
    got, alone = ({(r.g, r.k) for r in chunking.fill(df.repartition(7), F.col("c"), 40, ["k"], ["g"], 1, spread).collect()} for spread in (True, False))
    want = set()
    for g in range(5):
        used = 0
        for _, k, c in [r for r in rows if r[0] == g]:
            used += c + (1 if k else 0)
            if used > 40:
                break
            want.add((g, k))
    assert got == alone == want


def test_pack(spark):
    items = spark.createDataFrame([("a", 1, "x y"), ("a", 2, "z"), ("a", 3, "w w w w w w w w"), ("b", 1, "q " * 20)], "g string, k int, text string")
    got = {r.g: r for r in chunking.pack(items, 8, "g", ["k"]).collect()}
    assert (got["a"].context, got["a"].included, got["a"].used_tokens, got["a"].truncated) == ("x y\n\nz", 2, 3, True)
    assert (got["b"].context, got["b"].included, got["b"].truncated) == ("", 0, True)


def test_text_expressions(spark):
    t = F.col("t")
    assert one(spark, tx.truncated(t, tx.tokens("t"), 3), t="a b c d e") == "a b [TRUNCATED]"
    assert one(spark, tx.truncated(t, tx.tokens("t"), 1), t="a b c") == "[TRUNCATED]"
    assert one(spark, tx.truncated(t, tx.tokens("t"), 3), t="a b c") == "a b c"
    assert one(spark, tx.shortened(t, tx.tokens("t"), 0), t="a b") == ""
    assert one(spark, tx.shortened(t, tx.tokens("t"), 3), t="a b c d") == "a b…"
    for text in ("", "a", "ab" * 3, "x" * 10, "y" * 14):
        assert one(spark, tx.approx_tokens("t"), t=text) == (max(1, round(len(text) / 4)) if text else 0)
    assert one(spark, tx.cleaned("t"), t=" \n ") == " " and one(spark, tx.cleaned("t"), t="a\nb ") == "a b"
    assert one(spark, tx.node_id("t"), t="  Café  Öl! _x_ ") == "café_öl__x" and one(spark, tx.node_id("t"), t="!!") == ""


def test_lcs_and_rouge(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", tx.lcs_length("a", "b").alias("n"), tx.lcs_length("b", "a").alias("m"), tx.rouge_l("a", "b").alias("f")).collect():
        assert r.n == r.m == claims._lcs(r.a, r.b)
        assert r.f == pytest.approx(claims.rouge_l(r.a, r.b))
    assert claims._lcs(list("abcde"), list("ace")) == 3


def test_tokenizer_seam(spark):
    letters = tx.Tokenizer(lambda c: F.filter(F.split(c, ""), lambda x: x != ""), "")
    docs = spark.createDataFrame([(1, "abcdefg")], "doc_id long, text string")
    rows = chunking.chunk(docs, F.lit("d"), 3, 1, tokenizer=letters).orderBy("chunk_index").collect()
    assert [r.text for r in rows] == ["abc", "cde", "efg"] and all("abcdefg"[r.start_char : r.end_char] == r.text for r in rows)
    items = spark.createDataFrame([("a", 1, "abc"), ("a", 2, "defg")], "g string, k int, text string")
    assert chunking.pack(items, 3, "g", ["k"], tokenizer=letters).head().context == "abc"


def test_subwords(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    tokenizer = subwords.Subwords(path)
    rng = random.Random(5)
    texts = [None, "", "  \n", "one", " Straße,  naïve\t漢字かな \U0001f600\U0001f680 end "] + ["".join(rng.choice(["ab", " ", "xyz-", "é", "漢", "\n", "\U0001f600"]) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunking.chunk(docs, F.lit("d"), 7, 2, tokenizer=tokenizer).orderBy("doc_id", "chunk_index").collect():
        assert texts[r.doc_id][r.start_char : r.end_char] == r.text and r.chunk_id == f"d_{r.chunk_index:04d}"
        got.setdefault(r.doc_id, []).append((r.start_char, r.end_char, r.token_count))
    counts = {r.doc_id: r.n for r in docs.select("doc_id", tokenizer.count("text").alias("n")).collect()}
    for k, text in enumerate(texts):
        spans = library.encode(text or "", add_special_tokens=False).offsets
        want, start = [], 0
        while spans and (start == 0 or start + 2 < len(spans)):
            held = spans[start : start + 7]
            want.append((held[0][0], held[-1][1], len(held)))
            start += 5
        assert got.get(k, []) == want and counts[k] == len(spans), k
    items = spark.createDataFrame([("a", 1, "abc"), ("a", 2, "漢字 " * 50)], "g string, k int, text string")
    assert chunking.pack(items, 20, "g", ["k"], tokenizer=tokenizer).head().context == "abc"
    assert tokenizer.key == "subwords:word_bpe_49k.json"
    with pytest.raises(ValueError):
        chunking.chunk(docs, F.lit("d"), 3, 3, tokenizer=tokenizer)


def test_subwords_are_looked_up_once(spark, monkeypatch):
    """Windows are evaluated once a row, and a piece that was seen isn't encoded again; both give what the whole text gives."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    plan = chunking.chunk(docs, F.lit("d"), 7, 2, tokenizer=subwords.Subwords(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    rng = random.Random(9)
    signs = [*"aAbé'sSßİΣσ́ \t\n  \u0085\x1c\x1f᠎​1２㍿ﬁ漢字한!?<|>_", "<|startoftext|>", "'ll", "'S", "E\u0301", "x" * 70]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["strength, " * 3000]
    whole = [subwords.offsets(path, t) for t in texts]
    assert [subwords.windows_of(path, t, 7, 2) for t in texts] == [subwords.cut(t, spans, 7, 2) for t, spans in zip(texts, whole)]
    assert [subwords.count_of(path, t) for t in texts] == list(map(len, whole))
    seen = []
    monkeypatch.setattr(subwords, "offsets", lambda p, t, f=subwords.offsets: seen.append(len(t)) or f(p, t))
    assert subwords.windows_of(path, texts[-1], 600, 100) and max(seen) < 20


def test_numbers_and_batches(spark):
    rows = spark.range(0, 100, 1, 7).selectExpr("99 - id as k")
    got = chunking.batches(rows, ["k"], 30).collect()
    assert {r.k: r.batch for r in got} == {k: k // 30 for k in range(100)}
    with pytest.raises(ValueError):
        chunking.batches(rows, ["k"], 0)
    many = spark.range(5000).selectExpr("id as k", "'w w w w' as text", "'a' as g").repartition(9)
    got = chunking.pack(many, 40, "g", ["k"], index=F.col("k")).head()
    assert got.indices == list(range(10)) and got.included == 10 and got.truncated


# ---- vectors ----


def test_topk_batch_equals_plain(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = vector.top_k_batch(df, df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 7).collect()
    for q in range(0, 300, 50):
        score = lambda v: sum(a * b for a, b in zip(v, rows[q][1]))  # noqa: B023, E731
        want = sorted(rows, key=lambda r: (-score(r[1]), r[0]))[:7]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [k for k, _ in want]
    assert [r.vec_id for r in vector.top_k(df, rows[0][1], 7).orderBy("rank").collect()] == [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)]
    with pytest.raises(Exception, match="other than 5"):
        vector.checked(df, 5).select("embedding").collect()


def test_vector_add_and_norm(spark):
    old = spark.createDataFrame([(0, "a"), (5, "b")], "index_id long, t string")
    assert sorted(r.index_id for r in vector.added(old, spark.createDataFrame([(0, "c"), (1, "d")], "index_id long, t string")).collect()) == [0, 5, 6, 7]
    assert one(spark, tx.normalised("v"), v=[3.0, 4.0]) == [0.6, 0.8] and one(spark, tx.normalised("v"), v=[0.0, 0.0]) == [0.0, 0.0]


# ---- records ----


def test_record_parser(spark):
    text = '("entity"<|>OpenAI<|>organization<|> makes models )##  ( "Relationship" <|>A<|>B<|>knows<|>9) ##(entity<|>x)##claim<|>s<|>t<|>d<|>TRUE<|>N/A<|> 2021 ##()##<|COMPLETE|>##("entity"<|>no<|>no<|>no)'
    rows = extract.records(spark.createDataFrame([(1, text), (2, ""), (3, None)], "chunk_id long, text string"))
    assert [tuple(r)[2:] for r in extract.entities(rows).collect()] == [("OpenAI", "ORGANIZATION", "makes models")]
    assert [tuple(r)[2:] for r in extract.relationships(rows).collect()] == [("A", "B", "knows", 9)]
    assert [tuple(r)[2:] for r in extract.claims(rows).collect()] == [("s", "t", "d", "TRUE", None, "2021")]


def test_strengths(spark):
    values = {"7": 7, "7.9": 7, "-3": 1, "999": 10, "many": 5, "5d": 5, "nan": 5, "": 5, "1e1": 10}
    text = "##".join(f"relationship<|>a<|>b<|>d<|>{v}" for v in [*values, "inf", "-Infinity"])
    rows = extract.relationships(extract.records(spark.createDataFrame([(1, text)], "chunk_id long, text string"))).orderBy("pos").collect()
    assert [r.strength for r in rows] == list(values.values())


def test_rounds_merge(spark):
    rows = [(1, 0, 1, "A"), (1, 0, 2, "a"), (1, 1, 1, " A "), (1, 1, 2, "B"), (1, 2, 1, "b"), (1, 2, 2, "C"), (2, 1, 1, "A")]
    got = extract.merged_rounds(spark.createDataFrame(rows, "chunk_id int, round int, pos int, name string"), [extract.normal("name")])
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[1], rows[3], rows[5], rows[6]]


def test_extraction_results(spark):
    rows = spark.createDataFrame([(1, 4, 2, 0, True), (2, 2, 1, 1, True), (3, 9, 9, 9, False)], "chunk_id int, entities int, relationships int, claims int, extraction_completed boolean")
    r = extract.batch_result(rows, 2.0).head()
    assert (r.total, r.successful, r.entities, r.chunks_per_second) == (3, 2, 6, 1.5) and r.success_rate == pytest.approx(2 / 3)
    assert extract.batch_result(rows.where("false"), 0.0).head().success_rate == 0.0
    named = spark.createDataFrame([(1, 3, "b"), (1, 1, "A"), (1, 2, "a "), (2, 9, "a")], "g int, pos int, name string")
    assert sorted((r.g, r.name) for r in extract.distinct_in_order(named, extract.normal("name"), ["pos"], ["g"]).collect()) == [(1, "A"), (1, "b"), (2, "a")]
    assert [(r.entity_type, r.n) for r in extract.types_of(spark.createDataFrame([("X",), ("Y",), ("Y",)], "entity_type string")).collect()] == [("Y", 2), ("X", 1)]


# ---- graph ----


def graph_of(spark):
    e = [(0, 0, "Alpha", "ORG", "d1"), (0, 1, "Beta", "PERSON", ""), (1, 0, "ALPHA ", "GEO", "d2"), (1, 1, "alpha", "GEO", "d1"), (2, 0, "Gamma!", "X", "d"), (2, 1, "!!", "X", "d"), (3, 0, "Lone", "X", "d")]
    r = [(0, 2, "Alpha", "Beta", "r1", 3), (1, 2, "BETA", "alpha", "r2", 6), (1, 3, "Alpha", "alpha ", "self", 1), (2, 2, "Alpha", "Nobody", "r", 1), (2, 3, "Gamma", "beta", "", 9)]
    c = [(0, 5, "Gamma", "too early"), (2, 5, "Gamma", "late"), (3, 1, "Alpha", "c"), (3, 2, "Nobody", "x")]
    ent = spark.createDataFrame(e, "chunk_ord long, pos int, name string, entity_type string, description string")
    rel = spark.createDataFrame(r, "chunk_ord long, pos int, source_entity string, target_entity string, description string, strength int")
    cl = spark.createDataFrame(c, "chunk_ord long, pos int, subject_entity string, claim_description string")
    nodes = graph.nodes(ent, cl)
    return nodes, graph.edges(rel, nodes), ent, rel


def test_graph_merge(spark):
    nodes, edges, ent, rel = graph_of(spark)
    n = {r.node_id: r for r in nodes.collect()}
    assert set(n) == {"alpha", "beta", "gamma", "lone"}
    a = n["alpha"]
    assert (a.name, a.entity_type, a.description, a.mention_count, a.n_chunks, a.claims) == ("ALPHA ", "GEO", "d1 d2", 3, 2, ["c"])
    assert sorted((r.node_id, r.chunk_ord) for r in graph.provenance(ent, "name").collect()) == [("alpha", 0), ("alpha", 1), ("beta", 0), ("gamma", 2), ("lone", 3)]
    assert {(r.src, r.dst, r.chunk_ord) for r in graph.provenance(rel, "source_entity", "target_entity").collect()} >= {("alpha", "beta", 0), ("alpha", "beta", 1), ("beta", "gamma", 2)}
    assert graph._texts(ent.withColumn("ord", graph._ord()).withColumn("k", F.lit(1)), ["k"], budget=4).head().description == "d1 d2"[:2]
    assert n["beta"].description == "Entity: Beta" and n["gamma"].claims == ["late"]
    e = {(r.src, r.dst): r for r in edges.collect()}
    assert set(e) == {("alpha", "beta"), ("beta", "gamma")}
    assert (e["alpha", "beta"].weight, e["alpha", "beta"].avg_strength, e["alpha", "beta"].description) == (2.0, 4.5, "r1 r2")
    d = {r.node_id: r.degree for r in graph.degrees(nodes, edges).collect()}
    assert d == {"alpha": 1, "beta": 2, "gamma": 1, "lone": 0}
    assert all(r.combined_degree == d[r.src] + d[r.dst] for r in graph.combined_degrees(edges, graph.degrees(nodes, edges)).collect())
    assert {r.node_id for r in graph.nodes(ent, min_mentions=2).collect()} == {"alpha"}
    s = graph.stats(nodes, edges).head()
    assert (s.nodes, s.edges, s.avg_degree, s.max_degree) == (4, 2, 1.0, 2)


def cliques(spark, n=3, size=4):
    rows = [(f"n{c}_{a}", f"n{c}_{b}", 5.0) for c in range(n) for a, b in itertools.combinations(range(size), 2)] + [(f"n{c}_0", f"n{c + 1}_0", 1.0) for c in range(n - 1)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{c}_{a}",) for c in range(n) for a in range(size)] + [("alone",)], "node_id string")
    return nodes, edges


def test_hierarchy_of_cliques(spark):
    nodes, edges = cliques(spark)
    runs = [sorted(map(tuple, community.hierarchy(nodes.repartition(k), edges.repartition(k), max_size=3).collect())) for k in (1, 3)]
    assert runs[0] == runs[1]
    for level in ("c0", "c1", "c2"):
        of = {n: c for n, lv, c in runs[0] if lv == level}
        assert len(of) == 13
        if level == "c0":
            assert len({of[f"n{c}_{a}"] for c in range(3) for a in range(4)}) == 3 and all(len({of[f"n{c}_{a}"] for a in range(4)}) == 1 for c in range(3))
    parent = {r.child: r.parent for r in community.parents(community.hierarchy(nodes, edges, max_size=3)).collect()}
    c0, c1 = ({n: c for n, lv, c in runs[0] if lv == x} for x in ("c0", "c1"))
    assert all(parent[c1[n]] == c0[n] for n in c0)


def karate_like(seed, n=60, groups=4):
    rng = random.Random(seed)
    links = []
    for a, b in itertools.combinations(range(n), 2):
        if rng.random() < (0.4 if a % groups == b % groups else 0.03):
            links.append((f"v{a:02d}", f"v{b:02d}", float(rng.randint(1, 3))))
    return [f"v{k:02d}" for k in range(n)], links


def plain_modularity(names, links, label):
    k, total, inside = dict.fromkeys(names, 0.0), sum(w for *_, w in links), 0.0
    for a, b, w in links:
        k[a] += w
        k[b] += w
        inside += w * (label[a] == label[b])
    volumes = {}
    for n in names:
        volumes[label[n]] = volumes.get(label[n], 0.0) + k[n]
    return inside / total - sum(v * v for v in volumes.values()) / (2 * total) ** 2


def is_connected(members, links):
    seen, stack = set(), [min(members)]
    while stack:
        at = stack.pop()
        if at not in seen:
            seen.add(at)
            stack += [b if a == at else a for a, b, _ in links if at in (a, b) and {a, b} <= members]
    return seen == members


@pytest.mark.parametrize("seed", range(6))
def test_leiden_of_a_small_graph(seed):
    names, links = karate_like(seed)
    got = dict(zip(names, community.clustered(names, links)))
    planted = {n: k % 4 for k, n in enumerate(names)}
    q = plain_modularity(names, links, got)
    assert q >= plain_modularity(names, links, planted) - 1e-9
    for c in set(got.values()):
        assert is_connected({n for n in names if got[n] == c}, links)
    # no single node gains by moving, and no two communities by merging
    for n in names:
        for c in set(got.values()):
            assert plain_modularity(names, links, got | {n: c}) <= q + 1e-6
    for c, d in itertools.combinations(sorted(set(got.values())), 2):
        assert plain_modularity(names, links, {n: d if x == c else x for n, x in got.items()}) <= q + 1e-6


def test_leiden_over_dataframes(spark):
    names, links = karate_like(1)
    nodes, edges = spark.createDataFrame([(n,) for n in [*names, "alone"]], "node_id string"), spark.createDataFrame(links, "src string, dst string, weight double")
    best = plain_modularity(names, links, dict(zip(names, community.clustered(names, links))))
    for most in (0, 60):
        got = {r.node_id: r.label for r in community.leiden(edges, nodes, task_edges=most).collect()}
        assert set(got) == {*names, "alone"} and list(got.values()).count(got["alone"]) == 1
        assert plain_modularity(names, links, got) >= (0.9 if most else 0.8) * best
        assert all(is_connected({n for n in names if got[n] == c}, links) for c in set(got.values()) - {got["alone"]})
        rows = spark.createDataFrame(list(got.items()), "node_id string, label string")
        assert community.modularity(edges, rows) == pytest.approx(plain_modularity(names, links, got))


def test_moving_takes_one_stored_table_a_round(spark, monkeypatch):
    """Modularity comes from the round's own table; labels are numbers of nodes, however often the graph is coarsened."""
    names, links = karate_like(2)
    number = {n: k for k, n in enumerate(names)}
    edges = spark.createDataFrame([(number[a], number[b], w) for a, b, w in links], "src long, dst long, weight double")
    labels = spark.createDataFrame([(k, k) for k in range(len(names))], "node_id long, label long")
    kept, cut = [], community.cut_lineage
    monkeypatch.setattr(community, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    with monkeypatch.context() as m:
        m.setattr(community, "modularity", None)
        got = {r.node_id: r.label for r in community.local_moving(edges, labels).collect()}
    assert set(got) == set(range(len(names))) and set(got.values()) <= set(got)
    assert len(kept) > 4 and all("mine" in c for c in kept[2:])
    rows = [(number[a], number[b], w) for a, b, w in links]
    assert plain_modularity(list(got), rows, got) > plain_modularity(list(got), rows, {k: k for k in got}) + 0.1


def test_one_level(spark):
    nodes, edges = cliques(spark)
    rows = community.one_level(nodes, edges).collect()
    sizes = {}
    for r in rows:
        sizes[r.community_id] = sizes.get(r.community_id, 0) + 1
    assert {r.level for r in rows} == {"c1"} and [sizes[f"comm_c1_{k:04d}"] for k in range(4)] == [4, 4, 4, 1]
    assert community.one_level(nodes.where("false"), edges.where("false")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(f"a{k:02d}", f"a{k + 1:02d}") for k in range(30)] + [("x", "y"), ("z", "y"), ("q", "q")], "src string, dst string")
    got = {r.node_id: r.component for r in community.components(edges).collect()}
    assert got == {**{f"a{k:02d}": "a00" for k in range(31)}, "x": "x", "y": "x", "z": "x"}


# ---- reports ----


def test_map_points(spark):
    texts = {1: '{"points":[{"description":" a ","score":75.9},{"description":"b","score":"75"},{"description":"c","score":"75.9"},{"description":"d","score":null},{"description":"e","score":true},{"description":"f","score":999},{"description":"g"},{"score":3},4]}', 2: "```json\n{\"points\": [{\"description\": \"x\", \"score\": 5}]}\n```", 3: "no", 4: "[1]", 5: 'a {"points": [{"description": "y", "score": 7}]} b', 6: "", 7: None, 8: "{broken}"}
    got = reports.map_points(spark.createDataFrame(list(texts.items()), "community_id long, response string")).orderBy("community_id", "pos").collect()
    assert [(r.community_id, r.description, r.score) for r in got] == [(1, "a", 75), (1, "b", 75), (1, "c", 0), (1, "d", 0), (1, "e", 1), (1, "f", 100), (1, "g", 0), (2, "x", 5), (5, "y", 7)]


def test_report_parser(spark):
    full = json.dumps({"title": "T", "summary": "S", "rating": 99, "findings": [{"summary": str(k)} for k in range(15)]})
    rows = spark.createDataFrame([(1, 3, full), (2, 3, "x"), (3, 3, '{"rating": "bad"}'), (4, 2, '{"findings": [1, {"summary": "k"}]}')], "community_id long, node_count int, response string")
    r = {x.community_id: x for x in reports.parsed_reports(rows).collect()}
    assert (r[1].title, r[1].impact_rating, len(r[1].findings)) == ("T", 10.0, 10)
    assert r[2].impact_rating == 0.0 and "generation failed" in r[2].title
    assert r[3].impact_rating == 5.0 and r[3].findings[0].explanation == "Community 3 contains 3 entities."
    assert [(f.finding_id, f.summary) for f in r[4].findings] == [(1, "k")]


# ---- evaluation ----


def test_judgments(spark):
    def rate(winners):
        rows = [(1, "c", k, "global", "local", w, 80, 50) for k, w in enumerate(winners)]
        return evaluate.criterion_results(spark.createDataFrame(rows, "question_id int, criterion string, run_index int, system_a string, system_b string, winner string, score_a int, score_b int")).head()

    g, v, t = "global", "local", "tie"
    for winners, want, majority in (([g] * 5, 1.0, g), ([v] * 5, 0.0, v), ([t] * 5, 0.5, t), ([g, g, g, v, v], 0.6, g)):
        r = rate(winners)
        assert (r.win_rate, r.majority, r.avg_first, r.avg_second) == (want, majority, 80.0, 50.0)
    rows = spark.createDataFrame([(1, '{"winner":"a","score_a":80,"score_b":"60"}'), (0, '{"winner":"A"}'), (1, "bad"), (0, '{"winner": 3, "score_a": "x"}')], "coin int, response string")
    got = evaluate.unswapped(evaluate.parsed_judgments(rows)).collect()
    assert [(r.winner, r.score_a, r.score_b) for r in got] == [(g, 80, 60), (v, 50, 50), (t, 50, 50), (t, 50, 50)]


def test_statistics(spark):
    for n in (1, 5, 40, 900):
        for k in (0, 1, n // 2, n):
            want = sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
            assert one(spark, evaluate.binomial_tail("k", "n"), k=k, n=n) == pytest.approx(want, rel=1e-8)
    diffs = [3, -1, 0, 2, 2, -2, 5, 0, -7]
    r = evaluate.signed_ranks(spark.createDataFrame([("x", d) for d in diffs], "g string, d int"), "d", ["g"]).head()
    real = sorted((abs(d) for d in diffs if d))
    rank = lambda x: sum(i + 1 for i, y in enumerate(real) if y == x) / real.count(x)
    assert (r.n, r.w_plus, r.w_minus) == (7, sum(rank(abs(d)) for d in diffs if d > 0), sum(rank(abs(d)) for d in diffs if d < 0))
    assert (r.zeros, r.tied) == (2, 24)
    assert one(spark, evaluate.signed_rank_p("w", "n"), w=300.0, n=25) < 0.001
    for n in (1, 2, 7, 12):
        sums = [sum(i + 1 for i in range(n) if m >> i & 1) for m in range(2**n)]
        for w in (0, 1, n, n * (n + 1) // 2):
            assert one(spark, evaluate.signed_rank_p("w", "n"), w=float(w), n=n) == pytest.approx(sum(x >= w for x in sums) / 2**n)
    # beyond the exact range, and with ties, the normal approximation is near it
    exact, near = (one(spark, evaluate.signed_rank_p("w", "n", "t"), w=800.0, n=50, t=t) for t in (0, 1))
    assert exact == pytest.approx(near, abs=2e-3)
    counts = spark.createDataFrame([(5, 1), (4, 2), (9, 9), (3, 0)], "claims_first int, claims_second int")
    p = evaluate.compared_counts_p(counts).head()
    assert p.n == 3 and 0 < p.p_value < 0.1 and evaluate.compared_counts_p(counts.where("claims_first = 9")).head().p_value is None


def test_binomial_tail_takes_time_in_proportion(spark):
    got = one(spark, evaluate.binomial_tail("k", "n"), k=500_500, n=1_000_000)
    z = (500_500 - 0.5 - 500_000) / 500
    assert got == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-3)


# ---- claims ----


def test_claim_folds(spark):
    texts = ["the cat sat on the mat today", "the cat sat on the mat today", "a dog ran across the wide field", "completely different words appear here", "the cat sat on a mat today"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "q int, pos int, claim string")
    assert [r.pos for r in claims.deduplicated(df, ["q"]).orderBy("pos").collect()] == [0, 2, 3]
    counts = {r.threshold: r.clusters for r in claims.cluster_counts(df, ["q"]).collect()}
    assert all(counts[a] >= counts[b] for a, b in itertools.pairwise(sorted(counts)))
    for t in (0.5, 0.7):
        assert claims.clustered(df, ["q"], t).select("cluster").distinct().count() == counts[t]
    parsed = claims.parsed(spark.createDataFrame([(1, '{"claims": [" long enough claim ", "short", 5, null]}'), (2, "{}"), (3, "x")], "q int, response string"), "q").collect()
    assert [(r.q, r.claim) for r in parsed] == [(1, "long enough claim")]


# ---- state and costs ----


def test_state(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert sorted(r.k for r in state.pending(ids(1, 2, 3, 4), ids(1), ids(2), "k").collect()) == [3, 4]
    assert sorted(r.k for r in state.pending(ids(1, 2, 3, 4), ids(1), ids(2), "k", retry_failed=True).collect()) == [2, 3, 4]
    log = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "extracted"), ("b", 1, "failed")], "k string, at int, status string")
    assert {r.k: r.status for r in state.latest(log, "k", "at", "status").collect()} == {"a": "extracted", "b": "failed"}
    p = state.progress(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), state.latest(log, "k", "at", "status"), "k").head()
    assert (p.total, p.extracted, p.failed, p.pending, p.percent) == (3, 1, 1, 1, 33.3)
    assert state.progress(log.where("false").select("k"), log.where("false"), "k").head().percent == 0.0
    with pytest.raises(ValueError):
        state.pages(log, ["k"], 0, 10)


def test_runs_listed(spark):
    a = spark.createDataFrame([("r1", 3, "running"), ("r2", 1, "done")], "id string, at int, status string")
    b = spark.createDataFrame([("r2", 1, "old"), ("r3", 2, "done")], "id string, at int, status string")
    both = state.merged_runs(a, b, "id")
    assert [(r.id, r.status) for r in state.newest(both, "at").collect()] == [("r1", "running"), ("r3", "done"), ("r2", "done")]
    total, page = state.counted(both, ["id"], 2, 2)
    assert total == 3 and [r.id for r in page.collect()] == ["r3"]
    done = dict.fromkeys(state.STAGES, True)
    assert state.ready(done) == {"fully_indexed": True, "global_ready": True, "local_ready": True}
    assert state.ready(done | {"embedding": False}) == {"fully_indexed": False, "global_ready": True, "local_ready": False}


def test_prices(spark):
    calls = spark.createDataFrame([("gpt-4o", 1_000_000, 0), ("gpt-4o-mini-new", 1_000_000, 0), ("who", 1_000_000, 1_000_000)], "model string, prompt_tokens long, completion_tokens long")
    assert [r.cost_usd for r in costs.priced(calls).collect()] == [2.5, 0.15, 40.0]
    assert [r.cost_usd for r in costs.priced(calls, longest=False).collect()] == [2.5, 2.5, 40.0]
    assert costs.pricing(spark).count() == len(costs.PRICES)


def test_communities_beyond_one_task_are_moved_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(community, "SPLIT_NODES", 8)
    cliques = [(f"{c}{i}", f"{c}{k}", 1.0) for c in "ab" for i in range(6) for k in range(i + 1, 6)]
    edges = spark.createDataFrame([*cliques, ("a0", "b0", 1.0), ("c0", "c1", 1.0)], "src string, dst string, weight double")
    names = [f"{c}{i}" for c in "ab" for i in range(6)]
    labels = spark.createDataFrame([(n, "x") for n in names] + [("c0", "y"), ("c1", "y")], "node_id string, label string")
    got = {r.node_id: r.label for r in community.split(edges, labels, 7).collect()}
    assert set(got) == {*names, "c0", "c1"} and got["c0"] == got["c1"] == "y"
    assert len({got[n] for n in names}) > 1 and all(got[n].startswith("x/") for n in names)


def test_descriptions_are_whole(spark):
    """Three million characters of different descriptions of one node, in its row and in parts."""
    words = spark.range(31_000).selectExpr("'Hub' as name", "'CONCEPT' as entity_type", "concat('d', id, '-', repeat('x', 90)) as description", "id as chunk_ord", "0 as pos").repartition(7)
    want = " ".join(f"d{k}-" + "x" * 90 for k in range(31_000))
    assert graph.nodes(words).head().description == want
    assert len(graph.nodes(words, text_budget=1000).head().description) <= 1000
    pairs = words.selectExpr("'A' as source_entity", "'B' as target_entity", "description", "1.0 as strength", "chunk_ord", "pos")
    assert graph.edges(pairs).head().description == want
    for part in (1000, 1_000_000):
        rows = graph.description_parts(graph.mentions(words), ["node_id"], part=part).orderBy("part").collect()
        assert " ".join(r.description for r in rows) == want and len({r.part for r in rows}) == len(rows) > 2
        assert all(len(r.description) <= part + 100 for r in rows)


def test_batch_search_by_grid(spark):
    """Twenty thousand queries: one scan of the vectors in the plan, and the same hits as by plain products."""
    rng = np.random.default_rng(1)
    vectors, queries = np.round(rng.normal(size=(700, 8)), 3), np.round(rng.normal(size=(20_000, 8)), 3)
    vectors[100:120] = vectors[5]  # ties
    v = spark.createDataFrame([(k * 3, x.tolist()) for k, x in enumerate(vectors)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(queries)], "query_id long, embedding array<float>")
    found = vector.top_k_batch(v, q, 3, vector_block=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and plan.count("Scan ExistingRDD") == 2
    got = np.full((20_000, 3), -1)
    rows = found.toPandas()
    got[rows["query_id"], rows["rank"] - 1] = rows["vec_id"]
    score = np.round(queries.astype(np.float32).astype(float) @ vectors.astype(np.float32).astype(float).T, 4)
    want = np.lexsort((np.broadcast_to(np.arange(700), score.shape), -score), axis=1)[:, :3] * 3
    assert (got == want).all()
    few = vector.top_k_batch(v, q.limit(50), 3)
    assert few.count() == 150 and vector.top_k_batch(v, q.where("false"), 3).count() == 0 and vector.top_k_batch(v.where("false"), q, 3).count() == 0


def test_small_blocks_grow_and_scores_are_bounded(monkeypatch):
    """Each vector goes to a bounded number of tasks; a worker multiplies a bounded number of scores at a time."""
    assert [vector.blocks(n, 4, 4096, 8) for n in (0, 3, 9, 32, 100, 32_768, 40_960)] == [1, 1, 3, 8, 8, 8, 10]
    assert vector.blocks(1_000_000, 65_536, 65_536, 64) == 16 and vector.blocks(20_000, 10_000, 4096, 8) == 2
    rng = np.random.default_rng(2)
    queries, vectors = rng.normal(size=(50, 8)), rng.normal(size=(1000, 8))
    monkeypatch.setattr(vector, "CELLS", 50 * 64)
    held, sizes = vector._Best(np.arange(50), queries, 5), []
    add = held._add
    held._add = lambda k, v: sizes.append(len(k)) or add(k, v)
    held.add(np.arange(1000), vectors)
    score = np.round(queries @ vectors.T, 4)
    assert max(sizes) == 64 and (held.keys == np.lexsort((np.broadcast_to(np.arange(1000), score.shape), -score), axis=1)[:, :5]).all()


def test_pairs_of_whole_documents(spark, sf):
    """The same pairs as from mentions in order, without a shuffle, and edges from them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = extract.adjacent_in(docs)
    columns = ["chunk_ord", "pos", "source_entity", "target_entity", "description", "strength"]
    want = extract.adjacent(extract.mentions(docs))
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, graph.edges(found).collect())) == sorted(map(tuple, graph.edges(want).collect()))


def test_isolated_nodes_reach_no_task(spark):
    nodes = spark.range(50_000).select(F.format_string("n%06d", "id").alias("node_id"))
    edges = spark.createDataFrame([("n000001", "n000002", 1.0), ("n000002", "n000003", 1.0), ("n000007", "n000007", 1.0)], "src string, dst string, weight double")
    labels = community.leiden(edges, nodes)
    plan = labels._jdf.queryExecution().toString()
    sizes = labels.groupBy("label").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert {(r["count"], r["n"]) for r in sizes} == {(1, 49_997), (3, 1)} and "FlatMapGroupsInPandas" in plan


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_folds(texts, threshold, distance):
    kept, keep, members, labels = [], [], [], []
    score = lambda a, b: 2 * plain_lcs(a, b) / (len(a) + len(b)) if a and b else 0.0
    for t in texts:
        w = t.split()
        keep.append(all(score(w, k) <= threshold for k in kept))
        kept += [w] * keep[-1]
        best, of = -1.0, -1
        for c, group in enumerate(members):
            for other in group:
                if score(w, other) > best:
                    best, of = score(w, other), c
        if of < 0 or best < 1 - distance:
            of = len(members)
            members.append([])
        members[of].append(w)
        labels.append(of)
    return keep, labels


@pytest.mark.parametrize("threshold, distance", [(0.85, 0.7), (0.5, 0.3), (0.0, 1.0), (1.0, 0.0)])
def test_claim_folds_are_exact(spark, threshold, distance):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(120)] + ["", "", "!"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "q int, pos int, claim string")
    keep, labels = plain_folds([t.replace("!", "") for t in texts], threshold, distance)
    assert sorted(r.pos for r in claims.deduplicated(rows, ["q"], threshold).collect()) == [k for k, x in enumerate(keep) if x]
    assert {r.pos: r.cluster for r in claims.clustered(rows, ["q"], distance).collect()} == dict(enumerate(labels))


def test_five_thousand_claims_of_one_answer(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(rng.randint(5, 25))) for _ in range(5000)]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "q int, pos int, claim string").coalesce(1)
    began = time.perf_counter()
    assert 0 < claims.deduplicated(rows, ["q"]).count() <= 5000
    assert time.perf_counter() - began < 10
    began = time.perf_counter()
    assert claims.clustered(rows, ["q"], 0.5).select("cluster").distinct().count() > 1
    assert time.perf_counter() - began < 20


def test_groups_are_linked_without_pairs(spark, sf):
    """Components from each document's names as a group, and heads in one pass, are those of all edges and nodes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    members = extract.linked_in(docs)
    edges = graph.edges(extract.adjacent_in(docs), texts=False, chunks=False).select("src", "dst").localCheckpoint()
    assert sorted(map(tuple, community.linked(members).collect())) == sorted(map(tuple, community.components(edges).collect()))
    heads = graph.heads(extract.mentions(docs))
    assert sorted(map(tuple, heads.collect())) == sorted(map(tuple, graph.nodes(extract.mentions(docs)).select("node_id", "name", "entity_type").collect()))
    rng, rows = random.Random(3), []
    for _ in range(60):
        group = rng.sample(range(150), rng.randint(2, 4))
        rows += [(f"{k:03d}", f"{min(group):03d}") for k in group]
    got = {r.node_id: r.component for r in community.linked(spark.createDataFrame(rows, "node_id string, least string").distinct()).collect()}
    want = {r.node_id: r.component for r in community.components(spark.createDataFrame([(b, a) for a, b in rows], "src string, dst string")).collect()}
    assert got == want and len(set(got.values())) > 3
    assert community.linked(members.where("false")).count() == 0


def test_one_pass_for_heads_and_members(spark, sf):
    """The texts are read once for the heads of nodes, and once for what components are made from."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (graph.heads(extract.mentions(docs)), extract.linked_in(docs)):
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_blocks_that_move_at_once(spark, monkeypatch):
    """Forty cliques over many blocks: moving finds them, in rounds of a few, with each node's edges inside its label."""
    monkeypatch.setattr(community, "BLOCK_ENDS", 100)
    links = [(5 * c + i, 5 * c + k, 1.0) for c in range(40) for i in range(5) for k in range(i)] + [(5 * c, (5 * c + 5) % 200, 0.1) for c in range(40)]
    edges, labels = spark.createDataFrame(links, "src long, dst long, weight double"), spark.range(201).select(F.col("id").alias("node_id"), F.col("id").alias("label"))
    kept, cut = [], community.cut_lineage
    monkeypatch.setattr(community, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    rows = community.local_moving(edges, labels)
    got = {r.node_id: r for r in rows.collect()}
    assert len(got) == 201 and len(kept) <= 22
    assert len({got[n].label for n in range(200)}) <= 40 and all(len({got[5 * c + i].label for i in range(5)}) == 1 for c in range(40))
    assert got[7].d == 4 and got[7].w == 4.0 and got[200].label == 200 and got[200].w == 0.0
    parts = community.refined(edges, rows, 1).collect()
    assert {r.node_id: r.label for r in parts} == {n: got[n].label for n in got}
    assert all(is_connected({r.node_id for r in parts if r.part == p}, links) for p in {r.part for r in parts})


def test_groups_are_clustered_as_graphs_of_their_own(spark):
    """Two cliques with a link between them stay apart in their group, however heavy another group is."""
    pair = [(f"{c}{i}", f"{c}{k}", 1.0) for c in "ab" for i in range(4) for k in range(i)] + [("a0", "b0", 1.0)]
    edges = spark.createDataFrame([*pair, ("x", "y", 1000.0)], "src string, dst string, weight double")
    groups = spark.createDataFrame([(f"{c}{i}", "g") for c in "ab" for i in range(4)] + [("x", "h"), ("y", "h")], "node_id string, `group` string")
    got = {r.node_id: r.label for r in community.leiden(edges, groups.select("node_id"), groups=groups).collect()}
    assert len({got[f"{c}{i}"] for c in "ab" for i in range(4)}) == 2 and got["a1"] != got["b1"]


def test_parts_of_communities(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (3, 5), (8, 9)], "src long, dst long").repartition(3)
    rows = [(n, 0, 0) for n in (1, 2, 3, 5, 6)] + [(n, 0, 1) for n in (8, 9)] + [(n, 1, 0) for n in (1, 2, 5, 6)] + [(3, 1, 1), (8, 1, 2), (9, 1, 3)]
    got = {(r.node_id, r.level): r.part for r in community.parts(edges, spark.createDataFrame(rows, "node_id long, level int, community_id long")).collect()}
    assert got == {**{(n, 0): 1 for n in (1, 2, 3, 5, 6)}, (8, 0): 8, (9, 0): 8, (1, 1): 1, (2, 1): 1, (5, 1): 5, (6, 1): 5, (3, 1): 3, (8, 1): 8, (9, 1): 9}
