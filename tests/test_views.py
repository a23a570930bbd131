"""Graph views, catalog, retrieval, grounding and storage."""

import pytest
from pyspark.sql import functions as F

from quarrymap.config import Config
from quarrymap.operators import answers, catalog, graph, retrieval, store, summary


def files(spark, *rows):
    """(path, importance, entry, test, category)"""
    return spark.createDataFrame([("r", *r) for r in rows], "analysis_id string, path string, importance_score double, is_entry_point boolean, is_test boolean, category string")


def edges(spark, *pairs):
    return spark.createDataFrame([("r", a, b, "m", 1) for a, b in pairs], "analysis_id string, source_path string, target_path string, imported_module string, line_number int")


def view(f, e, **options):
    got = graph.subgraph_nodes(f, e, **options).collect()
    return sorted(r.path for r in got), {r.truncated for r in got}


def test_subgraph_fill(spark):
    lone = [(f"n{k}", 90.0 - k, False, False, "X") for k in range(9)]
    f = files(spark, *lone, ("hub", 50.0, False, False, "X"), ("zlow", 1.0, False, False, "Y"), ("ztest", 1.0, False, True, "X"))
    e = edges(spark, ("hub", "zlow"), ("ztest", "hub"))
    assert len(view(f, e, limit=10)[0]) == 11 and len(view(f, e, limit=10, strict=True)[0]) == 10
    assert view(f, e, limit=10, category="Y") == (["hub", "zlow"], {False})
    assert view(f, e, limit=10, search=" HUB ", include_tests=True)[0] == ["hub", "zlow", "ztest"]
    assert view(f, e, limit=10, entry_points_only=True)[0] == []
    assert view(f, e, limit=12, include_tests=True) == (sorted([r[0] for r in lone] + ["hub", "zlow", "ztest"]), {False})
    assert view(f, edges(spark), limit=10) == (sorted([r[0] for r in lone] + ["hub"]), {True})


def test_edges_and_degrees(spark):
    resolved = spark.createDataFrame(
        [("r", "a", "b", "m", 1, ["x"], "high", True, 0, 0), ("r", "a", "b", "m", 1, ["y"], "high", True, 1, 0), ("r", "a", "b", "n", 2, ["z"], "high", True, 2, 0), ("r", "a", "a", "m", 1, [], "high", True, 3, 0), ("r", "a", None, "q", 1, [], "low", False, 4, 0)],
        "analysis_id string, source_path string, target_path string, imported_module string, line_number int, imported_names array<string>, confidence string, is_internal boolean, nth int, `try` int",
    )
    e = graph.dependency_edges(resolved)
    assert sorted((r.imported_module, r.imported_names) for r in e.collect()) == [("m", ["x"]), ("n", ["z"])]
    f = files(spark, ("a", 0.0, False, False, "X"), ("b", 0.0, False, False, "X"), ("c", 0.0, False, False, "X"))
    assert sorted(map(tuple, graph.degrees(f, e).collect())) == [("r", "a", 0, 1), ("r", "b", 1, 0), ("r", "c", 0, 0)]
    assert catalog.file_neighbours(e, f.filter("path = 'a'")).first().dependencies == ["b", "b"]


def test_impact(spark):
    f = files(spark, ("a", 0.0, False, False, "X"), ("b", 0.0, True, False, "X"), ("c", 0.0, False, True, "X"), ("d", 0.0, False, False, "X"))
    e = edges(spark, ("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("a", "d"))
    got = graph.change_impact(f, e, f.filter("path IN ('a', 'b')")).orderBy("selected_path").collect()
    assert (got[0].direct_dependents, got[0].second_level_dependents, got[0].related_tests, got[0].affected_entry_points) == (["b", "c"], ["d"], ["c"], ["b"])
    assert got[0].representative_paths == [["a", "b"], ["a", "b", "c"], ["a", "c"], ["a", "c", "d"]]
    none = graph.change_impact(f, e, spark.createDataFrame([("r", "zz")], "analysis_id string, path string")).first()
    assert none.direct_dependents == [] and none.representative_paths == []
    assert sorted((r.dependent, r.depth) for r in graph.reachable(e, f.filter("path = 'b'"), 3).collect()) == [("a", 3), ("c", 1), ("d", 2)]


def test_representative_paths_stop(spark):
    e = edges(spark, *[(f"d{k}", "s") for k in range(9)], *[(f"x{k}{j}", f"d{k}") for k in range(9) for j in range(3)], ("s", "d0"))
    got = graph.representative_paths(e, spark.createDataFrame([("r", "s")], "analysis_id string, path string")).orderBy("dep_rank", "step").collect()
    assert [len(r.nodes) for r in got] == [2, 3] + [2, 3, 3] * 4 and got[1].nodes == ["s", "d0", "x00"]


def test_pages(spark):
    f = files(spark, *[(f"p{k}", float(k % 3), k == 1, k == 2, "X") for k in range(7)])
    page = catalog.file_page(f, 2, 3).orderBy("position").collect()
    assert [r.path for r in page] == ["p4", "p0", "p3"] and page[0].total == 7
    assert [r.path for r in catalog.file_page(f, 1, 2, "path", "asc").orderBy("position").collect()] == ["p0", "p1"]
    assert catalog.filter_files(f, search="P_", entry_points=True).count() == 1 and catalog.filter_files(f, entry_points=False, tests=False).count() == 6
    with pytest.raises(ValueError):
        catalog.file_page(f, 0)
    with pytest.raises(ValueError):
        Config(graph_nodes=5)
    assert [r.path for r in summary.start_here(f.withColumn("importance_reason", F.lit("x")), 3).orderBy("rank").collect()] == ["p1", "p5", "p4"]


CHUNKS = "analysis_id string, chunk_id string, path string, symbol_name string, line_start int, line_end int, content string, search_text string, embedding array<float>"


def chunks(spark, *rows):
    return spark.createDataFrame([("r", i, p, s, 1, 20, t, f"{p}\n{t}", v) for i, p, s, t, v in rows], CHUNKS)


def test_scores_and_expansion(spark):
    c = chunks(spark, ("1", "app/auth.py", "Login", "login with password", [1.0, 0.0]), ("2", "app/other.py", None, "nothing here", [0.0, 1.0]), ("3", "t/test_auth.py", None, "zzz", None), ("4", "far.py", None, "zzz", None))
    q = spark.createDataFrame([("q", "r", "Login password in app/auth.py password")], "query_id string, analysis_id string, question string")
    got = {r.chunk_id: (round(r.score, 6), r.reasons) for r in retrieval.scored_chunks(c, q, 12).collect()}
    # concepts login, password twice and the path; the exact symbol Login; the path term
    assert got == {"1": (round(4 * 0.15 + 0.5 + 0.6, 6), ["exact_symbol", "exact_path"])}
    f = files(spark, ("app/auth.py", 1.0, False, False, "X"), ("app/other.py", 1.0, False, False, "X"), ("t/test_auth.py", 1.0, False, True, "X"), ("far.py", 1.0, False, False, "X"))
    e = edges(spark, ("app/auth.py", "app/other.py"), ("t/test_auth.py", "app/auth.py"))
    out = retrieval.hybrid_retrieve(c, f, e, q).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in out][1:] == [("2", 0.35), ("3", 0.25)] and out[1].reasons == ["graph_neighbor"]
    v = retrieval.vector_scores(c, q.withColumn("embedding", F.array(F.lit(1.0), F.lit(1.0))), k=2)
    assert sorted((r.chunk_id, round(r.score, 6)) for r in v.collect()) == [("1", 0.707107), ("2", 0.707107)]
    both = retrieval.scored_chunks(c, q, 12, v).filter("chunk_id = '2'").first()
    assert round(both.score, 6) == 0.707107
    headers = spark.createDataFrame([("q", "o/r", None, ["f"])], "query_id string, full_name string, description string, facts array<string>")
    context = retrieval.context_blocks(out_frame := retrieval.hybrid_retrieve(c, f, e, q), headers, 190).first().context
    assert context.startswith("Repository: o/r\nDescription: None\nStructural facts:\n- f\nSource evidence:\n---\nFile: app/auth.py lines 1-20 symbol=Login\n") and "other.py" not in context
    known = f.select("analysis_id", "path")
    answered = answers.ask(out_frame, headers, q, known, lambda question, context: {"answer": " yes ", "citations": ["app/auth.py"], "confidence": "high", "suggested_files": "far.py"}).first()
    assert (answered.answer, answered.confidence, answered.suggested_files, answered.citations[0].line_end) == ("yes", "high", ["far.py"], 20)


def test_citations(spark):
    got = spark.createDataFrame([("q", "app/auth.py", 10, 40, 1), ("q", "app/auth.py", 50, 60, 2)], "query_id string, path string, line_start int, line_end int, rank int")
    raw = '{"citations": [{"file_path": "app/auth.py", "line_start": 12, "line_end": 20}, {"file_path": "gone.py", "line_start": 1, "line_end": 2}, "app/auth.py", "gone.py", 123, {"file_path": "app/auth.py", "line_start": "x", "line_end": 2}, {"file_path": "app/auth.py", "line_start": 45, "line_end": 46, "reason": "why"}]}'
    rows = answers.citation_rows(spark.createDataFrame([("q", raw)], "query_id string, raw string"))
    kept = lambda strict: sorted((r.nth, r.line_start, r.line_end, r.reason) for r in retrieval.valid_citations(rows, got, strict).collect())
    base = "Referenced in evidence"
    assert kept(False) == [(0, 12, 20, base), (2, 10, 40, base), (6, 45, 46, "why")]
    assert kept(True) == [(0, 12, 20, base), (2, 10, 40, base)]


@pytest.mark.parametrize(("answer", "n", "confidence", "poor"), [("", 1, "low", True), (" x ", 0, "high", True), ("x", 0, "medium", False), ("x", 1, "high", False), (None, 1, None, True)])
def test_answers(spark, answer, n, confidence, poor):
    row = spark.createDataFrame([(answer, n, confidence)], "a string, n int, c string")
    got = row.select(answers.normalised(F.col("a"), F.col("n"), F.col("c"), F.array().cast("array<string>")).alias("x")).first().x
    assert (got.answer == answers.NO_ANSWER) is poor and (got.confidence == "low" or not poor) and len(got.limitations) == int(poor)


def test_overview(spark):
    raw = '{"project_purpose": "p", "main_components": [{"name": "", "files": ["a.py", "zz.py"]}], "start_here": [{"file_path": "zz.py"}, {"file_path": "a.py"}], "caveats": null}'
    o = spark.createDataFrame([(raw,)], "raw string").select(answers.valid_overview(F.col("raw"), F.array(F.lit("a.py"))).alias("o")).first().o
    assert o.main_components[0].name == "Component" and o.main_components[0].files == ["a.py"] and [s.file_path for s in o.start_here] == ["a.py"] and o.caveats == [] and o.architecture_summary == ""


def test_storage(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "analysis_id string, x int")
    store.save_partitioned(frame([("a", 1), ("b", 2)]), path)
    store.save_partitioned(frame([("a", 5)]), path)
    assert sorted((r.analysis_id, r.x) for r in spark.read.parquet(path).collect()) == [("a", 5), ("b", 2)]
    log = str(tmp_path / "log")
    store.append_rows(frame([("a", 1)]), log)
    store.append_rows(frame([("a", 2)]), log)
    assert spark.read.parquet(log).count() == 2
    assert store.latest(frame([("a", 1), ("a", 3), ("b", 2)]), ["analysis_id"], [F.desc("x")]).count() == 2
    capped = store.running_cap(frame([("a", 3), ("a", 4), ("a", 5)]), ["analysis_id"], ["x"], "x", 2, 100).orderBy("x").collect()
    assert [r.within for r in capped] == [True, True, False]
    ids = store.with_file_ids(edges(spark, ("a", "b"), ("a", "gone")), spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "analysis_id string, path string, file_id string"), "source_path", "target_path")
    assert [(r.source_file_id, r.target_file_id) for r in ids.collect()] == [("1", "2")]
    wanted = spark.createDataFrame([("r", "c", "1"), ("r", "d", "1")], "repository_id string, commit_sha string, analyzer_version string")
    done = spark.createDataFrame([("r", "c", "1", "completed", 2)], "repository_id string, commit_sha string, analyzer_version string, status string, attempt int")
    assert [r.commit_sha for r in catalog.cache_misses(wanted, done).collect()] == ["d"] and catalog.cache_misses(wanted, done, force=True).count() == 2
    assert sorted((r.commit_sha, r.attempt) for r in catalog.next_attempts(wanted, done).collect()) == [("c", 3), ("d", 1)]


def test_embeddings(spark):
    c = chunks(spark, *[(str(k), "p", None, "x" * 10, None) for k in range(5)], ("9", "p", None, "y", [5.0]))
    filled = store.fill_embeddings(c, lambda texts: [[float(len(t))] for t in texts], batch=2, chars=4)
    assert sorted(r.embedding[0] for r in filled.collect()) == [4.0] * 5 + [5.0]
