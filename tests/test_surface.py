"""The whole surface: a tree on disk, its history, reports, pages, search, diagrams, streaming."""

import subprocess

import pytest

from loomgraph.api import CodebaseGraph, excludes, page
from loomgraph.operators import analytics, gitlog, search
from loomgraph.sources import tree

TREE = {
    "src/main.py": "def hello():\n    greet()\n\ndef greet():\n    pass\n\ndef unused():\n    pass\n", "tests/test_main.py": "def test_hello():\n    hello()\n", "package.json": '{"name": "x", "dependencies": {"left": "1"}}', "README.md": "# Title\n## Use\n",
    ".github/workflows/ci.yml": "on: push\n", "Dockerfile": "FROM a:1\n", ".eslintrc.json": "{}", "LICENSE": "x", "docs/guide.md": "# Guide\n", "logo.png": "png", "build/out.py": "def skipped(): pass\n", ".gitignore": "build/\n*.log\n!keep.log\n", "x.log": "l", "keep.log": "k",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=Ann B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    for n in ("one", "two | three"):
        (folder / "src/main.py").write_text(TREE["src/main.py"] + f"# {n}\n")
        git("add", "-f", "src/main.py", "LICENSE")
        git("commit", "-qm", n)
    return str(folder)


@pytest.fixture(scope="module")
def indexed(spark, root):
    g = CodebaseGraph(spark)
    counts = g.ingest(root)
    assert counts["raw_count"] >= counts["distinct_count"] > 30
    return g


def test_listing(root):
    names = {p[len(root) + 1 :] for p in tree.list_paths(root)}
    assert names == set(TREE) - {"build/out.py", "x.log"}
    assert {p[len(root) + 1 :] for p in tree.list_paths(root, ["docs", "*.md"], hidden=False)} == {"src/main.py", "tests/test_main.py", "package.json", "Dockerfile", "LICENSE", "logo.png", "keep.log"}


def test_queries(indexed, root):
    g = indexed
    tail = lambda df, c: {r[c].rpartition("/")[2] for r in df.collect()}
    assert tail(g.find_symbol("greet"), "subject") == {"greet"}
    assert {tuple(x.rpartition("/")[2] for x in r) for r in g.find_callers("greet").collect()} == {("hello", "greet")}
    assert tail(g.find_callees("test_hello"), "callee") == {"hello"}
    assert tail(g.find_dead_code(["tests"]), "func") == {"unused"}
    assert {r["dependency"] for r in g.find_dependencies().collect()} == {"left", "a:1"}
    assert tail(g.find_entry_points(), "subject") >= {"hello", "greet", "unused"}
    kinds = {r["type"]: r["count"] for r in g.file_stats().collect()}
    assert kinds["Function"] == 4 and kinds["Commit"] == 2 and kinds["Section"] == 3
    p = g.query_page("PREFIX r: <http://repo.example.org/> SELECT ?s WHERE { ?s r:a r:Function } ORDER BY ?s", 3, 0)
    assert p["total"] == 4 and p["returned"] == 3 and p["has_more"] and p["next_offset"] == 3 and "1\u20133 of 4" in p["message"]
    rest = page(g.file_stats(), 50, 100)
    assert rest["returned"] == 0 and not rest["has_more"]
    with pytest.raises(AttributeError):
        g.nothing


def test_reports(indexed):
    report = indexed.describe()
    assert report["practices"]["ci_cd"] == ["github-actions"] and "eslint" in report["code_quality"]["linters"]
    assert report["testing"]["total_functions"] == 4 and report["architecture"]["counts"]["binary_assets"] == 1
    assert report["activity"]["total_commits"] == 2 and report["activity"]["contributors"][0] == {"name": "Ann_B", "commits": 2}
    assert report["activity"]["most_active_files"][0] == {"file": "src/main.py", "commits": 2}
    assert [c["message"] for c in report["activity"]["recent_commits"]].count("two___three") == 1
    assert any("early-stage" in x for x in report["insights"])


def test_insights_are_capped_and_ordered():
    full = {
        "practices": {"packaging_formats": ["rpm"], "config_management": ["ansible"]}, "testing": {"frameworks": ["pytest"], "test_ratio_percent": 30},
        "ci_cd": {"ci_platforms": ["packit"], "containerization": ["docker"], "build_tools": ["maven-surefire", "maven-failsafe"], "deployment_platforms": ["fly"]},
        "code_quality": {"linters": ["a"], "formatters": ["b"], "code_analysis": ["c"], "conventions": ["devfile-x", "version-pinning", "fedora-gating", "systemd", "selinux", "olm-operator"]},
        "architecture": {"layers": list("abcde"), "is_monorepo": True, "package_managers": ["npm"]}, "documentation": {"documentation_artifacts": ["contributing-guide", "security-policy", "codeowners"]}, "dependencies": {"has_automated_updates": True},
        "activity": {"total_commits": 10, "contributors": [{"name": "x", "commits": 9}, {"name": "y", "commits": 1}]},
    }
    said = analytics.insights(full)
    assert len(said) == 12 and said[0].startswith("Uses devfile") and said[1].startswith("30% test ratio")
    small = {"activity": full["activity"]}
    assert [x.split(":")[0] for x in analytics.insights(small)] == ["2 contributor(s) across 10 indexed commits — early-stage development history.", "Bus factor risk"]
    assert analytics.insights({"activity": {"total_commits": 10, "contributors": [{"name": "x", "commits": 8}, {"name": "y", "commits": 2}]}})[-1].startswith("2 contributor")


def test_store(spark):
    g = CodebaseGraph(spark)
    assert g.query("ASK { ?s ?p ?o }").first()[0] is False
    g.insert("a", "calls", "b")
    g.insert("a", "calls", "b")
    g.insert("c d", "calls", "b")
    assert g.facts.count() == 2 and g.query("ASK { ?s ?p ?o }").first()[0] is True
    g.clear()
    assert g.facts.count() == 0
    with pytest.raises(ValueError):
        g.refresh()


def test_diagram(indexed):
    text = indexed.generate_diagram(code_only=False)
    for part in ("specification {", "file main_py 'main.py' {", "technology 'Python'", "func greet 'greet'", "-[calls]->", "external left 'left'", "-[dependsOn]-> left 'depends on'", "view index {"):
        assert part in text, part
    shallow = indexed.generate_diagram(depth=1)
    assert "-[calls]->" not in shallow and "element file" not in shallow
    assert indexed.generate_diagram(depth=3, limit=1).count("func ") <= 2


def test_pattern_search():
    py = "x = foo(1, bar(2))\nif a == a:\n    foo(x)\n# foo(3)\ns = 'foo(4)'\n"
    assert search.find(py, "foo($$$ARGS)", "python") == [(1, "foo(1, bar(2))"), (3, "foo(x)")]
    assert search.find(py, "$A == $A", "python") == [(2, "a == a")]
    assert search.find("let y = a.b.c(1);\n", "$X.c($Y)", "javascript") == [(1, "a.b.c(1)")]
    assert search.find("a(1); a(1, 2);", "a($X)", "javascript") == [(1, "a(1)")]
    assert search.find("f(x, x); f(x, y);", "f($A, $A)", "c") == [(1, "f(x, x)")]
    assert search.find("", "f($A)", "c") == [] and search.find("f(1)", "", "c") == []


def test_pattern_search_over_files(spark, root):
    found = search.search(tree.read_tree(spark, root), "hello()", "py", ["nothing"]).collect()
    assert [(r["line"], r["text"]) for r in found] == [(1, "hello()"), (2, "hello()")] or {(r["line"], r["text"]) for r in found} >= {(2, "hello()")}
    with pytest.raises(ValueError):
        search.search(tree.read_tree(spark, root), "x", "cobol")


def test_hidden_folders_above_the_root_do_not_hide(spark):
    rows = [("/x/.cache/r/a.py", "a.py", "py", 4, b"f(1)"), ("/x/.cache/r/.h/b.py", "b.py", "py", 4, b"f(2)"), ("/x/.cache/r/c.py", "c.py", "py", None, None)]
    df = spark.createDataFrame(rows, tree.FILES)
    assert [r["text"] for r in search.search(df, "f($A)", "python", root="/x/.cache/r").collect()] == ["f(1)"]


def test_indexing_a_remote(spark, root, tmp_path):
    g = CodebaseGraph(spark)
    for _ in range(2):  # cloned, then pulled
        assert g.index_repo("file://" + root, str(tmp_path))["distinct_count"] > 0
    assert g.describe("activity")["total_commits"] == 1


def test_log_without_a_checkout(spark, tmp_path):
    commits, touched = tree.read_log(spark, str(tmp_path))
    assert commits.count() == 0 and touched.count() == 0


def test_file_aggregates(spark):
    commits = spark.createDataFrame([(1, "h1", "B b", "2024-01-02", "m"), (2, "h2", None, "2025-01-01", None), (2, "h2", None, "2025-01-01", None)], "seq int, hash string, author string, date string, message string")
    files = spark.createDataFrame([(1, "h1", "f x"), (2, "h2", "f x"), (2, "h2", "f x"), (2, "h2", "g"), (2, "h2", None)], "seq int, hash string, file string")
    got = {r["file"]: tuple(r)[1:] for r in gitlog.file_git_info(commits, files).collect()}
    assert got == {"f_x": ("B_b", "2024-01-02", 2, ["B_b"]), "g": (None, "2025-01-01", 1, [])}


def test_streaming(spark, root, tmp_path):
    from loomgraph.streaming.ingest import stream_facts

    source, target = str(tmp_path / "in"), str(tmp_path / "graph")
    files = tree.read_tree(spark, root)
    for _ in range(2):  # the second batch brings nothing new
        files.write.mode("append").parquet(source)
        stream_facts(spark.readStream.schema(files.schema).parquet(source), target, str(tmp_path / "state")).awaitTermination()
    kept = spark.read.parquet(target)
    assert kept.count() == kept.distinct().count() > 20


def test_exclude_texts():
    assert excludes(" a, ,b ") == ["a", "b"] and excludes(None) == []
