"""Facts of files: one fixture per kind of file."""

import pytest

from loomgraph.api import build
from loomgraph.functions import terms
from loomgraph.operators import analytics, code, extract, rules
from pyspark.sql import functions as F

FILES = "path string, file_name string, ext string, length bigint, content binary"


def files(spark, tree):
    rows = []
    for path, content in tree.items():
        raw = content if isinstance(content, bytes) else content.encode()
        name = path.rpartition("/")[2]
        ext = name.rpartition(".")[2] if "." in name[1:] else None
        rows.append((path, name, ext, len(raw), raw))
    return spark.createDataFrame(rows, FILES)


def facts(spark, tree, **more):
    return {tuple(r) for r in analytics.graph(build(files(spark, tree), **more)).collect()}


def deps(spark, path, text, **more):
    return {o for s, p, o in facts(spark, {path: text}, **more) if p == "dependsOn"}


CASES = {
    "r/pom.xml": ("<dependency>\n<groupId>org.testng</groupId>\n<artifactId>testng</artifactId>\n</dependency>\n<dependency>\n <artifactId>alone</artifactId>\n</dependency>\n<plugin>\n<artifactId>maven-surefire-plugin</artifactId>\n</plugin>", {"org.testng:testng", "alone"}),
    "r/build.gradle": ("implementation 'a.b:c:1.0'\ntestImplementation(\"d:e:2\")\nother 'x:y:z'\n", {"a.b:c", "d:e"}),
    "r/Cargo.toml": ("[package]\nname = \"x\"\n[dependencies]\nserde = \"1\"\n# no\ntokio = { version = \"1\" }\n[dev-dependencies]\ntempfile=\"3\"\n[profile.release]\nlto = true\n", {"serde", "tokio", "tempfile"}),
    "r/go.mod": ("module m\nrequire (\n\tgithub.com/a/b v1\n\t// no\n\tc.d/e v2 // indirect\n)\nrequire x.y/z v3\n", {"github.com/a/b", "c.d/e", "x.y/z"}),
    "r/Gemfile": ("source 'x'\ngem 'rails', '~> 6'\n  gem \"rspec\"\n", {"rails", "rspec"}),
    "r/requirements.txt": ("# c\nflask>=2\n-r other\nnumpy [x]\nrequests~=2 ; python\n", {"flask", "numpy", "requests"}),
    "r/pyproject.toml": ("[project.dependencies]\n\"a>=1\",\n[tool.poetry.dependencies]\npython = \"3\"\nb = \"1\"\n[tool.x]\nc = 1\n", {"a", "b"}),
    "r/composer.json": ('{"require": {"php": "8", "ext-x": "1", "v/p": "1"}, "require-dev": {"phpunit/phpunit": "9"}}', {"v/p", "phpunit/phpunit"}),
    "r/Pipfile": ("[packages]\nflask = \"*\"\n[requires]\npython_version = \"3\"\n[dev-packages]\npytest=\"*\"\n", {"flask", "pytest"}),
    "r/pubspec.yaml": ("name: x\ndependencies:\n  http: ^1\n  flutter:\n    sdk: flutter\ndev_dependencies:\n  test: any\nother:\n  no: 1\n", {"http", "test"}),
    "r/Package.swift": ('.package(url: "https://h/u/Repo.git", from: "1"),\n.package(path: "x")', {"Repo"}),
    "r/build.sbt": ('libraryDependencies += "org.g" %% "n" % "1"\nval x = "a"\n', {"org.g:n"}),
    "r/mix.exs": ('{:phoenix, "~> 1"}, {:ecto, github: "x"}', {"phoenix", "ecto"}),
    "r/a.csproj": ('<PackageReference Include="N.J" Version="1" />\n<PackageReference Include="X" />', {"N.J", "X"}),
    "r/Dockerfile": ("FROM node:18 AS b\nFROM scratch\nFROM nginx:latest\n", {"node:18", "nginx:latest"}),
    "r/docker-compose.yml": ("services:\n  a:\n    image: \"redis:7\"\n", {"redis:7"}),
    "r/p.spec": ("Name: pkg\nVersion: 1.0\nBuildRequires: gcc, make >= 3\nRequires: %{x}\nRequires: python3\n", {"gcc", "make", "python3"}),
    "r/package.json": ('{"name": "x", "dependencies": {"@a/b": "1"}, "devDependencies": {"jest": "1"}, "peerDependencies": {"p q": "1"}}', {"@a/b", "jest", "p_q"}),
}


@pytest.mark.parametrize("path", CASES)
def test_dependencies(spark, path):
    text, want = CASES[path]
    assert deps(spark, path, text) == want
    assert deps(spark, path, text.replace("\n", "\r\n")) == want


def test_debian_only_when_asked(spark):
    text = "Package: p\nDepends: a (>= 1) | b, ${misc:Depends},\n c\nOther: x\n y\n"
    assert deps(spark, "r/debian/control", text) == set()
    assert deps(spark, "r/debian/control", text, debian=True) == {"a", "c"}


def test_documents(spark):
    got = facts(spark, {
        "d/a.md": "# One\ntext\n## Two words ##\n###\n", "d/b.adoc": "= T\n== S\n==== no\n", "d/c.rst": "Head\n====\n\nlong heading\n---\nX\n~~~\n", "d/e.1": ".SH \"NAME\"\n.SH SEE ALSO\n",
        "d/f.css": "a:hover {\n}\n/* x {\n.b{\n", "d/g.html": 'x"y<p id="i d" class="u v">', "d/h.yaml": "# c\nkey: 1\n  in: 2\n- item\nplain line\n", "d/bad.md": b"# \xff\xfe", "d/empty.md": "",
    })
    of = lambda kind: {s for s, p, o in got if p == "a" and o == kind}
    assert of("Section") == {"d/a.md/One", "d/a.md/Two_words_##".replace("#", "_"), "d/b.adoc/T", "d/b.adoc/S", "d/c.rst/Head", "d/c.rst/X", "d/e.1/NAME", "d/e.1/SEE_ALSO"}
    assert of("Style") == {"d/f.css/a:hover", "d/f.css/.b"}
    assert of("Element") == {"d/g.html/#x", "d/g.html/#i_d", "d/g.html/.x", "d/g.html/.u", "d/g.html/.v"}
    assert {o for s, p, o in got if p == "declares"} == {"key", "plain_line"}
    assert of("Document") == {"d/a.md", "d/b.adoc", "d/c.rst", "d/e.1", "d/g.html", "d/empty.md"}


def test_binary_and_practices(spark):
    got = facts(spark, {"r/.github/workflows/ci.yml": "on: push\n", "r/logo.png": b"\x89PNG", "r/src/app/x.tsx": "", "r/tests/tox.ini": "", "r/a.service": "", "r/LICENSE": "", "r/mine.Dockerfile": "FROM a\n", "r/dbus/x.conf": ""})
    project = {(p, o) for s, p, o in got if s == "project"}
    assert {("usesCIPlatform", "github-actions"), ("usesTestFramework", "tox"), ("followsConvention", "systemd"), ("followsConvention", "dbus"), ("hasDocumentation", "license"), ("usesContainerization", "docker"), ("hasLayer", "source"), ("hasLayer", "tests")} == project
    assert {("r/logo.png", "hasMimeType", "image/png"), ("r/logo.png", "hasSize", "4"), ("r/logo.png", "a", "Binary")} <= got


def test_first_rule_wins(spark):
    paths = ["x/Dockerfile", "x/foo.Dockerfile", "x/debian/control", "x/PROJECT", "y" * 200 + "/PROJECT", "x/dbus/a.service", "x/biome.json", "x/none.txt"]
    rows = spark.createDataFrame([(p, p.rpartition("/")[2]) for p in paths], "p string, n string").select(rules.practice(F.col("p"), F.col("n")).alias("r")).collect()
    assert [r["r"]["o"] if r["r"] else None for r in rows] == ["docker", "docker", "deb", "operator-sdk", None, "systemd", "biome", None]


CODE = {
    "m.py": ("def hello():\n    greet('x')\n\ndef greet(n):\n    print(n.upper())\n\nclass Greeter:\n    def say(self):\n        return greet(1)\n", {"hello", "greet", "say"}, {"Greeter"}, {("hello", "greet"), ("greet", "print"), ("greet", "upper"), ("say", "greet")}),
    "l.rs": ("pub fn process() -> i32 {\n  helper(\"x(\"); println!(\"no\"); match v { Some(p) => a::b(p), _ => 1 }\n}\nfn helper(x: &str) {}\nstruct Config { a: i32 }\ntrait T { fn sig(&self); }\n", {"process", "helper"}, {"Config"}, {("process", "helper"), ("process", "b")}),
    "a.js": ("function render() { update(1); }\nconst f = () => other();\nclass App { constructor() { this.x = init(); } }\nfunction update(x) { if (x) { return new Foo(x); } }\n", {"render", "update"}, {"App"}, {("render", "update"), ("", "other"), ("", "init")}),
    "t.ts": ("interface Config { a: string }\nclass Server { start(): void { listen(); } }\nexport function make(c: Config): Server { return build(c); }\n", {"make"}, {"Config", "Server"}, {("", "listen"), ("make", "build")}),
    "g.go": ("package main\ntype S struct {\n}\nfunc (s *S) Run(a int) error {\n\thelper(a)\n\treturn fmt.Errorf(\"x\")\n}\nfunc helper(a int) {}\n", {"Run", "helper"}, {"S"}, {("Run", "helper"), ("Run", "Errorf")}),
    "J.java": ("package p;\npublic class App {\n  public App() { init(); }\n  public void run(List<String> x) throws E { helper(); this.log.info(\"a\"); new X(); }\n  static int helper() { return 1; }\n}\ninterface I { void go(); }\n", {"App", "run", "helper", "go"}, {"App", "I"}, {("App", "init"), ("run", "helper"), ("run", "info")}),
    "c.c": ("#include <x.h>\nstatic int helper(int a) { return a; }\nint main(void) {\n  if (helper(1)) { return sizeof(int); }\n  p->f(2);\n  return 0;\n}\n", {"helper", "main"}, set(), {("main", "helper"), ("main", "p-_f")}),
    "r.rb": ("class Foo\n  def bar(x)\n    baz(x)\n  end\n  def ok?\n    true\n  end\nend\n", {"bar", "ok?"}, {"Foo"}, {("bar", "baz")}),
    "p.php": ("<?php\nclass A { function m() { f(1); $this->g(); } }\nfunction f($x) { return strlen($x); }\n", {"m", "f"}, {"A"}, {("m", "f"), ("f", "strlen")}),
    "k.kt": ("class K { fun go() { work(1) } }\nfun work(x: Int) { println(x) }\n", {"go", "work"}, {"K"}, {("go", "work"), ("work", "println")}),
    "s.swift": ("struct P { func draw() { paint(1) } }\nfunc paint(_ x: Int) { }\n", {"draw", "paint"}, {"P"}, {("draw", "paint")}),
    "S.scala": ("object O { def run(x: Int) = { helper(x) }\n  def helper(y: Int): Int = y }\n", {"run", "helper"}, {"O"}, {("run", "helper")}),
    "b.sh": ("foo() {\n  bar\n}\nfunction baz {\n  foo\n}\n", {"foo", "baz"}, set(), set()),
    "u.lua": ("local function a(x)\n  return x\nend\nfunction M.b()\n  a(1)\nend\n", {"a", "M.b"}, set(), set()),
    "x.cs": ("class C { public void Run(int a) { Helper(a); this.log.Info(a); }\n  static int Helper(int x) => x; }\n", {"Run", "Helper"}, {"C"}, {("Run", "Helper"), ("Run", "Info")}),
    "q.cpp": ("class Q {};\nint Q::go(int a) { return run(a); }\nint run(int a) { return std::abs(a); }\n", {"go", "run"}, set(), {("go", "run"), ("run", "abs")}),
    "w.tsx": ("export function View(p: P) { return draw(p); }\n", {"View"}, set(), {("View", "draw")}),
}


@pytest.mark.parametrize("path", CODE)
def test_code(path):
    text, functions, classes, calls = CODE[path]
    language = code.EXTENSIONS[path.rpartition(".")[2]]
    got = code.facts(path, language, text)
    assert {s[len(path) + 1 :] for s, p, o in got if o == "Function"} == functions
    assert {s[len(path) + 1 :] for s, p, o in got if o == "Class"} == classes
    assert {(s[len(path) + 1 :], o) for s, p, o in got if p == "calls"} == calls


def test_tests_are_marked():
    java = "class T {\n @Test\n public void a() { x(); }\n public void b() { }\n}\n"
    marked = lambda path: {s.rpartition("/")[2] for s, p, o in code.facts(path, "java", java) if p == "isTestFunction"}
    assert marked("src/main/T.java") == {"a"} and marked("src/test/T.java") == {"a", "b"}


def test_callees():
    assert [code.simplify(x) for x in ("a.b.c", "a::b", "f<T>", "x.y[0]", "p->q", "a.b::c")] == ["c", "b", "f", "y", "p->q", "b::c"]


def test_identifiers(spark):
    rows = [("a b/c#d", "a_b/c_d", "a%20b/c%23d"), ("é", "_", "%C3%A9"), ("\U0001f600x", "_x", "%F0%9F%98%80x"), ("100%", "100_", "100%25"), ("a+b~(c)*", "a+b~(c)*", "a+b~(c)*"), ("", "", "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "x string")
    assert [tuple(r) for r in df.select("x", terms.iri_safe(F.col("x")), terms.iri_escape(F.col("x"))).collect()] == rows
    ids = spark.createDataFrame([("9a-b",), ("style",), ("\u00fcb",)], "x string").select(terms.to_id(F.col("x"))).collect()
    assert [r[0] for r in ids] == ["n9a_b", "styleEl", "\u00fcb"]
    split = spark.createDataFrame([("a/b/c/d.py",), ("b/d",), ("d",)], "x string").select(*terms.split_path(F.col("x"))).collect()
    assert [tuple(r) for r in split] == [("b/c", "d.py"), ("b", "d"), (".", "d")]
    ext = spark.createDataFrame([(".eslintrc.json",), ("x/.gitignore",), ("a.tar.gz",), ("Makefile",)], "x string").select(terms.extension(F.col("x"))).collect()
    assert [r[0] for r in ext] == ["json", None, "gz", None]


def test_facts_of_nothing(spark):
    empty = spark.createDataFrame([], FILES)
    assert extract.file_facts(empty, list(code.EXTENSIONS)).count() == 0 and code.code_facts(empty).count() == 0
    nulls = spark.createDataFrame([("a/x.md", None, "md", None, None), (None, None, None, None, None)], FILES)
    assert build(nulls).count() == 0


LONG = 100_000
LONG_FILES = {
    "r/Cargo.toml": "[dependencies]\n" + "\n".join(f'd{i} = "1"' for i in range(LONG)),
    "r/Pipfile": "[packages]\n" + "\n".join(f'd{i} = "*"' for i in range(LONG)),
    "r/pyproject.toml": "[tool.poetry.dependencies]\n" + "\n".join(f'd{i} = "1"' for i in range(LONG)),
    "r/go.mod": "require (\n" + "\n".join(f"\td{i} v1" for i in range(LONG)) + "\n)\n",
    "r/pubspec.yaml": "dependencies:\n" + "\n".join(f"  d{i}: ^1" for i in range(LONG)) + "\n",
    "r/debian/control": "Depends: d0,\n" + ",\n".join(f" d{i}" for i in range(1, LONG)) + "\n",
    "r/pom.xml": "<dependency>\n" + "\n".join(f"<x>{i}</x>" for i in range(LONG)) + "\n<artifactId>d</artifactId>\n</dependency>\n",
}


def test_long_sections(spark):
    """A section of 100,000 lines is one more file, not the end of the JVM."""
    got = extract.file_facts(files(spark, LONG_FILES), [], debian=True).filter("p = 'dependsOn'").distinct().groupBy("s").count()
    assert {r["s"]: r["count"] for r in got.collect()} == {p: 1 if p.endswith("pom.xml") else LONG for p in LONG_FILES}


def test_section_borders(spark):
    assert deps(spark, "r/go.mod", "require (\n\ta v1\nrequire (\n\tb v1\n)\nc v1\n)\n") == {"a", "b"}
    assert deps(spark, "r/go.mod", "module x\r\nrequire (\r\n\ta v1\r\n)\r\nreplace (\r\n\tz v1\r\n)\r\n") == {"a"}
    assert deps(spark, "r/pubspec.yaml", "dependencies:\n  a: 1\n\n  b: 1\n# top\n  c: 1\n") == {"a", "b"}
    assert deps(spark, "r/Cargo.toml", "[dependencies]\na=1\n  [x]\nb=1\n [dependencies] \nc=1\n[dependencies.d]\ne=1") == {"a", "c"}
    assert deps(spark, "r/debian/control", "Depends: a, b | c\n d\n\n e\nPackage: p\n", debian=True) == {"a", "b", "d"}
