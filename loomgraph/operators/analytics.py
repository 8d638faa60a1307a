"""Ready-made analytics over a graph (s, p, o; distinct, local names).

Arguments are bound as literals.  ``exclude`` names directories: a row whose subject's
full identifier has one as a component is left out.  Lists are sorted so that results
are defined.  Reports gather one-row aggregates: practice values and counts of kinds come
from one scan each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.terms import iri, iri_escape

#: Report label -> predicate of the project.
CATEGORIES = {
    "ci_cd": "usesCIPlatform", "testing": "usesTestFramework", "linting": "usesLinter", "formatting": "usesFormatter", "build_tools": "usesBuildTool", "containerization": "usesContainerization", "package_managers": "usesPackageManager",
    "type_checking": "usesTypeChecking", "architecture_layers": "hasLayer", "documentation": "hasDocumentation", "conventions": "followsConvention", "deployment_platforms": "usesDeploymentPlatform", "code_analysis": "usesCodeAnalysis",
    "packaging_formats": "usesPackagingFormat", "config_management": "usesConfigManagement",
}
#: Part of a dependency's name -> test framework.
TEST_PATTERNS = {
    "testng": "testng", "junit-jupiter": "junit", ":junit": "junit", "mockito": "mockito", "assertj": "assertj", "hamcrest": "hamcrest", "cucumber": "cucumber", "rest-assured": "rest-assured", "selenium": "selenium", "arquillian": "arquillian", "spock": "spock",
    ":jest": "jest", ":vitest": "vitest", ":mocha": "mocha", ":cypress": "cypress", ":playwright": "playwright", "pytest": "pytest", "rspec": "rspec", "minitest": "minitest", "testify": "testify", "ginkgo": "ginkgo", "gomega": "gomega",
}
ENTRY_POINTS = "/(main|index|app|server|cli|cmd)"
TOP_FILES, RECENT, MOST_INSIGHTS = 20, 10, 12


def graph(triples: DataFrame) -> DataFrame:
    """The set of facts: rows with a null part are none, repeated rows count once."""
    return triples.select("s", "p", "o").dropna().distinct()


def full(c: Column) -> Column:
    return iri(iri_escape(c))


def excluded(c: Column, exclude: list[str] | None) -> Column:
    return reduce(Column.__and__, [~full(c).contains(f"/{d}/") for d in exclude or []], F.lit(True))


def _edges(g: DataFrame, predicate: str) -> DataFrame:
    return g.filter(F.col("p") == predicate)


def find_symbol(g: DataFrame, name: str, exclude: list[str] | None = None) -> DataFrame:
    return _edges(g, "a").filter(full(F.col("s")).contains(name) & excluded(F.col("s"), exclude)).select(F.col("s").alias("subject"), F.col("o").alias("type"))


def find_callers(g: DataFrame, name: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    e = _edges(g, "calls").filter(excluded(F.col("s"), exclude))
    return (e if name is None else e.filter(full(F.col("o")).contains(name))).select(F.col("s").alias("caller"), F.col("o").alias("callee"))


def find_callees(g: DataFrame, name: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    e = _edges(g, "calls").filter(excluded(F.col("s"), exclude))
    return (e if name is None else e.filter(full(F.col("s")).contains(name))).select(F.col("s").alias("caller"), F.col("o").alias("callee"))


def list_structures(g: DataFrame, path: str | None = None, kind: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    e = _edges(g, "a").filter(excluded(F.col("s"), exclude))
    if path is not None:
        e = e.filter(full(F.col("s")).contains(path))
    if kind is not None:
        e = e.filter(F.col("o") == kind)
    return e.select(F.col("s").alias("subject"), F.col("o").alias("type")).orderBy("subject", "type")


def file_stats(g: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """How many subjects there are of each kind."""
    return _edges(g, "a").filter(excluded(F.col("s"), exclude)).groupBy(F.col("o").alias("type")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def find_dead_code(g: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Functions whose last path segment nothing calls."""
    functions = _edges(g, "a").filter((F.col("o") == "Function") & excluded(F.col("s"), exclude)).select(F.col("s").alias("func"))
    called = _edges(g, "calls").select(F.col("o").alias("callee")).distinct()
    return functions.join(called, F.substring_index("func", "/", -1) == F.col("callee"), "left_anti").orderBy("func")


def find_dependencies(g: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    return _edges(g, "dependsOn").filter(excluded(F.col("s"), exclude)).select(F.col("s").alias("file"), F.col("o").alias("dependency")).orderBy("file", "dependency")


def find_entry_points(g: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    return _edges(g, "a").filter(full(F.col("s")).rlike(ENTRY_POINTS) & excluded(F.col("s"), exclude)).select(F.col("s").alias("subject"), F.col("o").alias("type"))


def practices(g: DataFrame) -> DataFrame:
    """label, value: every practice of the project."""
    label = F.create_map(*[F.lit(x) for label, p in CATEGORIES.items() for x in (p, label)])
    return g.filter((F.col("s") == "project") & F.col("p").isin(*CATEGORIES.values())).select(label[F.col("p")].alias("label"), F.col("o").alias("value"))


def practice_lists(g: DataFrame) -> DataFrame:
    """label, values: the sorted values of each label that has any."""
    return practices(g).groupBy("label").agg(F.sort_array(F.collect_set("value")).alias("values"))


def practice_values(g: DataFrame, predicate: str) -> DataFrame:
    return g.filter((F.col("s") == "project") & (F.col("p") == predicate)).select(F.col("o").alias("value")).orderBy("value")


def count_kinds(g: DataFrame, kinds: list[str], path: str | None = None) -> DataFrame:
    """One row with the number of subjects of each kind."""
    e = _edges(g, "a")
    if path is not None:
        e = e.filter(full(F.col("s")).contains(path))
    return e.agg(*[F.count_if(F.col("o") == k).alias(k) for k in kinds])


def test_functions(g: DataFrame) -> DataFrame:
    """Subjects marked as tests or functions whose identifier speaks of test or spec."""
    low = F.lower(full(F.col("s")))
    marked = _edges(g, "isTestFunction").filter(F.col("o") == "true")
    named = _edges(g, "a").filter((F.col("o") == "Function") & (low.contains("test") | low.contains("spec")))
    return marked.select("s").unionByName(named.select("s")).distinct()


def test_dependencies(g: DataFrame) -> DataFrame:
    """Labels of the test frameworks that dependencies name."""
    low = F.lower(F.col("o"))
    found = F.array_compact(F.array(*[F.when(low.contains(k), v) for k, v in TEST_PATTERNS.items()]))
    return _edges(g, "dependsOn").select("o").distinct().select(F.explode(found).alias("label")).distinct()


def contributors(g: DataFrame) -> DataFrame:
    return _edges(g, "commitAuthor").groupBy(F.col("o").alias("name")).agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "name")


def active_files(g: DataFrame, most: int = TOP_FILES) -> DataFrame:
    """The files with the greatest commit counts, as numbers; text that is no number counts 0."""
    n = F.coalesce(F.regexp_extract("o", "^[0-9]+", 0).try_cast("bigint"), F.lit(0))
    return _edges(g, "commitCount").select(F.col("s").alias("file"), n.alias("commits")).orderBy(F.desc("commits"), "file").limit(most)


def recent_commits(g: DataFrame, most: int = RECENT) -> DataFrame:
    """The newest commits by the text of their dates: a star join of four facts."""
    part = lambda p, name: _edges(g, p).select(F.col("s").alias("hash"), F.col("o").alias(name))
    has = g.filter((F.col("s") == "project") & (F.col("p") == "hasCommit")).select(F.col("o").alias("hash"))
    j = has.join(part("commitAuthor", "author"), "hash").join(part("commitDate", "date"), "hash").join(part("commitMessage", "message"), "hash")
    return j.select("hash", "author", "date", "message").orderBy(F.desc("date"), "hash", "author", "message").limit(most)


# -- reports: small dictionaries on the driver --------------------------------------


class Reports:
    """The reports share the practice lists and the counts of kinds, each read once."""

    KINDS = ("Function", "Class", "Config", "Document", "Section", "Binary", "Commit")

    def __init__(self, g: DataFrame):
        self.g = g
        self._lists: dict[str, list[str]] | None = None
        self._counts: dict[str, int] | None = None

    def values(self, predicate: str) -> list[str]:
        if self._lists is None:
            self._lists = {r["label"]: r["values"] for r in practice_lists(self.g).collect()}  # at most 15 rows of labels
        return self._lists.get(next(k for k, v in CATEGORIES.items() if v == predicate), [])

    def count(self, kind: str) -> int:
        if self._counts is None:
            self._counts = count_kinds(self.g, list(self.KINDS)).first().asDict()
        return self._counts[kind]

    def practices(self) -> dict:
        return {k: v for k, p in CATEGORIES.items() if (v := self.values(p))}

    def testing(self) -> dict:
        deps = sorted(r["label"] for r in test_dependencies(self.g).collect())  # at most 20 labels
        total, tests = self.count("Function"), test_functions(self.g).count()
        out: dict = {"frameworks": self.values("usesTestFramework")}
        if deps:
            out["test_dependencies"] = deps
        out |= {"total_functions": total, "test_functions": tests}
        if total:
            out["test_ratio_percent"] = int(tests / total * 100 + 0.5)
        return out

    def ci_cd(self) -> dict:
        out: dict = {"ci_platforms": self.values("usesCIPlatform"), "containerization": self.values("usesContainerization"), "build_tools": self.values("usesBuildTool")}
        if deploy := self.values("usesDeploymentPlatform"):
            out["deployment_platforms"] = deploy
        return out | {"has_infrastructure_as_code": "infrastructure" in self.values("hasLayer")}

    def code_quality(self) -> dict:
        out: dict = {"linters": self.values("usesLinter"), "formatters": self.values("usesFormatter"), "type_checkers": self.values("usesTypeChecking"), "conventions": self.values("followsConvention")}
        if analysis := self.values("usesCodeAnalysis"):
            out["code_analysis"] = analysis
        return out

    def architecture(self) -> dict:
        layers = self.values("hasLayer")
        counts = {"functions": "Function", "classes": "Class", "config_files": "Config", "documents": "Document", "binary_assets": "Binary"}
        return {"layers": layers, "package_managers": self.values("usesPackageManager"), "is_monorepo": "monorepo-packages" in layers, "counts": {k: self.count(v) for k, v in counts.items()}}

    def documentation(self) -> dict:
        return {"documentation_artifacts": self.values("hasDocumentation"), "has_docs_directory": "documentation" in self.values("hasLayer"), "document_files": self.count("Document"), "total_sections": self.count("Section")}

    def dependencies(self) -> dict:
        n = _edges(self.g, "dependsOn").count()
        return {"package_managers": self.values("usesPackageManager"), "declared_dependencies": n, "has_automated_updates": "automated-dependency-updates" in self.values("followsConvention")}

    def activity(self) -> dict:
        """``contributors`` holds all of them, most commits first."""
        total = self.count("Commit")
        if not total:
            return {"total_commits": 0}
        rows = lambda df: [r.asDict() for r in df.collect()]
        return {"total_commits": total, "contributors": rows(contributors(self.g)), "most_active_files": rows(active_files(self.g)), "recent_commits": rows(recent_commits(self.g))}

    def project(self) -> dict:
        parts = ("practices", "testing", "ci_cd", "code_quality", "architecture", "documentation", "dependencies", "activity")
        out = {p: getattr(self, p)() for p in parts}
        if said := insights(out):
            out["insights"] = said
        return out


def insights(report: dict) -> list[str]:
    """What a project report says in words: rules in a fixed order, at most twelve sentences (fixed values)."""
    ci, quality, testing, docs, arch = (report.get(k, {}) for k in ("ci_cd", "code_quality", "testing", "documentation", "architecture"))
    practice, activity = report.get("practices", {}), report.get("activity", {})
    conventions, containers, platforms, tools = quality.get("conventions", []), ci.get("containerization", []), ci.get("ci_platforms", []), ci.get("build_tools", [])
    some = lambda values, part: any(part in v for v in values)
    listed = ", ".join
    out: list[str] = []
    if some(conventions, "devfile"):
        out.append("Uses devfile.yaml with containerized builds — the team dogfoods their own development environment." if some(containers, "docker") else "Uses devfile.yaml — standardized, reproducible development environment.")
    frameworks, ratio = testing.get("frameworks", []) + testing.get("test_dependencies", []), testing.get("test_ratio_percent", 0)
    if frameworks and ratio > 20:
        out.append(f"{ratio}% test ratio with {listed(frameworks)} — indicates a solid testing practice.")
    elif frameworks and ratio > 0:
        out.append(f"Test frameworks detected but test ratio is {ratio}% — testing may be concentrated in specific modules.")
    if some(tools, "maven-surefire") and some(tools, "maven-failsafe"):
        out.append("Uses Maven Surefire + Failsafe — unit and integration tests are separated with different execution phases.")
    if platforms and containers:
        out.append(f"CI via {listed(platforms)} with {listed(containers)} — automated build and deployment pipeline.")
    health = [x for x in ("contributing-guide", "security-policy", "code-of-conduct", "codeowners", "issue-templates", "pr-template") if x in docs.get("documentation_artifacts", [])]
    if len(health) >= 3:
        out.append(f"Strong open-source health: {listed(health)} — set up for community contributions.")
    layers = arch.get("layers", [])
    if len(layers) >= 5:
        out.append(f"Well-layered architecture with {len(layers)} layers ({listed(layers)}) — mature, modular codebase.")
    if arch.get("is_monorepo"):
        out.append(f"Monorepo structure with {listed(arch.get('package_managers', []))} — multiple packages managed together.")
    if report.get("dependencies", {}).get("has_automated_updates"):
        out.append("Uses automated dependency updates (Renovate/Dependabot) — proactive about security patches.")
    if deploy := ci.get("deployment_platforms", []):
        out.append(f"Deploys to {listed(deploy)} — cloud-native deployment target(s).")
    tooling = quality.get("linters", []) + quality.get("formatters", []) + quality.get("code_analysis", [])
    if len(tooling) >= 3:
        out.append(f"Strong code quality tooling: {listed(tooling)} — enforced code standards.")
    if some(conventions, "version-pinning"):
        out.append("Uses version pinning (.nvmrc, .tool-versions, etc.) — reproducible builds across environments.")
    if formats := practice.get("packaging_formats", []):
        out.append(f"Packages for {listed(formats)} — distributes via Linux package manager(s).")
    if management := practice.get("config_management", []):
        out.append(f"Uses {listed(management)} for infrastructure automation.")
    if some(platforms, "packit"):
        out.append("Uses Packit — automated Fedora/CentOS Stream package maintenance.")
    if some(conventions, "fedora-gating"):
        out.append("Has Fedora gating tests — packages gate on CI results.")
    if some(conventions, "systemd"):
        out.append("Includes systemd units and SELinux policy — deep Linux system integration." if some(conventions, "selinux") else "Ships systemd service units — designed for Linux system integration.")
    if some(conventions, "olm-operator") or some(conventions, "ansible-operator"):
        out.append("Implements the Kubernetes Operator pattern with OLM lifecycle management.")
    total, people = activity.get("total_commits", 0), activity.get("contributors", [])
    if total and people:
        stage = "mature" if total > 100 else "active" if total > 20 else "early-stage"
        out.append(f"{len(people)} contributor(s) across {total} indexed commits — {stage} development history.")
        if len(people) >= 2 and people[0]["commits"] / total > 0.8:
            out.append(f"Bus factor risk: {people[0]['name']} has >80% of commits — knowledge concentration.")
    return out[:MOST_INSIGHTS]
