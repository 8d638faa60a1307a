"""Facts of configuration, build, document and binary files.

Every extractor is an array expression over one file's text: a file's facts are computed
in the row that holds it and exploded once, so extraction is one narrow pass over the
files with no shuffle.  What a line scanner keeps as state ("inside this section") is a
split of the text at the lines that begin a section.  No expression repeats a group: the
JVM's matcher goes one frame deeper for each repetition, and a long file would end it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.terms import iri_safe, lines, trim
from loomgraph.operators import rules

FACTS = "array<struct<s: string, p: string, o: string>>"
#: Extensions of files of which only metadata are kept.
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "ico": "image/x-icon", "bmp": "image/bmp", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg",
    "flac": "audio/flac", "aac": "audio/aac", "mp4": "video/mp4", "webm": "video/webm", "avi": "video/x-msvideo", "mov": "video/quicktime", "mkv": "video/x-matroska", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip",
    "tar": "application/x-tar", "wasm": "application/wasm", "exe": "application/x-executable", "dll": "application/x-sharedlib", "so": "application/x-sharedlib", "dylib": "application/x-sharedlib", "ttf": "font/ttf", "otf": "font/otf",
    "woff": "font/woff", "woff2": "font/woff2", "sqlite": "application/x-sqlite3", "db": "application/x-sqlite3",
}
#: Extension -> kind of text file.
TEXT_KINDS = {"json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "css": "css", "adoc": "asciidoc", "asciidoc": "asciidoc", "rst": "rst"} | {str(i): "man" for i in range(1, 10)}
BUILD_NAMES = "pom.xml build.gradle build.gradle.kts Cargo.toml go.mod Gemfile Podfile requirements.txt pyproject.toml composer.json Pipfile pubspec.yaml Package.swift build.sbt mix.exs Dockerfile Containerfile docker-compose.yml docker-compose.yaml".split()
PLUGINS = {"maven-surefire-plugin": ("usesBuildTool", "maven-surefire"), "maven-failsafe-plugin": ("usesBuildTool", "maven-failsafe"), "maven-checkstyle-plugin": ("usesLinter", "checkstyle"), "checkstyle": ("usesLinter", "checkstyle"), "spotbugs-maven-plugin": ("usesLinter", "spotbugs"), "jacoco-maven-plugin": ("usesTestFramework", "jacoco")}


def fact(s: Column, p: str, o: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def none() -> Column:
    return F.array().cast(FACTS)


def named(path: Column, predicate: str, names: Column) -> Column:
    """One fact for each non-empty name."""
    return F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), lambda n: fact(path, predicate, iri_safe(n)))


def kinds(subjects: Column, kind: str) -> Column:
    return F.transform(subjects, lambda s: fact(s, "a", F.lit(kind)))


def children(path: Column, names: Column, mark: str = "") -> Column:
    """path/name of every non-empty name."""
    return F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), lambda n: F.concat(path, F.lit("/" + mark), iri_safe(n)))


def first(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    got = F.regexp_extract(x, pattern, group)
    return F.when(x.rlike(pattern), got)


def flat_lines(content: Column) -> Column:
    return F.transform(lines(content), trim)


# -- documents -----------------------------------------------------------------------


def markdown(path: Column, text: Column) -> Column:
    heads = F.transform(F.filter(flat_lines(text), lambda x: x.startswith("#")), lambda x: trim(F.regexp_replace(x, "^#+", "")))
    return F.concat(F.array(fact(path, "a", F.lit("Document"))), kinds(children(path, heads), "Section"))


def html(path: Column, text: Column) -> Column:
    """Elements by id and class; the text before the first attribute, up to its first quote, counts as one."""
    value = lambda x: F.when(x.contains('"'), F.substring_index(x, '"', 1))
    ids = F.transform(F.split(text, 'id="'), value)
    classes = F.flatten(F.transform(F.filter(F.transform(F.split(text, 'class="'), value), lambda x: x.isNotNull()), lambda x: F.split(x, r"(?U)\s+")))
    return F.concat(F.array(fact(path, "a", F.lit("Document"))), kinds(children(path, ids, "#"), "Element"), kinds(children(path, classes, "."), "Element"))


def css(path: Column, text: Column) -> Column:
    rules_ = F.transform(F.filter(flat_lines(text), lambda x: x.endswith("{")), lambda x: trim(F.regexp_replace(x, r"\{+$", "")))
    kept = F.filter(rules_, lambda x: ~x.startswith("/") & ~x.startswith("*"))
    return F.concat(F.array(fact(path, "a", F.lit("Stylesheet"))), kinds(children(path, kept), "Style"))


def asciidoc(path: Column, text: Column) -> Column:
    heads = F.transform(F.filter(flat_lines(text), lambda x: x.startswith("=") & ~x.startswith("====")), lambda x: trim(F.regexp_replace(x, "^=+", "")))
    return F.concat(F.array(fact(path, "a", F.lit("Document"))), kinds(children(path, heads), "Section"))


def rst(path: Column, text: Column) -> Column:
    """A line over a line of at least its length (in bytes) made of underline characters only."""
    rows = flat_lines(text)
    pairs = F.zip_with(rows, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x, y: F.when((x != "") & y.rlike(r"^[=\-~^+#`*.]+$") & (F.octet_length(y) >= F.octet_length(x)), x))
    return F.concat(F.array(fact(path, "a", F.lit("Document"))), kinds(children(path, pairs), "Section"))


def man(path: Column, text: Column) -> Column:
    heads = F.transform(F.filter(flat_lines(text), lambda x: x.startswith(".SH ")), lambda x: trim(F.regexp_replace(F.substring(x, F.lit(5), F.length(x)), '^"+|"+$', "")))
    return F.concat(F.array(fact(path, "a", F.lit("Document"))), kinds(children(path, heads), "Section"))


# -- configuration ----------------------------------------------------------------


def _keys(text: Column, at: str | None = None) -> Column:
    got = F.json_object_keys(text if at is None else F.get_json_object(text, f"$['{at}']"))
    return F.coalesce(got, F.array().cast("array<string>"))


def json(path: Column, text: Column, name: Column) -> Column:
    deps = F.when(name == "package.json", F.concat(*[named(path, "dependsOn", _keys(text, k)) for k in ("dependencies", "devDependencies", "peerDependencies")])).otherwise(none())
    return F.concat(F.array(fact(path, "a", F.lit("Config"))), named(path, "declares", _keys(text)), deps)


def yaml(path: Column, text: Column) -> Column:
    """Top-level lines up to their first colon; a line without one is declared whole."""
    top = F.filter(lines(text), lambda x: ~x.rlike(r"^[ \t\-#]") & (trim(x) != ""))
    return F.concat(F.array(fact(path, "a", F.lit("Config"))), named(path, "declares", F.transform(top, lambda x: trim(F.substring_index(x, ":", 1)))))


def _sections(text: Column, begin: str) -> Column:
    """The text in parts, each beginning with a line at whose start ``begin`` matches (but the first, up to there)."""
    return F.split(F.concat(F.lit("\n"), text), rf"(?U)\n(?={begin})")


def _blocks(text: Column, headers: str) -> Column:
    """The trimmed lines of the sections with one of the headers, up to the next line that begins with [."""
    blocks = F.filter(_sections(text, r"[^\S\n]*\["), lambda x: x.rlike(rf"(?U)^[^\S\n]*\[(?:{headers})\][^\S\n]*(?:\n|$)"))
    rows = F.flatten(F.transform(blocks, flat_lines))
    return F.filter(rows, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("["))


def _head(x: Column, stops: str) -> Column:
    """What stands before the first of the stop characters."""
    return F.regexp_extract(x, f"^[^{stops}]*", 0)


def cargo(text: Column) -> Column:
    return F.transform(_blocks(text, "dependencies|dev-dependencies|build-dependencies"), lambda x: _head(x, " ="))


def pipfile(text: Column) -> Column:
    return F.transform(_blocks(text, "packages|dev-packages"), lambda x: _head(x, " ="))


def pyproject(text: Column) -> Column:
    def name(x: Column) -> Column:
        quoted = trim(_head(F.regexp_replace(x, "^[\"',]+|[\"',]+$", ""), r"><=~!;\["))
        plain = _head(x, " =")
        return F.when(x.rlike("^[\"']"), quoted).otherwise(F.when(plain != "python", plain))

    return F.transform(_blocks(text, r"project\.dependencies|tool\.poetry\.dependencies|tool\.poetry\.dev-dependencies"), name)


def pom(text: Column) -> Column:
    """group:artifact of every dependency block; the last value on its own line wins."""
    begun = F.filter(_sections(text, r"[^\S\n]*<dependency>"), lambda x: x.rlike(r"^\s*<dependency>") & x.rlike(r"\n\s*</dependency>"))
    blocks = F.transform(begun, lambda x: F.regexp_replace(F.split(x, r"\n[^\S\n]*</dependency>")[0], r"^[^\n]*", ""))

    def last(block: Column, tag: str) -> Column:
        rows = F.filter(flat_lines(block), lambda x: x.rlike(f"<{tag}>.*</{tag}>"))
        return F.coalesce(F.try_element_at(F.transform(rows, lambda x: trim(F.regexp_extract(x, f"<{tag}>(.*?)</{tag}>", 1))), F.lit(-1)), F.lit(""))

    def name(b: Column) -> Column:
        group, artifact = last(b, "groupId"), last(b, "artifactId")
        return F.when(artifact == "", F.lit(None)).when(group == "", artifact).otherwise(F.concat(group, F.lit(":"), artifact))

    return F.transform(blocks, name)


def pom_plugins(text: Column) -> Column:
    ids = F.transform(F.regexp_extract_all(text, F.lit(r"<artifactId>([^\n]*?)</artifactId>"), F.lit(1)), trim)
    what = F.lit(None).cast("struct<s: string, p: string, o: string>")
    return F.filter(F.transform(ids, lambda x: reduce(lambda acc, kv: F.when(x == kv[0], fact(F.lit("project"), kv[1][0], F.lit(kv[1][1]))).otherwise(acc), PLUGINS.items(), what)), lambda f: f.isNotNull())


def gradle(text: Column) -> Column:
    rows = F.filter(flat_lines(text), lambda x: x.rlike("^(implementation|testImplementation|api |compileOnly|runtimeOnly|annotationProcessor)"))
    coordinate = lambda x: F.try_element_at(F.filter(F.split(x, "['\"]"), lambda y: y.contains(":")), F.lit(1))
    return F.transform(rows, lambda x: F.substring_index(coordinate(x), ":", 2))


def go_mod(text: Column) -> Column:
    begun = F.transform(F.filter(_sections(text, r"[^\S\n]*require \("), lambda x: x.rlike(r"(?U)^[^\S\n]*require \(")), flat_lines)
    ends = lambda x: F.array_position(x, ")").cast("int")
    blocks = F.transform(begun, lambda x: F.slice(x, 2, F.when(ends(x) > 0, ends(x) - 2).otherwise(F.size(x) - 1)))
    inside = F.filter(F.flatten(blocks), lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("require "))
    single = F.filter(flat_lines(text), lambda x: x.startswith("require ") & ~x.contains("("))
    return F.concat(F.transform(inside, lambda x: F.split(x, r"\s+")[0]), F.transform(single, lambda x: F.regexp_extract(x, r"^require\s+(\S+)", 1)))


def gemfile(text: Column) -> Column:
    rows = F.filter(flat_lines(text), lambda x: x.startswith("gem "))
    return F.transform(rows, lambda x: F.try_element_at(F.filter(F.split(F.substring(x, F.lit(5), F.length(x)), "['\"]"), lambda y: y != ""), F.lit(1)))


def requirements(text: Column) -> Column:
    return F.transform(F.filter(flat_lines(text), lambda x: (x != "") & ~x.rlike("^[#-]")), lambda x: trim(_head(x, r"=><~!;\[")))


def composer(text: Column) -> Column:
    return F.filter(F.concat(_keys(text, "require"), _keys(text, "require-dev")), lambda x: (x != "php") & ~x.startswith("ext-"))


def pubspec(text: Column) -> Column:
    blocks = F.filter(_sections(text, r"[^ \t\r\n]"), lambda x: x.rlike(r"^(?:dependencies|dev_dependencies)[^\S\n]*(?::[^\n]*)?(?:\n|$)"))
    body = F.transform(F.transform(blocks, flat_lines), lambda x: F.slice(x, 2, F.size(x)))
    rows = F.filter(F.flatten(body), lambda x: (x != "") & ~x.startswith("#"))
    return F.filter(F.transform(rows, lambda x: trim(F.substring_index(x, ":", 1))), lambda x: ~x.isin("sdk", "flutter"))


def swift(text: Column) -> Column:
    urls = F.transform(F.filter(F.split(text, r"\.package\("), lambda x: x.contains("url:")), lambda x: F.get(F.split(F.regexp_extract(x, r"(?s)url:(.*)", 1), '"'), F.lit(1)))
    return F.transform(urls, lambda x: F.regexp_replace(F.substring_index(x, "/", -1), r"(\.git)+$", ""))


def sbt(text: Column) -> Column:
    parts = F.filter(F.transform(lines(text), lambda x: F.split(x, '"')), lambda y: F.size(y) >= 6)
    good = F.filter(parts, lambda y: (F.get(y, F.lit(1)) != "") & (F.get(y, F.lit(3)) != "") & F.get(y, F.lit(2)).contains("%") & F.get(y, F.lit(4)).contains("%"))
    return F.transform(good, lambda y: F.concat(F.get(y, F.lit(1)), F.lit(":"), F.get(y, F.lit(3))))


def mix(text: Column) -> Column:
    return F.transform(F.filter(F.transform(F.split(text, r"\{"), trim), lambda x: x.startswith(":")), lambda x: trim(F.regexp_extract(x, r"^:([^,}]*)", 1)))


def dotnet(text: Column) -> Column:
    return F.transform(F.filter(flat_lines(text), lambda x: x.contains("PackageReference")), lambda x: first(x, r'Include="([^"]*)"'))


def dockerfile(text: Column) -> Column:
    rows = F.filter(flat_lines(text), lambda x: x.startswith("FROM "))
    return F.filter(F.transform(rows, lambda x: F.regexp_extract(x, r"^FROM\s+(\S+)", 1)), lambda x: x != "scratch")


def compose(text: Column) -> Column:
    rows = F.filter(flat_lines(text), lambda x: x.startswith("image:"))
    return F.transform(rows, lambda x: F.regexp_replace(F.regexp_replace(trim(F.substring(x, F.lit(7), F.length(x))), '^"+|"+$', ""), "^'+|'+$", ""))


def rpm_spec(path: Column, text: Column) -> Column:
    rows = F.filter(flat_lines(text), lambda x: (x != "") & ~x.startswith("#"))
    required = F.filter(F.transform(rows, lambda x: first(x, r"^(?:Build)?Requires:(.*)$")), lambda x: x.isNotNull())
    names = F.transform(F.flatten(F.transform(required, lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"^\s*(\S*)", 1))
    own = F.transform(rows, lambda x: trim(first(x, r"^Name:(.*)$")))
    version = F.transform(rows, lambda x: F.when(trim(first(x, r"^Version:(.*)$")) != "", F.concat(F.lit("version:"), trim(first(x, r"^Version:(.*)$")))))
    return F.concat(named(path, "dependsOn", F.filter(names, lambda x: ~x.rlike("^[%/]"))), named(path, "declares", own), named(path, "declares", version))


def debian_control(path: Column, text: Column) -> Column:
    """Depends fields with their continuation lines; the first alternative of each."""
    begun = F.filter(_sections(text, r"[^ \t]|$"), lambda x: x.rlike("^(?:Depends|Build-Depends|Build-Depends-Indep|Recommends|Pre-Depends):"))
    fields = F.transform(begun, lambda x: F.regexp_replace(x, "^[^:]*:", ""))
    items = F.flatten(F.transform(fields, lambda x: F.split(F.regexp_replace(x, "\n", ","), ",")))
    names = F.transform(items, lambda x: F.regexp_replace(F.regexp_extract(F.split(x, r"\|")[0], r"^\s*(\S*)", 1), r"^(\$\{)+", ""))
    packages = F.transform(F.filter(lines(text), lambda x: x.startswith("Package:")), lambda x: trim(F.substring(x, F.lit(9), F.length(x))))
    return F.concat(named(path, "dependsOn", F.filter(names, lambda x: ~x.startswith("$") & ~x.contains("}"))), named(path, "declares", packages))


SCANNERS = {
    "pom.xml": pom, "build.gradle": gradle, "build.gradle.kts": gradle, "Cargo.toml": cargo, "go.mod": go_mod, "Gemfile": gemfile, "Podfile": gemfile, "requirements.txt": requirements, "pyproject.toml": pyproject, "composer.json": composer, "Pipfile": pipfile,
    "pubspec.yaml": pubspec, "Package.swift": swift, "build.sbt": sbt, "mix.exs": mix, "Dockerfile": dockerfile, "Containerfile": dockerfile, "docker-compose.yml": compose, "docker-compose.yaml": compose,
}


def build_facts(path: Column, name: Column, ext: Column, text: Column, debian: bool = False) -> Column:
    """Facts of build files; ``debian``: also those of debian/control, which the file rules otherwise never reach."""
    dot = F.coalesce(ext, F.lit(""))
    known = name.isin(*BUILD_NAMES)
    docker = name.endswith("Dockerfile")
    out = F.when(F.lit(False), none())
    for scan in dict.fromkeys(SCANNERS.values()):
        out = out.when(name.isin(*[n for n, f in SCANNERS.items() if f is scan]), F.concat(named(path, "dependsOn", scan(text)), pom_plugins(text)) if scan is pom else named(path, "dependsOn", scan(text)))
    out = out.when(docker, named(path, "dependsOn", dockerfile(text))).when(dot.isin("csproj", "fsproj"), named(path, "dependsOn", dotnet(text))).when(dot == "spec", rpm_spec(path, text))
    control = (name == "control") & path.contains("/debian/") if debian else F.lit(False)
    out = out.when(control, debian_control(path, text)).otherwise(none())
    config = F.when(name != "Dockerfile", F.array(fact(path, "a", F.lit("Config")))).otherwise(none())
    return F.when((known | docker | dot.isin("csproj", "fsproj", "spec") | control) & text.isNotNull(), F.concat(config, out)).otherwise(none())


def text_facts(path: Column, name: Column, ext: Column, text: Column) -> Column:
    out = F.when(text.isNull(), none())
    readers = {"json": lambda p, t: json(p, t, name), "yaml": yaml, "markdown": markdown, "html": html, "css": css, "asciidoc": asciidoc, "rst": rst, "man": man}
    for kind, read in readers.items():
        out = out.when(ext.isin(*[e for e, k in TEXT_KINDS.items() if k == kind]), read(path, text))
    return out.otherwise(none())


def binary_facts(path: Column, ext: Column, length: Column) -> Column:
    mime = F.lit(None).cast("string")
    for label in dict.fromkeys(MIME.values()):
        mime = F.when(ext.isin(*[e for e, m in MIME.items() if m == label]), label).otherwise(mime)
    facts = F.array(fact(path, "a", F.lit("Binary")), fact(path, "hasMimeType", mime), fact(path, "hasSize", length.cast("string")))
    return F.when(ext.isin(*MIME), F.filter(facts, lambda f: f["o"].isNotNull())).otherwise(none())


def project_facts(path: Column, name: Column) -> Column:
    found = rules.practice(path, name)
    what = F.when(found.isNotNull(), F.array(F.struct(F.lit("project").alias("s"), found["p"].alias("p"), found["o"].alias("o")))).otherwise(none())
    return F.concat(what, F.transform(rules.layers(path), lambda x: fact(F.lit("project"), "hasLayer", x)))


def file_facts(files: DataFrame, code_extensions: list[str], debian: bool = False) -> DataFrame:
    """s, p, o of everything but code structures: one narrow pass over ``files``.

    ``files`` has path, file_name, ext, length, content.  Content that is not UTF-8 (or
    null) gives no facts of content; practices, layers and binary metadata still count.
    """
    path, name, ext = F.col("path"), F.col("file_name"), F.col("ext")
    rows = files.filter(path.isNotNull()).select("path", F.coalesce("file_name", F.substring_index("path", "/", -1)).alias("file_name"), "ext", "length", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"))
    text = F.col("text")
    other = F.when(F.coalesce(ext, F.lit("")).isin(*code_extensions), none()).otherwise(F.concat(text_facts(path, name, ext, text), binary_facts(path, ext, F.col("length"))))
    facts = F.concat(project_facts(path, name), build_facts(path, name, ext, text, debian), other)
    return rows.select(F.explode(facts).alias("f")).select("f.s", "f.p", "f.o")
