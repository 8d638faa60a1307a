"""Engineering practices and architecture layers from paths.

The rules are data (fixed values, in order of precedence); ``practice`` compiles them to
one CASE expression, so a path is classified where it is scanned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

CI, CONTAINER, BUILD, LINTER, FORMATTER, TEST, TYPES, PKG = "usesCIPlatform", "usesContainerization", "usesBuildTool", "usesLinter", "usesFormatter", "usesTestFramework", "usesTypeChecking", "usesPackageManager"
PACKAGING, CONFIG, DEPLOY, ANALYSIS, DOC, CONVENTION = "usesPackagingFormat", "usesConfigManagement", "usesDeploymentPlatform", "usesCodeAnalysis", "hasDocumentation", "followsConvention"

#: Fixed values.  (predicate, label, names, other conditions): the first rule that holds gives a file's one label.
#: A condition is a string of tests that must all hold: c: path contains, ^ name begins, $ name ends; | parts alternatives.
PRACTICES: list[tuple[str, str, str, str]] = [
    (CI, "github-actions", "", "c:.github/workflows/ $.yml"), (CI, "gitlab-ci", ".gitlab-ci.yml", ""), (CI, "jenkins", "Jenkinsfile", ""), (CI, "travis", ".travis.yml", ""), (CI, "circleci", "", "c:.circleci/ =config.yml"),
    (CONTAINER, "docker", "Dockerfile .dockerignore", ""), (CONTAINER, "docker-compose", "docker-compose.yml docker-compose.yaml", ""),
    (BUILD, "make", "Makefile makefile GNUmakefile", ""), (BUILD, "gradle", "build.gradle build.gradle.kts", ""), (BUILD, "maven", "pom.xml", ""), (BUILD, "cmake", "CMakeLists.txt", ""),
    (LINTER, "eslint", ".eslintignore", "^.eslintrc"), (LINTER, "biome", "biome.json biome.jsonc", ""), (LINTER, "ruff", "ruff.toml .ruff.toml", ""), (LINTER, "rubocop", ".rubocop.yml", ""), (LINTER, "stylelint", ".stylelintrc stylelint.config.js", ""),
    (FORMATTER, "prettier", "", "^.prettierrc|^prettier.config"), (FORMATTER, "editorconfig", ".editorconfig", ""),
    (TEST, "jest", "", "^jest.config"), (TEST, "vitest", "", "^vitest.config"), (TEST, "cypress", "", "^cypress.config"), (TEST, "playwright", "", "^playwright.config"),
    (TEST, "pytest", "pytest.ini conftest.py setup.cfg", ""), (TEST, "mocha", ".mocharc.yml .mocharc.json", ""), (TEST, "karma", "", "^karma.conf"),
    (TYPES, "typescript", "tsconfig.json", ""), (TYPES, "javascript-jsdoc", "jsconfig.json", ""), (TYPES, "mypy", "mypy.ini .mypy.ini", ""),
    (PKG, "npm", "package.json", ""), (PKG, "yarn", "yarn.lock", ""), (PKG, "pnpm", "pnpm-lock.yaml", ""), (PKG, "bun", "bun.lock bun.lockb", ""), (PKG, "cargo", "Cargo.toml", ""), (PKG, "go-modules", "go.mod", ""),
    (PKG, "pip", "requirements.txt Pipfile", ""), (PKG, "poetry", "poetry.lock", ""), (PKG, "bundler", "Gemfile", ""), (PKG, "composer", "composer.json", ""),
    (DOC, "contributing-guide", "CONTRIBUTING.md CONTRIBUTING", ""), (DOC, "security-policy", "SECURITY.md SECURITY SECURITY.txt", ""), (DOC, "changelog", "CHANGELOG.md CHANGELOG CHANGES.md", ""), (DOC, "license", "LICENSE LICENSE.md LICENSE.txt", ""),
    (DOC, "codeowners", "CODEOWNERS", ""), (DOC, "code-of-conduct", "CODE_OF_CONDUCT.md", ""), (DOC, "issue-templates", "", "c:.github/ISSUE_TEMPLATE"), (DOC, "pr-template", "", "c:PULL_REQUEST_TEMPLATE"),
    (PACKAGING, "rpm", "", "$.spec"), (PACKAGING, "arch", "PKGBUILD", ""), (PACKAGING, "snap", "snapcraft.yaml", ""), (PACKAGING, "appimage", "AppImageBuilder.yml", ""),
    (PACKAGING, "deb", "", "c:/debian/ =control|c:/debian/ =rules|c:/debian/ =changelog|c:/debian/ =copyright"), (PACKAGING, "flatpak", "", "c:/flatpak/|$.flatpakref"), (LINTER, "rpmlint", "rpmlint.toml .rpmlintrc", ""),
    (CI, "packit", ".packit.yaml packit.yaml", ""), (CI, "zuul", "zuul.yaml .zuul.yaml", ""), (CONVENTION, "fedora-gating", "gating.yaml", ""), (CI, "tekton", "", "c:.tekton/ $.yaml|c:.tekton/ $.yml"), (CI, "zuul", "", "c:.zuul.d/"),
    (BUILD, "autotools", "configure.ac configure.in Makefile.am", ""), (BUILD, "kbuild", "Kbuild Kconfig", ""), (BUILD, "tito", "tito.props", ""), (BUILD, "tito", "", "c:.tito/"),
    (CONTAINER, "podman", "Containerfile", ""), (CONTAINER, "osbs", "container.yaml", ""), (CONTAINER, "docker", "", "$Dockerfile"),
    (TEST, "tox", "tox.ini", ""), (TEST, "tmt", "", "c:.fmf/|$.fmf"), (TEST, "molecule", "", "c:/molecule/ =molecule.yml|c:/molecule/ =converge.yml"),
    (CONFIG, "ansible", "ansible.cfg galaxy.yml", ""), (CONFIG, "puppet", "Puppetfile", ""), (CONFIG, "chef", "Berksfile kitchen.yml .kitchen.yml", ""), (CONFIG, "ansible", "", "c:/playbooks/ $.yml|c:/playbooks/ $.yaml|c:/roles/ =main.yml"),
    (CONVENTION, "systemd", "", "$.service|$.timer|$.socket|$.target|$.mount|$.path|c:tmpfiles.d/|c:sysusers.d/"),
    (CONVENTION, "selinux", "", "$.te c:selinux|$.te c:policy|$.fc c:selinux|$.fc c:policy|$.if c:selinux|$.if c:policy"), (CONVENTION, "dbus", "", "c:dbus $.service|c:dbus $.conf"),
    (CONVENTION, "polkit", "", "c:polkit|$.policy"), (CONVENTION, "udev", "", "c:udev $.rules"), (CONVENTION, "desktop-entry", "", "$.desktop"), (DOC, "appstream-metadata", "", "$.metainfo.xml|$.appdata.xml"),
    (DOC, "maintainers", "MAINTAINERS", ""), (BUILD, "operator-sdk", "", "=PROJECT short:"), (CONVENTION, "ansible-operator", "watches.yaml", ""), (CONVENTION, "olm-operator", "", "c:/bundle/ $.clusterserviceversion.yaml"),
    (CONVENTION, "devfile-development-environment", "devfile.yaml devfile.yml", ""), (CONVENTION, "nix-development-environment", "flake.nix shell.nix default.nix", ""), (CONTAINER, "vagrant", "Vagrantfile", ""),
    (DEPLOY, "serverless", "serverless.yml serverless.yaml", ""), (DEPLOY, "vercel", "vercel.json", ""), (DEPLOY, "netlify", "netlify.toml", ""), (DEPLOY, "fly", "fly.toml", ""), (DEPLOY, "cloudflare-workers", "wrangler.toml", ""), (DEPLOY, "heroku", "Procfile", ""),
    (DEPLOY, "google-app-engine", "", "=app.yaml c:appengine|=app.yaml c:gae"),
    (CONTAINER, "helm", "Chart.yaml", ""), (CONTAINER, "kustomize", "kustomization.yaml kustomization.yml", ""), (BUILD, "skaffold", "skaffold.yaml", ""), (BUILD, "tilt", "Tiltfile", ""), (BUILD, "earthly", "Earthfile", ""),
    (BUILD, "bazel", "BUILD BUILD.bazel WORKSPACE WORKSPACE.bazel .bazelrc", ""), (BUILD, "task", "Taskfile.yml Taskfile.yaml", ""), (BUILD, "just", "justfile Justfile .justfile", ""), (BUILD, "nx", "nx.json", ""), (BUILD, "turbo", "turbo.json", ""), (BUILD, "lerna", "lerna.json", ""), (BUILD, "sbt", "build.sbt", ""), (BUILD, "meson", "meson.build", ""),
    (ANALYSIS, "sonarqube", "sonar-project.properties sonar-project.json", ""), (ANALYSIS, "codecov", "", "^.codecov"),
    (DOC, "api-spec", "openapi.yaml openapi.yml openapi.json swagger.yaml swagger.yml swagger.json", ""),
    (CONVENTION, "pre-commit-hooks", ".pre-commit-config.yaml", ""), (CONVENTION, "version-pinning", ".tool-versions .nvmrc .node-version .python-version .ruby-version .java-version", ""),
    (CONVENTION, "conventional-commits", "", "^.commitlintrc|^commitlint.config"), (CONVENTION, "git-hooks", "", "c:.husky/"), (CONVENTION, "lint-staged", "", "^.lintstagedrc|^lint-staged.config"),
    (CONVENTION, "automated-dependency-updates", "renovate.json .renovaterc dependabot.yml", "c:.dependabot/"),
]
#: Directory names of each layer.
LAYERS = {
    "source": "src lib app", "tests": "test tests __tests__ spec specs", "documentation": "docs doc documentation", "scripts": "scripts bin tools", "configuration": "config configs",
    "monorepo-packages": "packages modules crates workspaces", "api": "api routes endpoints", "ui": "components views pages", "domain": "models entities domain", "services": "services providers",
    "middleware": "middleware interceptors", "utilities": "utils helpers common shared", "database": "migrations seeds", "infrastructure": "deploy infra terraform k8s kubernetes openshift", "automation": "ansible playbooks roles",
    "security": "selinux apparmor", "system": "systemd init", "packaging": "debian rpm packaging", "operators": "bundle operator operators", "contrib": "contrib extras",
}
#: The operator-sdk rule holds for paths shorter than this many bytes.
SHORT_PATH = 200


def _holds(condition: str, path: Column, name: Column) -> Column:
    def one(test: str) -> Column:
        if test.startswith("c:"):
            return path.contains(test[2:])
        if test == "short:":
            return F.octet_length(path) < SHORT_PATH
        kind, text = test[0], test[1:]
        return {"^": name.startswith, "$": name.endswith, "=": name.__eq__}[kind](text)

    return reduce(Column.__or__, [reduce(Column.__and__, [one(t) for t in alternative.split(" ")]) for alternative in condition.split("|")])


def practice(path: Column, name: Column) -> Column:
    """struct(p, o) of the first rule that holds, or null."""
    out = None
    for predicate, label, names, condition in PRACTICES:
        tests = ([name.isin(*names.split())] if names else []) + ([_holds(condition, path, name)] if condition else [])
        what = F.struct(F.lit(predicate).alias("p"), F.lit(label).alias("o"))
        out = F.when(reduce(Column.__or__, tests), what) if out is None else out.when(reduce(Column.__or__, tests), what)
    return out


def layer(directory: Column) -> Column:
    """The layer a path component stands for, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for label, names in LAYERS.items():
        out = out.when(directory.isin(*names.split()), label)
    return out


def layers(path: Column) -> Column:
    """The distinct layers of all components of a path, file name included."""
    return F.array_distinct(F.filter(F.transform(F.split(path, "/"), layer), lambda x: x.isNotNull()))
