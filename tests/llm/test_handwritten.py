"""Files that are not hand-written, and those that only look so."""

import pytest

from loomgraph.llm.handwritten import Known, by_path, has_notice, header, is_data, is_minified, is_numbered, judge, not_handwritten

PLAIN = "def load(items, limit=3):\n    found = []\n    for item in items:\n        if item.weight > limit:\n            found.append(load(item))\n    return found\n"


@pytest.mark.parametrize("text", ["// Code generated by x. DO NOT EDIT.\npackage a\n", "# <auto-generated/>\nx = 1\n", "/*\n * AUTO-GENERATED FILE\n */\nint a;\n", "#!/bin/sh\n# @generated by y from z\n", '"""machine-written output of t 9, regenerate with make"""\nx = 1\n',
                                  "// Copyright x\n\n// This file was automatically generated; any change is lost.\n", "// Diese Datei wird von t erzeugt. Bitte nicht von Hand bearbeiten.\n", "# Produced by the t compiler, version 3.1\n", "// Do not modify this file by hand: rerun t.\n", "\n\n// Autogenerated from x.yaml on every build\n"])
def test_notices(text):
    assert has_notice(text)


@pytest.mark.parametrize("text", ["// The table below was generated by hand from the notes.\nint a;\n", "# Ids here are generated by the caller; do not edit the ledger while it runs.\nx = 1\n", "// Writes the banner that marks generated files, see emit below.\n", PLAIN, "x = 1\n# Code generated by x. DO NOT EDIT.\n", 'b = "// Code generated by x. DO NOT EDIT."\n', ""])
def test_no_notices(text):
    assert not has_notice(text)


def test_header():
    assert "late" not in header("# a\n\n# b\nx\n# late\n") and header("#include <x>\n") == "" and "unclosed" in header("/* unclosed")


@pytest.mark.parametrize(("path", "kind"), [("r/vendor/x/a.go", "vendored"), ("r/src/Node_Modules/a.js", "vendored"), ("r/gen/a.py", "generated"), ("r/build/generated/a.py", "generated"), ("r/a.pb.go", "generated"), ("r/a_pb2.py", "generated"), ("r/x.min.js", "minified"), ("r/x-min.js", "minified"), ("r/x.bundle.js", "minified"),
                                            ("r/src/build/a.py", None), ("vendor/src/a.py", None), ("r/src/admin.js", None), ("r/vendor.py", None), ("r/src/gen/a.py", None), ("r/package-lock.json", "generated")])
def test_paths(path, kind):
    assert by_path(path) == kind


def test_texts():
    minified = "var a,e={};!function(b){b.g={k:64,v:\"r\"}}(a={});var d=function(w){for(var q=0;q<w.length;q++)if(w[q]===321)return!1;return!0};e.n=[1,2,3].map(function(s){return s<<2});function p(r,x){var t=r[0]||x;return t>1?t:p(t,!0)}"
    assert is_minified(minified, "js") and not is_minified(minified, "py") and not is_minified("function add(first, second) {\n  return first + second;\n}\n" * 9, "js")
    data = "DATA = [\n" + "".join(f"  {i * 7919 % 100000}, {i * 104729 % 99991}, 0x{i:02x},\n" for i in range(80)) + "]\n"
    assert is_data(data) and not is_data(PLAIN) and not is_data("X = 1\n") and not is_data(PLAIN + 'B = "' + "A" * 1500 + '"\n')
    assert is_numbered("".join(f"  def GetField_{i:03}(self):\n    return self._f[{i}]\n" for i in range(30))) and not is_numbered(PLAIN * 9)


def test_copies():
    other = "\n".join(f"def action_{w}(value, other):\n    return value.{w}(other) + '{w}'\n" for w in "drain split merge bind fold load scan trim".split())
    known = Known([other])
    assert known.copied(other) and known.copied("# Copyright x\n# licence y\n" + other) and known.copied(other.replace("action_bind", "renamed")) and known.copied(other + "\ndef mine():\n    return 1\n")
    assert not known.copied(PLAIN) and not known.copied("") and not known.copied(other[: len(other) // 12])
    assert judge("r/a.py", "py", other, known) == "vendored" and judge("r/a.py", "py", PLAIN, known) is None and judge("r/a.py", "py", None, known) is None and judge("r/vendor/a.py", "py", None, known) == "vendored"


def test_files(spark):
    rows = [("r/a.py", "py", PLAIN.encode()), ("r/b.py", "py", b"# @generated\nx=1\n"), ("r/b.py", "py", b"# @generated\nx=1\n"), ("r/vendor/c.js", "js", None), ("r/d.json", "json", b"{}"), ("r/e.py", "py", b"\xff\xfe bad"), ("r/f.txt", "txt", b"# @generated"), (None, "py", b"# @generated"), ("r/g", None, b"x"), ("r/h.py", "py", b"")]
    df = spark.createDataFrame(rows, "path string, ext string, content binary")
    got = {tuple(r) for r in not_handwritten(df, {"py": "python", "js": "javascript", "json": "json"}, []).collect()}
    assert got == {("r/b.py", "generated"), ("r/vendor/c.js", "vendored")}
    assert not_handwritten(df.limit(0), {"py": "python"}, []).count() == 0
