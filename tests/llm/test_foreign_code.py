import json

from codestrata.llm import foreign_code as fc

FILES = "file_id long, project_key string, rel_path string, reason string, head string"
STAGED = "project_key string, rel_path string, stage_kind string, payload string, size_bytes long, line string, n_lines long"


def staged(path, head="import os\n", size=900, loc=30, longest=60, project="P", kind="atlas_record"):
    payload = json.dumps({"language": "x", "loc": loc, "size": size, "longest_line": longest, "head": head})
    return (project, path, kind, payload, size, None, None)


def found(spark, rows, files=()):
    got = fc.foreign_files(spark.createDataFrame(list(files), FILES), spark.createDataFrame(rows, STAGED)).collect()
    assert len({(r.project_key, r.rel_path) for r in got}) == len(got)
    return {r.rel_path: r.reason for r in got}


def test_paths(spark):
    files = [(k, "P", p, None, None) for k, p in enumerate([
        "./src\\__generated__\\A.ts", "services/x_pb2.py", "src/a.gen.ts", "api/x.pb.go", "a/node_modules/b/c.js", "go/vendor/lib/a.go", "external/lib-1.2.3/a.ts",
        "static/a.min.css", "public/chunk-12AB34C.js", "src/features/vendor/VendorList.tsx", "src/generated-reports/View.tsx", "docs/a.packed-lunch.js", "build/webpack.a.js", "src/a.ts", None,
    ])]
    assert found(spark, [], files) == {
        "src/__generated__/A.ts": "generated", "services/x_pb2.py": "generated", "src/a.gen.ts": "generated", "api/x.pb.go": "generated",
        "a/node_modules/b/c.js": "third_party", "go/vendor/lib/a.go": "third_party", "external/lib-1.2.3/a.ts": "third_party", "static/a.min.css": "minified", "public/chunk-12AB34C.js": "minified",
    }


def test_heads(spark):
    packed = "!function(e,t){for(;n<l.length;)t.push(l[n++]);var n=n(658),o=n.reduce;function k(e){return e?k(e-1):0}"
    rows = [
        staged("a.ts", "// @generated SignedSource<<ab12>>\nimport x"), staged("b.cs", "// Diese Datei wird von tool automatisch erzeugt; nicht bearbeiten."),
        staged("c.py", "# lib 1.2.3, MIT licence\nimport os"), staged("d.js", "/*!\n * lib v1.2.3\n * (c) lib contributors, released under the MIT licence\n */"),
        staged("e.js", packed, 90_000, 2, 45_000), staged("f.js", "/*! lib 1.2 */" + packed, 90_000, None, None), staged("g.ts", "export default 'data:font/woff2;base64," + "Ab9+" * 20, 90_000, 1, 90_000),
        staged("h.py", "ROWS = [\n    (1, 'a', 0.5),\n    (2, 'b', 0.25),\n    (3, 'c', 0.75),\n", 90_000, 3000, 60),
        staged("no1.ts", "// skips whatever carries @generated in its first lines\n"), staged("no2.ts", "/* replaces our old copy of lib, written anew */"), staged("no3.ts", "const BANNER = '// @generated, do not edit';"),
        staged("no4.ts", "export const T = 'First read the map, then write every row that is left. First read the", 90_000, 2, 45_000), staged("no5.ts", "export const S = [60, 68, 36, 65, 70, 11];\n// by hand", 900),
        staged("no6.py", "import os\n" * 9, 300_000, 9000, 70), staged("no7.ts", "// Copyright (c) the P authors. See LICENSE at the root."),
    ]
    assert found(spark, rows) == {
        "a.ts": "generated", "b.cs": "generated", "c.py": "third_party", "d.js": "third_party", "e.js": "minified", "f.js": "minified", "g.ts": "data", "h.py": "data",
    }


def library(n, edit=None):
    lines = [f"export function {w}(one, two) {{ return one.{w}Of(two.{w}); }}" for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta")]
    if edit is not None:
        lines[n % 7] = edit
    return "\n".join(lines) + "\n"


def others(n):
    return [staged(f"src/o{k}.js", f"import React from 'react';\nexport const value{k} = read{k}({k});\n", project="O") for k in range(n)]


def test_copies_without_a_banner(spark):
    grown = library(0) + "export const added = one => one.more(1);\n"
    longer = library(0) + "".join(f"export const own{k} = mine{k} => mine{k}.written(by, hand, {k});\n" for k in range(6))
    rows = [
        staged("vendor/lib/a.js", library(0), 1234, project="A"), staged("src/same.js", library(0), 1234, project="B"), staged("src/edited.js", library(2, "export const x = 1;"), 1200, project="B"),
        staged("src/grown.js", grown, 9999, project="B"), staged("src/longer.js", longer, 9999, project="B"), staged("src/mine.js", library(0), 1234, project="A"),
        staged("src/part.js", library(0)[:150], 400, project="C"), staged("src/crlf.js", library(0).replace("\n", "\r\n"), 1300, project="C"), staged("src/nobody.js", library(0), 1234, project=None),
    ]
    assert found(spark, rows + others(30)) == {k: "third_party" for k in ("vendor/lib/a.js", "src/same.js", "src/edited.js", "src/grown.js", "src/crlf.js")}


def test_copies_however_many(spark):
    rows = [staged("vendor/lib/a.js", library(0), project="A")] + [staged(f"src/c{k}.js", library(k, f"export const edit{k} = {k};"), 100 + k, project=f"P{k}") for k in range(40)]
    rows += [staged(f"src/e{k}.js", library(0), project=f"P{k}") for k in range(40)]
    assert len(found(spark, rows + others(400))) == 81


def test_common_lines_are_no_evidence(spark):
    common = "".join(f"import {{ thing{k} }} from 'react-toolkit-of-things';\n" for k in range(8))
    rows = [staged("vendor/lib/a.js", common, project="A")] + [staged(f"src/c{k}.js", common + f"const x{k} = {k};\n", project="B") for k in range(30)]
    assert found(spark, rows) == {"vendor/lib/a.js": "third_party"}


def test_small_tables_of_numbers(spark):
    rows = [staged("a.ts", "export const T = [\n  [12.5, 7.25, 91.125],\n  [0.5, 44.75, 3.5],\n", 900), staged("b.ts", "export const T = [12, 7, 91, 44, 3];\n", 90_000)]
    assert found(spark, rows) == {"a.ts": "data"}


def test_broken_payloads_nulls_and_empty_tables(spark):
    rows = [("P", "a.ts", "atlas_record", "{broken", None, None, None), ("P", None, "atlas_record", None, None, None, None), (None, "a.min.js", "symbol_scan", "{}", 1, None, None), staged("b.ts", "x" * 300_000, 300_000, 1, 300_000)]
    assert found(spark, rows + rows) == {"a.min.js": "minified", "b.ts": "data"}
    assert found(spark, []) == {}


def test_hand_written_source_remains(spark):
    files = spark.createDataFrame([(1, "P", "src\\a.ts", None, None), (2, "P", "./dist/a.js", None, None), (3, None, "dist/a.js", None, None)], FILES)
    assert [r.file_id for r in fc.hand_written(files, spark.createDataFrame([], STAGED)).collect()] == [1]
