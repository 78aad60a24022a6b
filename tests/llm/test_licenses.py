import math
import textwrap
from pathlib import Path

import duckdb

from helixframe.llm import licenses

FILES = [
    (1, "proj/LICENSE", "Released under the MIT License."),
    (2, "proj/src/a.py", "some code here\nmore"),
    (3, "proj/src/b.py", "Licensed under the Apache License, Version 2.0.\ncode follows"),
    (4, "proj/src/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (5, "proj/src/vendor/deep/er/c.c", "nothing"),
    (6, "other/x.txt", None),
    (7, None, "All rights reserved."),
    (8, "top.txt", ""),
    (9, "projx/y.txt", "the mit of the town"),
    (None, "proj/n.txt", "text"),
    (10, "proj/src/LICENSE2", "Licensed under CC BY-NC 4.0."),
    (11, "proj/src/LICENSE1", "Licensed under CC BY-NC 4.0."),
    (3, "proj/src/b.py", "Licensed under the Apache License, Version 2.0.\ncode follows"),
]


def test_headers_files_and_inheritance(spark):
    df = spark.createDataFrame(FILES, "doc_id long, path string, text string").selectExpr("*", "'x' AS unit", "'y' AS dir", "'z' AS licence")
    found = licenses.scan_licences(df).collect()
    assert len(found) == len(FILES)
    by = {(r["doc_id"], r["path"]): r for r in found}
    assert by[1, "proj/LICENSE"]["licence"] == "MIT" and by[1, "proj/LICENSE"]["origin"] == "file"
    assert (by[3, "proj/src/b.py"]["licence"], by[3, "proj/src/b.py"]["origin"]) == ("Apache-2.0", "header")
    two = by[2, "proj/src/a.py"]
    assert (two["licence"], two["origin"], two["licence_dir"]) == ("CC-BY-NC-4.0", "inherited", "proj/src")
    deep = by[5, "proj/src/vendor/deep/er/c.c"]
    assert (deep["licence"], deep["licence_dir"]) == ("GPL-3.0", "proj/src/vendor")
    assert by[6, "other/x.txt"]["origin"] == by[8, "top.txt"]["origin"] == by[9, "projx/y.txt"]["origin"] == "none"
    assert by[7, None]["licence"] == "Proprietary"
    assert by[None, "proj/n.txt"]["licence_dir"] == "proj"


def test_anchors_lose_no_line():
    weights, idf, other = licenses.template_weights()
    anchors = set(licenses.anchors())
    by = {}
    for k, _, term, w in weights:
        by.setdefault(k, []).append((term, w))
    for own in by.values():
        rest = math.sqrt(sum(w * w for t, w in own if t not in anchors))
        assert rest < licenses.THRESHOLD


def test_oracle_agrees_on_small_files(spark):
    con = duckdb.connect()
    rows = [(i, t, "en", "s", 1) for i, (_, _, t) in enumerate(FILES)]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    wanted = sorted(map(str, con.execute(licenses.oracle()).fetchall()))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = licenses.scan_licences(df.selectExpr("doc_id", "text", f"{licenses.PATH_SQL.format(text='string')} AS path"))
    found = sorted(str(tuple(r)) for r in out.select("doc_id", "path", "licence", "score", "origin", "licence_dir").collect())
    assert found == wanted


def test_empty_table(spark):
    assert licenses.scan_licences(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_full_texts_wrapped_notices_and_tags(spark):
    texts = {p.stem: p.read_text() for p in (Path(licenses.__file__).parent / "licence_texts").glob("*.txt")}
    notices = dict(licenses.NOTICES)
    gpl, apache = (textwrap.fill(notices[k], 60) for k in ("GPL-3.0", "Apache-2.0"))
    commented = "\n".join(f" * {x}" for x in apache.split("\n"))
    rows = [(i, f"{k}/LICENSE", "MIT License\n\nCopyright (c) 2020 Foo\n\n" * (k == "MIT") + t, k, "file") for i, (k, t) in enumerate(sorted(texts.items()))]
    rows += [(100 + i, f"{k}/src/a.c", "int main;", k, "inherited") for i, k in enumerate(sorted(texts))]
    rows += [
        (200, "x/a.py", "# Copyright 2020 Foo\n#\n" + "\n".join(f"# {x}" for x in gpl.split("\n")) + "\nimport os\n" + "x = y(z)\n" * 50, "GPL-3.0", "header"),
        (201, "x/b.c", f"/*\n * Copyright (C) 2020 Foo\n *\n{commented}\n */\nint f;\nint g;\n" + "x = y;\n" * 50, "Apache-2.0", "header"),
        (202, "y/NOTICE", apache, "Apache-2.0", "file"),
        (203, "x/c.rs", "// SPDX-License-Identifier: MIT\nfn main() {}", "MIT", "header"),
        (204, "x/d.rs", "// SPDX-License-Identifier: GPL-2.0-or-later\nfn main() {}", "GPL-2.0", "header"),
        (205, "x/e.txt", "Copyright 2020 Foo. All rights reserved.\n\nText of the town and of the road.", "Proprietary", "header"),
        (206, "x/f.c", "/*\nCopyright (c) 2020 Foo\nAll rights reserved.\n\n" + texts["BSD-2-Clause"] + "*/\nint f;\n" + "x = y(z);\n" * 200, "BSD-2-Clause", "header"),
        (207, "z/LICENSE", texts["GPL-3.0"].replace("GNU General Public", "GNU Affero General Public"), "AGPL-3.0", "file"),
        (208, "w/g.txt", "the mit of the town", None, "none"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")
    found = {r["doc_id"]: (r["licence"], r["origin"]) for r in licenses.scan_licences(df).collect()}
    wanted = {r[0]: r[3:] for r in rows}
    assert found == wanted


def test_block_anchors_lose_no_block():
    templates = licenses.block_templates()
    anchors = set(licenses.anchors(licenses.THRESHOLD, templates, licenses.FREQUENT_LONG))
    by = {}
    for k, _, term, w in licenses.template_weights(templates)[0]:
        by.setdefault(k, []).append((term, w))
    assert all(math.sqrt(sum(w * w for t, w in own if t not in anchors)) < licenses.THRESHOLD for own in by.values())


def test_long_runs_of_hyphens_and_marks(spark):
    notice = "Licensed under the Apache License, Version 2.0.\n"
    texts = [notice + "-a" * 200_000, notice + "a" * 300_000, notice + "#" * 200_000, "/*" + "*" * 200_000 + "\n" + notice, notice + " " * 200_000, "copyright " + "c" * 200_000 + "\n" + notice]
    df = spark.createDataFrame([(i, f"{i}/f.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    found = {r["doc_id"]: r["licence"] for r in licenses.scan_licences(df).collect()}
    assert found == dict.fromkeys(range(len(texts)), "Apache-2.0")


def test_notices_in_the_middle_of_prose_are_no_headers(spark):
    prose = "\n".join(["some lines of prose"] * 50)
    texts = [f"{prose}\nAll rights reserved.\n{prose}", f"{prose}\n\nAll rights reserved.\n\n{prose}", f"{prose}\nAll rights reserved.", f"All rights reserved.\n{prose}"]
    df = spark.createDataFrame([(i, f"{i}/f.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    found = {r["doc_id"]: r["origin"] for r in licenses.scan_licences(df).collect()}
    assert found == {0: "none", 1: "none", 2: "header", 3: "header"}
