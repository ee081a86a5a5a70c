from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import languages, minhash, paths, shares, text, urls
from corpusmill.operators.identity import commit_minhash


def column(spark, values, build, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.select("i", build(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_language_of(spark):
    cases = {
        "a.d.ts": "TypeScript Typings", "x/view.blade.php": "Blade template", "a.h": "C Header",
        "noext": "", "A.PY": "Python", "Dockerfile": "Dockerfile", ".gitignore": "", "a.": "",
        "s/a.spec.ts": "TypeScript", ".dockerignore": "Docker ignore", "CMakeLists.txt": "CMake",
        "x.tsx": "TypeScript", "m.mm": "Objective C++", "README.md": "Markdown", "t.twig": "Twig Template",
        "dir.py/file": "", "a.PHTML": "PHP", "b.hxx": "C++ Header", "LICENSE": "License",
    }
    assert column(spark, list(cases), languages.language_of) == list(cases.values())


def test_language_dictionary(spark):
    assert len(languages.LANGUAGE_BY_SUFFIX) == 93
    assert len(set(languages.LANGUAGE_BY_SUFFIX.values())) == 72
    assert len(languages.NON_CODE_LANGUAGES) == 26
    assert languages.file_marks_of("TypeScript") == [".spec.ts", ".ts", ".tsx"]
    assert column(spark, [" javascript ", "c++", "klingon"], languages.canonical_language) == [
        "JavaScript", "C++", None,
    ]


@pytest.mark.parametrize(
    "language, body, loc, mask",
    [
        ("Python", "# c\n\nx = 1\n  # d\ny\n", 2, "00101"),
        ("Go", "// c\n/* x\n* y\n*/\nfoo()\n", 1, "00001"),
        ("Zig", "// c\nx", 1, "01"),
        ("C", "*p = 1;\n  q\n　\n\x0b  //a\x0cb", 2, "010001"),
        ("PHP", "# a\n// b\n$x;\r\n\r\n$y;", 2, "00101"),
        ("SQL", "-- is code here\n", 1, "1"),
        ("Rust", "/// doc\nfn main() // c", 1, "010"),
        ("Python", "", 0, ""),
    ],
)
def test_code_lines(spark, language, body, loc, mask):
    lines = text.text_lines(F.lit(body))
    row = spark.range(1).select(
        languages.count_code_lines(lines, F.lit(language)),
        languages.code_line_mask(lines, F.lit(language)),
        text.line_count(lines),
    ).first()
    assert tuple(row) == (loc, mask, len(body.splitlines()))


def test_text(spark):
    raw = [b"a\xff\nb\xe2\x28\r\nc", b"", b"x\n", b"x\ny", b"a\0b"]
    assert column(spark, raw, text.decode_text, "v binary") == ["a\nb(\nc", "", "x\n", "x\ny", "a\0b"]
    assert column(spark, raw, text.physical_lines, "v binary") == [3, 0, 1, 2, 1]
    assert column(spark, raw, lambda c: text.is_binary(c, 8192), "v binary") == [False] * 4 + [True]
    assert column(spark, ["  a b \n"], text.strip) == ["a b"]
    assert column(spark, ["ERROR: a\nx\n ERROR: b", "1\n2\n3\n4\n5\n6"], text.error_lines) == [
        "ERROR: a\n ERROR: b", "2\n3\n4\n5\n6",
    ]
    assert column(spark, ["a  b\n c", "x" * 301], text.short_error) == ["a b c", "x" * 300 + "..."]


def test_urls(spark):
    values = [
        "https://github.com/owner/repo", "https://gitlab.com/org/sub/repo.git/",
        "git@github.com:owner/repo.git", "ssh://git@h:2222/group/sub/repo.git", "", "git@h:solo",
    ]
    assert column(spark, values, urls.folder_name) == [
        "github.com__owner__repo", "gitlab.com__org__sub__repo", "github.com__owner__repo",
        "git@h:2222__group__sub__repo", "", "h__solo",
    ]
    assert column(spark, values, urls.namespace) == ["owner", "org/sub", "owner", "2222/group/sub", "", ""]
    assert column(spark, values, urls.leaf_name) == ["repo", "repo", "repo", "repo", "", "solo"]
    assert column(spark, values, urls.display_name) == [
        "repo", "repo.git", "repo.git", "repo.git", "", "git@h:solo",
    ]
    assert column(spark, values[:1] + ["/local/x"], lambda u: urls.rewrite_scheme(u, "ssh", 10022)) == [
        "ssh://git@github.com:10022/owner/repo.git", "/local/x",
    ]
    assert column(spark, values[2:3], lambda u: urls.rewrite_scheme(u, "https")) == [
        "https://github.com/owner/repo.git"
    ]
    with pytest.raises(ValueError):
        urls.rewrite_scheme(F.lit("x"), "ftp")


def test_paths(spark):
    import os

    values = ["./a//b/../c", "../x", "a/../..", "/a/../../b", "a", "", "a/b/", "a/.b/c..d", "../../x/..", "./x"]
    assert column(spark, values, paths.normal_path) == [os.path.normpath(v) for v in values]
    names = ["a.TAR.gz", ".bashrc", "x/..b.c", "noext", "a.", "..", "d.e/f"]
    want = [os.path.splitext(n.rsplit("/", 1)[-1])[1].lower() or "<noext>" for n in names]
    assert column(spark, names, paths.extension) == want


def test_rounding_is_that_of_binary_values(spark):
    values = [3 / 20000, 0.0625, 2 / 3, 1.0, 5e-05, 0.00025, 0.12345, 1 / 3, 0.0, 7 / 20000]
    assert column(spark, values, shares.rounded, "v double") == [round(v, 4) for v in values]
    assert column(spark, values, shares.percent_text, "v double") == [f"{v:.1%}" for v in values]


def test_minhash(spark):
    hashes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(300)]
    signature = commit_minhash(
        spark.createDataFrame([("r", h) for h in hashes] + [("short", "abc")], "repo_url string, sha string")
    ).collect()
    want = ",".join(
        format(min((a * int(h[:16], 16) + b) % 2**64 for h in hashes), "016x")
        for a, b in minhash.CONSTANTS
    )
    assert {r["repo_url"]: r["commit_minhash"] for r in signature} == {"r": want, "short": ""}


def test_minhash_of_two_known_commits(spark):
    commits = [
        ("r", "0123456789abcdef0123456789abcdef01234567"),
        ("r", "fedcba9876543210fedcba9876543210fedcba98"),
    ]
    # The expected fingerprint.
    want = (
        "4ff4619f13d13bfb,68954ce1856a9e84,bb38e99b1b63da17,2a24b9a2b613afed,"
        "21b19f0ce5c063e5,56c5eda5e3d9a16e,a69f7c2d9dc02c51,4642f39adc0c8c6e,"
        "2b1f207f47edddd1,8bdbedfb741cb278,1a14805cf66b6aae,3cb0f18eeee4ace1,"
        "4a662ae69936e050,6c8ceb987f821ff1,210f2ba7042699d4,33e2feaae1678ddc,"
        "4c2d7bf7d5564fa8,5c213d497c667df4,89718cb863e1b6a1,41457cc539ee68e4,"
        "a690c21e32ff95e6,522bdf6e2345329f,6fc80c5d280ad463,97f2aac373533c80,"
        "aaa7d341ca182fe2,9947357f94c5ba91,207dc8bcf5ab3f56,989ed1b417e0269b,"
        "206b0342c7d51f0c,43eb468a96b2b1cd,6338bb8d80404e73,35eca2ad2a17c762"
    )
    df = spark.createDataFrame(commits, "repo_url string, sha string")
    assert commit_minhash(df).first().commit_minhash == want


def test_spelling_and_marks_as_columns(spark):
    rows = spark.createDataFrame([("typescript",), (" PHP ",), ("Klingon",), (None,), ("",)], "name string")
    got = rows.select("name", languages.spelling_of(rows["name"]).alias("spelled")).withColumn(
        "marks", languages.marks_of(F.col("spelled"))
    ).collect()
    assert [r.spelled for r in got] == ["TypeScript", "PHP", None, None, None]
    assert [r.marks for r in got][0] == languages.file_marks_of("TypeScript") and got[2].marks == [] and got[3].marks == []
