import random

from pyspark.sql import functions as F

from corpuscope.functions import paths, text
from corpuscope.operators.scan import explode_lines


def test_split_lines_matches_python(spark):
    rng = random.Random(7)
    pieces = ["a", "b c", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "é", ""]
    samples = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: r.lines for r in df.select("i", text.split_lines(F.col("s")).alias("lines")).collect()}
    assert all(got[i] == s.splitlines() for i, s in enumerate(samples))


def test_strip_matches_python(spark):
    samples = [" a ", "\t\nx ", " y\x1f", "", "  ", "z"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in df.select(text.strip(F.col("s"))).collect()] == [s.strip() for s in samples]


def test_capitalize_matches_python(spark):
    samples = ["abc DEF", "éCOLE", "ßtrasse", "", "x"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(text.capitalize(F.col("s"))).collect()]
    assert got == [s.capitalize() for s in samples]


def test_lines_are_numbered_and_short_files_dropped(files):
    df = files(("r", "four", "X", "1\n2\n3\n4\n"), ("r", "five", "X", "1\n2\n3\n4\n5"), ("r", "none", "X", ""))
    rows = explode_lines(df, 5).collect()
    assert [(r.file_path, r.line_no, r.line) for r in rows] == [("five", i, str(i)) for i in range(1, 6)]


def test_paths(spark):
    df = spark.createDataFrame(
        [("src/app/User.PY",), ("README",), (".gitignore",), ("a\\b\\test_x.py",), ("spec/m.rb",)], "p string"
    )
    p = F.col("p")
    rows = df.select(
        paths.detect_language(p), paths.module_of(p), paths.is_test_file(p), paths.test_stem(p)
    ).collect()
    assert [r[0] for r in rows] == ["Python", "Unknown", "Unknown", "Python", "Ruby"]
    assert [r[1] for r in rows] == ["Src", "Root", "Root", "A", "Spec"]
    assert [r[2] for r in rows] == [False, False, False, True, True]
    assert [r[3] for r in rows] == ["user", "readme", ".gitignore", "x", "m"]


def test_repo_urls_and_keys(spark):
    df = spark.createDataFrame(
        [("git@h:x/y",), (" github.com/a/b/ ",), ("a/b",), ("word",), ("http://github.com/a/b",)], "u string"
    )
    got = [r[0] for r in df.select(paths.normalize_repo_url(F.col("u"))).collect()]
    assert got == ["git@h:x/y", "https://github.com/a/b", "https://github.com/a/b", None,
                   "https://github.com/a/b"]
    keys = spark.createDataFrame([("aHR0cHM6Ly94Lz8-",), ("not base64!",)], "k string")
    assert [r[0] for r in keys.select(paths.decode_repo_key(F.col("k"))).collect()] == [
        "https://x/?>", "not base64!"]
