"""Text rules against a plain-Python statement of them, on fixed and random names."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from shelfmark.functions import text as X

CASES = [
    "report_final-v2.pdf", "  spaced   out .PDF", "Straße nach Köln.pdf", "机器学习 入门.pdf", "..hidden.pdf", ".pdf", "noext", "a/b\\c/d.e.pdf", "x.toolongextension", "tab\there.pdf", "ctrl\x01\x02x.pdf", "·dots·.pdf", "",
    "A" * 130 + ".pdf", "word " * 40 + ".pdf", "漢" * 140 + ".pdf", "漢" * 110 + " tail " + "漢" * 40, "ﬁeld.guide.pdf", "name.p-f", "dir.v1/file", "e\u0301tude.pdf", "\ufffdbad\ufffd.pdf",
]


def py_clean(x):
    x = re.sub("[\x00-\x1f·\ufffd]", "", x or "")
    return re.sub(r"\s+", " ", x).strip()


def py_strip(x):
    if "." in x.lstrip("."):
        stem, _, ext = x.rpartition(".")
        if 1 <= len(ext) <= 8 and ext.isalnum():
            return stem
    return x


def is_cjk(c):
    return "\u4e00" <= c <= "\u9fff" or "\u3400" <= c <= "\u4dbf" or "\uf900" <= c <= "\ufaff"


def py_cut(name):
    if len(name) <= 120:
        return name
    for i in range(119, 100, -1):
        if not is_cjk(name[i]):
            return name[:i].rstrip()
    return name[:120]


def py_normalise(x):
    base = x.replace("\\", "/").rpartition("/")[2]
    name = base if py_strip(base) != base else x
    name = py_clean(py_strip(name)).lstrip(".")
    name = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in name)
    return py_cut(" ".join(w[:1].upper() + w[1:].lower() for w in name.split()))


def random_names(n):
    r = random.Random(5)
    alphabet = "abcXYZ 09._-/\\漢字·\x03 éßł(),"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 170))) for _ in range(n)]


def test_normalise_against_model(spark):
    names = CASES + random_names(1500)
    df = spark.createDataFrame(list(enumerate(names)), "i int, x string")
    got = {r.i: r for r in df.select("i", X.normalise(F.col("x")).alias("n"), X.clean_text(F.col("x")).alias("c"), X.normalise_file_name(F.col("x")).alias("f")).collect()}
    for i, x in enumerate(names):
        assert got[i].c == py_clean(x), x
        assert got[i].n == py_normalise(x), x
        assert got[i].f == py_normalise(x) + (".pdf" if x.lower().endswith(".pdf") else ""), x


def test_null_and_lists(spark):
    df = spark.createDataFrame([(None, " a, ,b ,", [" x", "x", "", "a"])], "n string, l string, t array<string>")
    r = df.select(X.clean_text(F.col("n")), X.normalise(F.col("n")), X.split_list(F.col("l")), X.split_list(F.col("n")), X.clean_terms(F.col("t")), X.shorten(F.col("n"), 5), X.shorten(F.lit("one\ntwo three"), 6), X.path_prefixes(F.lit("a/b/c"))).first()
    assert list(r) == ["", None, ["a", "b"], [], ["a", "x"], "", "one t…", ["a", "a/b", "a/b/c"]]


def test_paths(spark):
    want = {"a/b.pdf": "a/b.pdf", "./a/../b.pdf": "b.pdf", "../a.pdf": None, "a/../../b.pdf": None, "/etc/a.pdf": None, "a//b/./c.PDF": "a/b/c.PDF", "": "", "C:\\x.pdf": None, "a\\b.pdf": "a/b.pdf"}
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r.p: r.n for r in df.select("p", X.normal_path(F.col("p")).alias("n")).collect()} == want


def test_confidence(spark):
    df = spark.createDataFrame([("low",), ("medium",), ("high",), (None,), ("",), ("sure",)], "c string")
    assert [r[0] for r in df.select(X.confidence_rank(F.col("c"))).collect()] == [0, 1, 2, 0, 0, -1]
