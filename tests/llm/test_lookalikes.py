"""Look-alike characters: single characters by rule, letters of other scripts by the corpus."""

import pytest

from shelfmark.llm import lookalikes as K


@pytest.mark.parametrize(("text", "plain"), [
    ("Ｈａｎｄｂｏｏｋ １２", "Handbook 12"), ("café", "café"), ("a​b﻿c­d", "abcd"), ("a b c", "a b c"), ("a‑b‐c", "a-b-c"), ("ﬁeld", "field"), ("ｶﾞｲﾄﾞ", "ガイド"), ("⼊門", "入門"), ("Kräfte", "Kräfte"), ("TEORⅡ", "TEORII"),
    ("plain", "plain"), ("Über größe", "Über größe"), ("图（一）：三", "图（一）：三"), ("n.º 5 m³ ™", "n.º 5 m³ ™"), ("می‌خواهم", "می‌خواهم"), ("", ""), ("がん", "がん"),
])
def test_plain_form(text, plain):
    assert K.plain_form(text) == plain and K.plain_form(plain) == plain


def run(spark, values):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "field string, row_id bigint, value string")
    return {r.row_id: r.form for r in K.find_unusual(df).collect()}


def test_scripts_by_corpus(spark):
    clean = ["Handbook of Sensors", "Sensors in Practice", "Основы TeX для словари", "Словари том 5", "α-Handbook mit Ø", "Notes_on_Sensors_v2", "Python入门", "Notes on the Archive"] * 12
    bad = {"Hаndbook оf Sеnsors": "Handbook of Sensors", "Cловари том 7": "Словари том 7", "Notes_οn_Sensors_ν2": "Notes_on_Sensors_v2", "Ρython入门": "Python入门", "Основы ТеХ для словари": "Основы TeX для словари", "Notes оn the Archive": "Notes on the Archive"}
    got = run(spark, [*clean, *bad])
    assert got == {len(clean) + i: v for i, v in enumerate(bad.values())}


def test_repeated_damage_does_not_vouch_for_itself(spark):
    clean = ["Датчики уровня", "Handbook of Sensors"]
    bad = ["Дaтчики уровня"] * 40 + ["Handbоok of Sensors"] * 40
    assert run(spark, [*clean, *bad]) == {i + 2: clean[i >= 40] for i in range(80)}


def test_not_in_vocabulary_stays(spark):
    assert run(spark, ["Qwertzцy alone", "ОсновыTeXдля"]) == {}


def test_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, ["", "   ", "x" * 50000, "é" * 50000, "same", "same"]) == {}
    assert run(spark, ["é" * 30000]) == {0: "é" * 30000}


def test_null_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "A​B", "x", 1), (1, None, "A​B", "x", 1)], "doc_id bigint, file_name string, normalised_name string, plain string, token int")
    paths = spark.createDataFrame([(7, None, "v"), (8, "a/ｂ.pdf", "v")], "id bigint, rel_path string, value string")
    got = K.find_unusual(K.name_values(docs, paths)).select("field", "row_id", "form").distinct().collect()
    assert sorted(map(tuple, got)) == [("normalised_name", 1, "AB"), ("rel_path", 8, "a/b.pdf")]
