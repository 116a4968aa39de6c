"""Garbled text: exact round trips through every kind of damage, clean text left alone, defined results."""

import pytest

from shelfmark.llm import garbled as G
from shelfmark.llm import mojibake as M

CLEAN = ["José Nirmurvil", "Schriftgießer Büro 3", "Ołówek® 1.2", "PageSmith™ Pro 7", "Набор Текст 5", "墨文排版 3.0", "システムガイドブック", "The “Dry Run” Guide – 2", "Über flüssige Böden", "¿Qué es un año?", "AVALIAÇÃO DE lições", "Główny wzór", "Ø 70 mm ± 5 m³"]


def damage(text, wrong, right="utf-8"):
    return text.encode(right).decode(wrong, "strict")


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "gbk"])
@pytest.mark.parametrize("text", CLEAN)
def test_round_trip(text, wrong):
    try:
        bad = damage(text, wrong)
    except UnicodeError:
        bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode()) if wrong not in ("gbk",) else None
    if bad is None or bad == text:
        return
    assert M.repair_layers(bad)[0] == text


@pytest.mark.parametrize("text", ["José Nirmurvil", "Schriftgießer Büro 3", "Über flüssige Böden", "The “Dry Run” Guide – 2"])
def test_two_layers(text):
    bad = text
    for _ in range(2):
        bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in bad.encode())
    assert M.repair_layers(bad) == (text, 2)


def test_damage_in_part():
    assert M.repair_layers("Редкий Ð´Ð°Ñ‚Ñ‡Ð¸Ðº")[0] == "Редкий датчик" and M.repair_layers("Schriftgießer BÃ¼ro 3")[0] == "Schriftgießer Büro 3"


@pytest.mark.parametrize("text", CLEAN + ["", "plain", "What Is a Tidal Manifold?", "Python入门与阀门方法", "Α/β-Wert", "Quillforge - ОсновыTeXдляосадки-971.qdoc", "l·l", "naïve café", "x" * 60000, "café " * 20000])
def test_clean_stays(text):
    assert M.repair_layers(text) == (text, 0) and not M.is_lossy(text) and not M.has_control(text) and M.cheapest_reading(text) is None


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, metadata_title string, metadata_author string, metadata_creator string, value string, n bigint, repaired string")
    return {(r.doc_id, r.field): r.repaired for r in G.find_garbled(df).collect()}


def test_operator(spark):
    x = ("v", 1, "r")  # columns whose names clash with the operator's own
    rows = [(i, "Café Lectures", "Zoë Rinponvaberg", None, *x) for i in range(6)]
    rows += [(10, "CafÈ Lectures", "Zo‰ Rinponvaberg", "", *x), (11, "CafÃ© Lectures", "Zo� R", None, *x), (12, None, None, None, *x), (13, "Caf? Lectures", "þÿZoë Rinponvaberg", "ok", *x), (14, "What is it? Why", "", "   ", *x)]
    rows += [rows[-4]]
    got = found(spark, rows)
    assert got[(10, "metadata_title")] == "Café Lectures" and got[(11, "metadata_title")] == "Café Lectures"
    assert got[(11, "metadata_author")] is None and (13, "metadata_title") in got and got[(13, "metadata_author")] == "Zoë Rinponvaberg"
    assert not any(k[0] in (0, 1, 2, 3, 4, 5, 12) for k in got)


def test_question_mark_at_the_end(spark):
    x = ("v", 1, "r")
    rows = [(i, "Notes on the Manifold", "Zoë Rinpon", None, *x) for i in range(4)] + [(10, "What Is a Manifold?", "Rinpon, Zo?", None, *x), (11, None, "Kelv?", "?", *x)]
    assert set(found(spark, rows)) == {(10, "metadata_author"), (11, "metadata_author"), (11, "metadata_creator")}


def test_empty(spark):
    assert found(spark, []) == {}


def test_one_garbled_value_in_many_rows(spark):
    """Its rows don't vouch for it, nor do they make the right words look garbled."""
    bad = damage("Ołowska Żółta Grupa", "cp1252", "cp1250")
    right = {f"Ołowska {x}": 2 for x in "ABCDE"} | {f"Żółta {x}": 2 for x in "ABCDE"}
    df = spark.createDataFrame([*right.items(), (bad, 30_000)], "value string, n bigint")
    assert {r.value: r.repaired for r in G.judge_values(df).collect()} == {bad: "Ołowska Żółta Grupa"}


@pytest.mark.parametrize("layers", [1, 2, 3, 4, 5, 8])
@pytest.mark.parametrize("text", ["Łódź – été", "Müller", "Иван"])
def test_any_number_of_layers(text, layers):
    got = text
    for _ in range(layers):
        got = got.encode("utf-8").decode("latin-1")
    assert M.repair_layers(got) == (text, layers)
