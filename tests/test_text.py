"""Golden cases of cleaning and tokens."""

import uuid

import pytest
from pyspark.sql import functions as F

from folioscope.functions import predicates as P
from folioscope.functions import text as X
from folioscope.functions.tokens import search_terms, word_count, word_pieces
from folioscope.functions.vectors import point_id
from folioscope.operators import cleaning, headings


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "text string")
    return df.select(column(F.col("text")).alias("r")).first().r


@pytest.mark.parametrize(
    "before, after",
    [("ABCABC", "ABC"), ("ABCDABCD", "ABCDD"), ("ABABAB", "ABB"), ("ABCXABCY", "ABCXY"), ("AB", "AB")],
)
def test_block_dedupe(spark, before, after):
    df = spark.createDataFrame([("\n".join(before),)], "text string")
    assert cleaning.dedupe_blocks(df).first().text == "\n".join(after)


@pytest.mark.parametrize(
    "lines, kept",
    [
        (["[", "[ item"], ["- item"]),
        (["[", "[", "Item"], ["Item"]),
        (["[12] Smith"], ["- 12] Smith"]),
    ],
)
def test_bullets(spark, lines, kept):
    assert one(spark, "\n".join(lines), lambda c: X.collapse_bullets(X.lines_of(c))) == kept


def test_header_with_double_space_is_kept(spark):
    text = "RECOMMENDATION\nGUIDELINE FOR THE  PHARMACOLOGICAL TREATMENT OF HYPERTENSION IN\n 12 \n x\t y"
    df = spark.createDataFrame([(text,)], "text string")
    assert cleaning.clean_text(df).first().text == (
        "GUIDELINE FOR THE PHARMACOLOGICAL TREATMENT OF HYPERTENSION IN\nx y"
    )


def test_line_boundaries(spark):
    text = "a\r\nb\x0bc\x0cd\x1ce\x85f g\rh"
    assert one(spark, text, X.lines_of) == text.splitlines()


def test_search_terms(spark):
    text = "BP 140/90 and 130-139; thiazide-like é-x a 5 café"
    assert one(spark, text, search_terms) == ["bp", "140/90", "and", "130-139", "thiazide-like", "5"]


@pytest.mark.parametrize("text", ["", "  ", " a  b\n", "a", "\n\na b ", "a b c", "x  y\x1cz"])
def test_word_pieces(spark, text):
    pieces = one(spark, text, word_pieces)
    assert len(pieces) == len(text.split()) == one(spark, text, word_count)
    if pieces:
        assert "".join(pieces) == text


def test_cut_and_title(spark):
    assert one(spark, "a\nb \n references \nc", lambda c: X.cut_at_line(c, ["REFERENCES"])) == "a\nb"
    assert one(spark, "T\na\n t \nb", lambda c: X.keep_first_title(c, F.lit("t"))) == "T\na\nb"


def test_excluded_word_inside_title(spark):
    assert one(spark, "Body mass index", P.has_excluded_word)
    assert not one(spark, "Body mass", P.has_excluded_word)


@pytest.mark.parametrize(
    "line, heading",
    [
        ("1.1 Measuring blood pressure", True),
        ("c. text", True),
        ("Part in the study", True),
        ("Lifestyle interventions", True),
        ("SPECIAL CASES", True),
        ("SPECIAL CASES.", False),
        ("1) Title", False),
        ("https://x.org", False),
        ("page 3 of 9", False),
        ("plain words here", False),
    ],
)
def test_rule_headings(spark, line, heading):
    assert one(spark, line, P.is_rule_heading) is heading


def test_continuations(spark):
    text = "1. RECOMMENDATION ON A\nB C\n2. RECOMMENDATION ON D.\nE\n3. RECOMMENDATION ON F\n4. RECOMMENDATION ON G\nH"
    assert one(spark, text, lambda c: headings.merge_continuations(X.lines_of(c))) == [
        "1. RECOMMENDATION ON A B C",
        "2. RECOMMENDATION ON D.",
        "E",
        "3. RECOMMENDATION ON F 4. RECOMMENDATION ON G",
        "H",
    ]


@pytest.mark.parametrize("name", ["who_001_section_003_c001", "é/ü"])
def test_point_id(spark, name):
    assert one(spark, name, point_id) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_names_from_paths(spark):
    path = "data\\raw\\My_2024-file (1).pdf"
    assert one(spark, path, X.document_id_of) == "doc_my_2024-file__1_"
    assert one(spark, path, X.document_name_of) == "my 2024-file (1)".title()
