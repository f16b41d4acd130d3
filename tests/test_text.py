"""Text functions and rules on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from docengine.functions import rules, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("value,want", [
    ("RAG vs fig.", "RAG vs fig. retrieval augmented generation retrieval-augmented figure diagram"),
    ("plain words", "plain words"),
    ("(AI), ai", "(AI), ai artificial intelligence artificial intelligence"),
    ("", ""),
])
def test_expand_query(spark, value, want):
    assert one(spark, text.expand_query("x"), value) == want


def test_white_space_is_unicode(spark):
    assert one(spark, text.py_strip("x"), "  a b \n") == "a b"
    assert one(spark, text.py_split("x"), " a b\tc ") == ["a", "b", "c"]


@pytest.mark.parametrize("name,stem,key", [
    ("My Doc (v2).pdf", "My_Doc__v2_", "file_My_Doc__v2__pdf"),
    (".hidden", "_hidden", "file__hidden"),
    ("a.b.txt", "a_b", "file_a_b_txt"),
])
def test_names(spark, name, stem, key):
    assert one(spark, text.image_stem("x"), name) == stem
    assert one(spark, text.file_key("x"), name) == key


@pytest.mark.parametrize("value,want", [("my_doc-v2_pdf", "My Doc-V2"), ("foo.pdf", "Foo"), ("x2y ZED", "X2Y Zed")])
def test_report_title(spark, value, want):
    assert one(spark, text.report_title("x"), value) == want


def test_latex(spark):
    assert one(spark, text.escape_latex_title("x"), "A & B_1 50% #2 $3") == r"A \& B\_1 50\% \#2 \$3"
    assert one(spark, text.sanitize_latex("x"), "a b c d e f") == "a~b~c d e f"


def test_clean_and_math(spark):
    assert one(spark, text.clean_text("x"), "  a\n\n\n\nb \t c ") == "a\n\nb c"
    assert one(spark, text.clean_text("x"), None) == ""
    assert one(spark, text.normalise_math("x"), r"\[a+b\] \(c\) $d$ $d$ x<BR/>y") == "\n$$a+b$$\n $c$ $d$ x · y"


def test_tables_and_lines(spark):
    assert one(spark, text.strip_table_lines("x"), "a\n| b |  \n|c\nd|\n||") == "a\n|c\nd|"
    assert one(spark, text.excise("x", F.array(F.lit("bc"), F.lit("d"))), "abcdbcd") == "a"
    assert one(spark, text.render_table(F.col("x")), [["h", None], ["1", "2"]], "array<array<string>>") == "| h |  |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, text.render_table(F.col("x")), [], "array<array<string>>") == ""
    assert one(spark, text.first_line("x"), "\n a b\nc") == "a b"
    assert one(spark, text.unless_skipped("x"), " skip\n") == ""
    assert one(spark, text.display_name("x"), "my_doc_pdf") == "my doc"
    assert one(spark, text.table_label(F.lit(1), F.lit(2), F.lit(9)), "") == "[TABLE 1 | Page 2/9]"


def test_previews_and_words(spark):
    assert one(spark, text.preview("x"), "a" * 301) == "a" * 300 + "..."
    assert one(spark, text.preview("x"), "a" * 300) == "a" * 300
    assert one(spark, text.overlap_words("x"), " ".join(map(str, range(50)))) == [str(i) for i in range(17, 50)]
    assert one(spark, text.overlap_words("x"), "a b") == ["a", "b"]
    assert one(spark, text.safe_int("x"), " 7 ") == 7 and one(spark, text.safe_int("x"), "") == 0


@pytest.mark.parametrize("value,intent,pages", [
    ("show the architecture diagram", "visual", []),
    ("what is a page table", "visual", []),
    ("explain tcp", "text", []),
    ("tcp handshake", "ambiguous", []),
    ("compare page 3 and p. 12", "visual", [3, 12]),
    ("step 3 of top 10", "ambiguous", [3, 10]),
    ("page 99999999999", "visual", []),
])
def test_intent_and_pages(spark, value, intent, pages):
    assert one(spark, rules.intent("x"), value) == intent
    assert one(spark, rules.explicit_pages("x"), value) == pages


@pytest.mark.parametrize("value,small,start", [
    ("Hi, what is TCP?", True, "Hello!"),
    ("what's up", True, "I'm here"),
    ("history of tcp", False, "I'm here"),
    ("help me", False, "I'm here"),
    (" Help ", True, "Upload"),
    ("thx a lot", True, "You're welcome"),
])
def test_small_talk(spark, value, small, start):
    assert one(spark, rules.is_small_talk("x"), value) is small
    assert one(spark, rules.small_talk_reply("x"), value).startswith(start)


def test_short_and_visual(spark):
    assert one(spark, rules.is_short("x"), "a b c d") and not one(spark, rules.is_short("x"), "a b c d e")
    kind = "struct<i:array<struct<w:double,h:double>>,e:array<struct<w:double,h:double>>,d:array<struct<w:double,h:double>>>"
    why = rules.has_visual_content(F.col("x.i"), F.col("x.e"), F.col("x.d"), F.lit(10_000.0))
    assert one(spark, why, ([(20.0, 25.0)], None, None), kind) == "1 raster image(s)"
    assert one(spark, why, (None, [(30.0, 30.0), (1.0, 1.0)], None), kind) == "1 embedded image(s)"
    assert one(spark, why, ([], [], [(100.0, 20.0), (100.0, 90.0)]), kind) == "1 vector graphic(s)/diagram(s)"
    assert one(spark, why, ([(1.0, 1.0)], None, []), kind) == "no visual content"
