"""Texts are freed of all blanks around them, and a field with nothing else doesn't stand before the others."""

from utterlake.functions import normalise


def texts(df, use_asr=True):
    return [r["input_text"] for r in normalise.select_input_text(df, use_asr).collect()]


def test_tabs_and_line_ends_are_no_text(spark):
    fields = "array<struct<text:string,transcript:string,hypothesis:string,value:double>>"
    found = [([("\n", "\t set alarm \r\n", "x", None)],), ([(None, "\u3000", "\x1c", 2.0)],), ([("a\n b ", "x", "x", None)],), ([("\t", None, "", None)],), ([],), (None,)]
    assert texts(spark.createDataFrame(found, f"asr_hypotheses {fields}")) == ["set alarm", "2.0", "a\n b", "", "", ""]
    plain = [(["\t", "b"], "\n", "t\n"), (["c \n", "b"], "\u3000s\t", "t")]
    df = spark.createDataFrame(plain, "asr_hypotheses array<string>, sentence string, text string")
    assert texts(df) == ["", "c"] and texts(df, False)[1] == "s"
