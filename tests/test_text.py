import hashlib

import pytest
from pyspark.sql import functions as F

from pairsmith.functions import naming, template, text
from pairsmith.operators import gates, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(("value", "want"), [("\n a \t\n", "a"), ("\u00a0\u3000a b\u2003", "a b"), ("", ""), ("  ", "")])
def test_utrim(spark, value, want):
    assert one(spark, text.utrim(lit(value))) == want


@pytest.mark.parametrize(("value", "has", "think", "answer"), [
    ("<THINKING>\tsum it up </thinking>42, <think>check: 6 x 7</think>as asked", True, "sum it up\n\ncheck: 6 x 7", "42, as asked"),
    ("<思考>甲</思考> a <think>b</think>", True, "b\n\n甲", "a"), ("none", False, "", "none"), ("<think>open", False, "", "<think>open"), ("<think>a\nb</think>\n\nc", True, "a\nb", "c"),
])
def test_think(spark, value, has, think, answer):
    row = one(spark, text.split_think(lit(value)))
    assert (one(spark, text.has_think(lit(value))), row.think, row.answer) == (has, think, answer)


def test_combine(spark):
    assert one(spark, text.combine_reasoning(lit("r"), lit("c"))) == "<think>\nr\n</think>\n\nc"
    assert one(spark, text.combine_reasoning(lit(""), lit("c"))) == "c" == one(spark, text.combine_reasoning(lit(None), lit("c")))
    assert one(spark, text.without_think(text.combine_reasoning(lit("r"), lit(" c ")))) == "c"


@pytest.mark.parametrize(("value", "want"), [("A story. We don't want too many lines here", "A story."), ("plain", "plain"), ("Let's start over", "Let's start over"), ("  ", "  "), ("a SURE! LET'S START OVER b let's start over", "a"), ("\u0130\u0130\u0130\u0130 one Let's start over two", "\u0130\u0130\u0130\u0130 one"), ("one LET'\u017f \u017ftart over", "one"), ("one Let's\nstart over", "one Let's\nstart over"), ("one let's start over\ntwo", "one")])
def test_clean_meta(spark, value, want):
    assert one(spark, text.clean_meta(lit(value))) == want


def test_truncate_and_control(spark):
    assert one(spark, text.truncate(lit("äöüß"), 3)) == "äöü..." and one(spark, text.truncate(lit("äöü"), 3)) == "äöü"
    assert [one(spark, text.has_control_characters(lit(v))) for v in ("a\n\t\r", "a\x07", "a\x7f")] == [False, True, True]


N = "word " * 40


@pytest.mark.parametrize(("value", "finish", "reasoning", "want"), [
    ("x" * 49, "stop", "", "refusal"), ("é" * 25, "stop", "", "incomplete"), (N + "As an AI, no.", "stop", "", "refusal"), (N + "I’m sorry, but I can’t help with that.", "stop", "", None),
    ("a" * 98 + ".", "length", "", "incomplete"), (N, "length", "", None), (N, "stop", "", "incomplete"), (N + "”", "stop", "", "incomplete"), (N + "'", "stop", "", None), (N + ".", None, "", None),
    (N + ".", "content_filter", "", "finish_reason"), (" ", "length", "thought", "token_exhaustion"), ("", "stop", "", "refusal"), ("short", "length", "thought", "incomplete"),
])
def test_gates(spark, value, finish, reasoning, want):
    assert one(spark, gates.failure_reason(lit(value), lit(reasoning), lit(finish))) == want


def test_reasons(spark):
    assert one(spark, gates.refusal_reason(lit(N + "as an AI I cannot provide"))) == "i cannot provide"
    assert one(spark, gates.incomplete_reason(lit(N + "middle"))) == "mid-sentence" and one(spark, gates.incomplete_reason(lit(N + "END)"))) == "no closing punctuation"
    assert [one(spark, gates.incomplete_reason(lit(N + v))) for v in ("the,;", "at", "x" * 300, "word ..", "tail\n'", "un\u00e9")] == ["mid-sentence", "no closing punctuation", "mid-sentence", "no closing punctuation", "no closing punctuation", "no closing punctuation"]
    assert one(spark, stats.completeness(lit("it ends'"))) == "incomplete" and one(spark, stats.completeness(lit(None))) == "empty"


def test_templates(spark):
    t = "Count {{.N}}{{if .Known}}, not {{.Known}}{{end}}."
    assert one(spark, template.render(t, {"N": F.lit(3), "Known": F.lit("")})) == "Count 3."
    assert one(spark, template.render(t, {"N": F.lit(3), "Known": F.lit("ants, bees")})) == "Count 3, not ants, bees."
    assert one(spark, template.render("", {})) == "" and one(spark, template.render("{{if .A}}a{{else}}b{{end}}", {"A": F.lit(0)})) == "b"
    for bad in ("{{.Missing}}", "{{.A", "{{call .Func}}", "{{call .Func}}", "{{if .A}}x", "{{end}}", "{{range .A}}{{end}}"):
        with pytest.raises(template.TemplateError):
            template.render(bad, {"A": F.lit(1)})


def test_names(spark):
    assert one(spark, naming.config_hash(lit("Rivers of Asia"), F.lit(12), F.lit(7))) == hashlib.sha256(b"Rivers of Asia:12:7").hexdigest()[:16]
    assert naming.over_request(100, 0.15) == 114
    assert one(spark, naming.provider_name(lit("https://api.together.ai/v1"))) == "together" and one(spark, naming.provider_name(lit("http://x"))) == "http://x"
    assert one(spark, naming.is_local_endpoint(lit("http://localhost:1/v1"))) and not one(spark, naming.is_local_endpoint(lit("https://my.localhost.example")))


def test_curly_apostrophes_are_told_on_demand(spark):
    long = " more words that make it long enough to pass the other gates, up to the very end of it, as they should do."
    frame = spark.createDataFrame([("I\u2019m sorry, I cannot do it." + long,), ("I'm sorry, I cannot do it." + long,), ("It\u2019s fine." + long,)], "content string")
    frame = frame.selectExpr("content", "'' as reasoning_content", "'stop' as finish_reason")
    assert [r.failure_reason for r in gates.gate(frame).collect()] == [None, "refusal", None]
    assert [r.failure_reason for r in gates.gate(frame, curly=True).collect()] == ["refusal", "refusal", None]
