import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.functions.arrays import response_length, runs_of_ones, sublist_positions, tail
from turnloom.functions.template import CHATML, ChatTemplate, payload_flags
from turnloom.functions.text import judge_verdict, rule_verdict, tag_content, word_count
from turnloom.functions.tokens import PIECES, FunctionTokenizer, template_overhead

QUICK = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def results(df, *columns):
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    return [tuple(r) if len(r) > 1 else r[0] for r in rows]


def test_word_count(spark):
    df = column(spark, ["", "a", " a  b ", "a\nb c", "é è"])
    assert results(df, word_count(F.col("x"))) == [1, 1, 5, 2, 2]


def test_tags_and_verdicts(spark):
    texts = [
        "x <ANSWER> Yes </answer><answer>no</answer>",
        "none",
        "<answer></answer>",
        "<answer>yes.</answer>",
        None,
        "<answer> yes\x1c</answer>",
    ]
    x = F.col("x")
    assert results(
        column(spark, texts),
        tag_content(x, "answer"),
        tag_content(x, "answer", strict=False),
        judge_verdict(x),
    ) == [
        ("Yes", "Yes", True),
        ("", "none", False),
        ("", "<answer></answer>", False),
        ("yes.", "yes.", False),
        (None, None, True),
        ("yes", "yes", True),
    ]
    with pytest.raises(ValueError):
        tag_content(x)


def test_tag_pair_is_literal(spark):
    df = column(spark, ["a (*x.*) b", "(*\nq\n*)", "(x)"])
    assert results(df, tag_content(F.col("x"), pair=("(*", "*)"))) == ["x.", "q", ""]


def test_rule_verdict(spark):
    texts = ["<answer>True</answer>", "<answer> true\n</answer>", "<answer>1</answer>", "True"]
    assert results(column(spark, texts), rule_verdict(F.col("x"))) == [True, True, False, False]


def test_assistant_spans(spark):
    head, end = "<|im_start|>assistant\n", "<|im_end|>"
    texts = [
        f"{head} a \n{end}\n<|im_start|>user\nq{end}\n{head}b{end}",
        f"{head}open",
        f"{head}swallows <|im_start|>user\nq{end}\n{head}{end}",
        "nothing",
    ]
    assert results(column(spark, texts), CHATML.assistant_spans(F.col("x"))) == [
        ["a", "b"],
        [],
        ["swallows <|im_start|>user\nq", ""],
        [],
    ]


def test_masks(spark):
    df = column(spark, [[0, 1, 0, 1], [0, 0], [], [1]], "array<int>")
    x = F.col("x")
    assert results(df, response_length(x)) == [3, 0, 0, 1]
    assert results(df, tail(x, response_length(x))) == [[1, 0, 1], [], [], [1]]
    assert [[tuple(r) for r in row] for row in results(df, runs_of_ones(x))] == [
        [(1, 1), (3, 1)],
        [],
        [],
        [(0, 1)],
    ]


def test_sublist_positions(spark):
    cases = [
        ([1, 2, 1, 2, 1], [1, 2, 1], [0, 2]),
        ([1, 1, 1], [1, 1], [0, 1]),
        ([1], [1, 2], []),
        ([], [1], []),
        ([1, 2], [], [0, 1, 2]),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "a array<int>, b array<int>")
    assert results(df, sublist_positions(F.col("a"), F.col("b"))) == [c[2] for c in cases]


@QUICK
@given(
    st.lists(st.integers(0, 1), max_size=12), st.lists(st.integers(0, 1), max_size=3)
)
def test_sublist_positions_brute(spark, values, part):
    df = spark.createDataFrame([(values, part)], "a array<int>, b array<int>")
    expected = [
        i for i in range(len(values) - len(part) + 1) if values[i : i + len(part)] == part
    ]
    assert results(df, sublist_positions(F.col("a"), F.col("b"))) == [expected]


@QUICK
@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
def test_pieces_are_lossless(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["a<b<|im_end|> <|im_x"]
    df = column(spark, texts)
    assert results(df, PIECES.text(PIECES.one(F.col("x")))) == texts
    assert results(df, F.size(PIECES.one(F.col("x")))) == [PIECES.size_of(t) for t in texts]


def test_render_and_flags(spark):
    template = ChatTemplate(default_system="Help.")
    df = spark.createDataFrame(
        [([("user", "# Tools?")], None), ([("system", "s"), ("user", "q")], "t()")],
        "m array<struct<role:string,content:string>>, tools string",
    )
    plain = template.render(F.col("m"), generation=True)
    tooled = template.render(F.col("m"), tools=F.col("tools"))
    assert results(df, plain, tooled) == [
        (
            template.render_text([("user", "# Tools?")], generation=True),
            template.render_text([("user", "# Tools?")]),
        ),
        (
            template.render_text([("system", "s"), ("user", "q")], generation=True),
            template.render_text([("system", "s\n\n# Tools\n\nt()"), ("user", "q")]),
        ),
    ]
    flags = payload_flags(CHATML.render(F.col("m")))
    assert results(df, *flags) == [(False, True), (True, False)]


def letters():
    """Ids are code points."""
    return (
        lambda texts: [[ord(c) for c in t] for t in texts],
        lambda lists: ["".join(map(chr, ids)) for ids in lists],
    )


def test_function_tokenizer(spark):
    tokenizer = FunctionTokenizer(letters)
    df = column(spark, ["ab", None, ""])
    assert results(df, tokenizer.one(F.col("x"))) == [[97, 98], None, []]
    assert results(df, tokenizer.text(tokenizer.one(F.col("x")))) == ["ab", "", ""]
    lists = column(spark, [["a", "bc"], []], "array<string>")
    assert results(lists, tokenizer.many(F.col("x"))) == [[[97], [98, 99]], []]


@pytest.mark.parametrize("tokenizer", [PIECES, FunctionTokenizer(letters)])
def test_template_overhead(tokenizer):
    template = ChatTemplate(default_system="You help.")
    header = tokenizer.size_of(template.generation_header)
    assert template_overhead(template, tokenizer) == (tokenizer.size_of(template.prefix), header)
    assert template_overhead(CHATML, tokenizer) == (0, header)
