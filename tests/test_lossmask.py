import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_functions import letters
from turnloom.functions.template import CHATML, ChatTemplate
from turnloom.functions.tokens import PIECES, FunctionTokenizer
from turnloom.operators.lossmask import (
    align_mask,
    finalise_samples,
    flatten_messages,
    mask_kind,
    mask_totals,
    texts_under_mask,
    token_rows,
    with_loss_mask,
    with_turn_loss_mask,
)
from turnloom.plans.sft import sft_samples

CHAT = [
    ("system", "Be brief."),
    ("user", "Hi there"),
    ("assistant", "Hello."),
    ("user", "Why?"),
    ("assistant", "Because I can"),
]
MESSAGES = "messages array<struct<role:string,content:string>>"
STEPS = "messages array<struct<role:string,content:string,step_loss_mask:int>>"


def chats(spark, *lists, schema=MESSAGES):
    return spark.createDataFrame([(m,) for m in lists], schema)


@pytest.mark.parametrize(
    "kind,size,ones,length",
    [
        ("qwen_simple", 38, 10, 19),
        ("qwen", 38, 10, 19),
        ("qwen3", 38, 10, 19),
        ("distill_qwen", 16, 5, 5),
    ],
)
def test_goldens(spark, kind, size, ones, length):
    masked = with_loss_mask(chats(spark, CHAT), kind)
    row = masked.first()
    assert len(row.tokens) == len(row.loss_mask) == size
    assert sum(row.loss_mask) == ones
    expected = [0] * 19 + [1] * 3 + [0] * 9 + [1] * 7
    if kind == "distill_qwen":
        expected = [0] * 11 + [1] * 5
    assert row.loss_mask == expected
    final = finalise_samples(masked).first()
    assert (final.response_length, final.reward) == (length, 0.0)
    assert final.loss_mask == expected[-length:]


def test_simple_tokens_render_the_chat(spark):
    row = with_loss_mask(chats(spark, CHAT)).first()
    assert "".join(row.tokens) == CHATML.render_text(CHAT)


def test_no_answer_gives_empty_mask(spark):
    row = sft_samples(chats(spark, CHAT[:2])).first()
    assert (row.response_length, row.loss_mask) == (0, [])
    assert len(row.tokens) > 0


def test_template_with_its_own_system_turn(spark):
    template = ChatTemplate(default_system="You help.")
    row = with_loss_mask(chats(spark, CHAT[1:]), "qwen", template=template).first()
    assert "".join(row.tokens) == template.render_text(CHAT[1:])
    assert sum(row.loss_mask) == 10
    for kind in ("qwen_simple", "qwen3"):
        with pytest.raises(ValueError):
            with_loss_mask(chats(spark, CHAT), kind, template=template)


def test_unsupported_roles(spark):
    late = [CHAT[1], CHAT[0]]
    with pytest.raises(PySparkException, match="not supported"):
        with_loss_mask(chats(spark, late)).collect()
    kept = with_loss_mask(chats(spark, late, CHAT), on_unsupported="drop")
    assert kept.count() == 1


def test_step_override(spark):
    steps = [(r, c, 0 if c == "Hello." else None) for r, c in CHAT]
    df = chats(spark, steps, schema=STEPS)
    assert sum(with_loss_mask(df, "qwen").first().loss_mask) == 7
    assert sum(with_loss_mask(df, "qwen3").first().loss_mask) == 7
    assert sum(with_loss_mask(df, "qwen_simple").first().loss_mask) == 10
    assert sum(with_loss_mask(df, "distill_qwen").first().loss_mask) == 5
    last = [(r, c, 0 if i == 4 else 1) for i, (r, c) in enumerate(CHAT)]
    masked = with_loss_mask(chats(spark, last, schema=STEPS), "distill_qwen").first()
    assert sum(masked.loss_mask) == 0


def test_tools_go_to_the_first_message(spark):
    df = chats(spark, CHAT).withColumn("tools", F.lit("f(x)"))
    row = with_loss_mask(df, "qwen", tools="tools").first()
    assert "".join(row.tokens).startswith("<|im_start|>system\nBe brief.\n\n# Tools\n\nf(x)<|im_end|>")
    assert sum(row.loss_mask) == 10
    assert "f(x)" not in with_loss_mask(df, "qwen_simple", tools="tools").first().tokens


def test_mask_kind():
    assert mask_kind("qwen", PIECES) == "qwen"
    assert mask_kind("qwen", FunctionTokenizer(letters, ("<｜Assistant｜>",))) == "distill_qwen"
    with pytest.raises(ValueError):
        mask_kind("other", PIECES)


def test_function_tokenizer_masks(spark):
    tokenizer = FunctionTokenizer(letters)
    for kind in ("qwen_simple", "qwen", "qwen3"):
        row = with_loss_mask(chats(spark, CHAT), kind, tokenizer=tokenizer).first()
        assert "".join(map(chr, row.tokens)) == CHATML.render_text(CHAT)
        learned = "".join(chr(t) for t, m in zip(row.tokens, row.loss_mask) if m)
        assert learned == "Hello.<|im_end|>\nBecause I can<|im_end|>\n"
    masked = with_loss_mask(chats(spark, CHAT), tokenizer=tokenizer)
    texts = masked.select(texts_under_mask(F.col("tokens"), F.col("loss_mask"), tokenizer)).first()
    assert texts[0] == ["Hello.<|im_end|>\n", "Because I can<|im_end|>\n"]


def test_turn_form_equals_record_form(spark):
    turns = spark.createDataFrame(
        [(1, i, r, c) for i, (r, c) in enumerate(CHAT)],
        "conv int, turn int, role string, text string",
    )
    for kind in ("qwen_simple", "qwen", "qwen3"):
        rows = with_turn_loss_mask(turns, "turn", kind).orderBy("turn").collect()
        whole = with_loss_mask(chats(spark, CHAT), kind).first()
        assert [t for r in rows for t in r.tokens] == whole.tokens
        assert [b for r in rows for b in r.loss_mask] == whole.loss_mask


def test_token_rows_and_runs(spark):
    df = spark.createDataFrame(
        [(1, list("abcde"), [0, 1, 1, 0, 1])], "id int, tokens array<string>, loss_mask array<int>"
    )
    assert df.select(texts_under_mask(F.col("tokens"), F.col("loss_mask"))).first()[0] == ["bc", "e"]
    rows = [tuple(r) for r in token_rows(df, ["id"]).collect()]
    assert rows == [(1, i, t, m) for i, (t, m) in enumerate(zip("abcde", [0, 1, 1, 0, 1]))]


def test_multimodal(spark):
    content = '[{"type":"text","text":"a"},"b",{"type":"image"},{"type":"text"}]'
    df = spark.createDataFrame([(content,)], "c string").select(
        F.array(
            F.struct(F.lit("user").alias("role"), F.parse_json("c").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.lit("x y").cast("variant").alias("content")),
        ).alias("messages")
    )
    flat = flatten_messages(df)
    assert [m.content for m in flat.first().messages] == ["a b ", "x y"]
    mask = F.array(F.lit(1), F.lit(1))
    ids = spark.range(1).select(align_mask(mask, F.sequence(F.lit(1), F.lit(5))))
    assert ids.first()[0] == [0, 0, 0, 1, 1]
    with pytest.raises(PySparkException, match="shorter"):
        spark.range(1).select(align_mask(mask, F.array(F.lit(1)))).collect()


def test_mask_totals_across_blocks(spark, tiny_blocks):
    rows = [(c, t, "assistant" if t % 3 == 2 and c else "user", "a b") for c in range(3) for t in range(9)]
    turns = spark.createDataFrame(rows, "conv int, turn int, role string, text string")
    masked = with_turn_loss_mask(turns, "turn")
    totals = {r.conv: r for r in mask_totals(masked, "conv", "turn").collect()}
    for conv in range(3):
        bits = [b for r in masked.filter(f"conv = {conv}").orderBy("turn").collect() for b in r.loss_mask]
        length = len(bits) - bits.index(1) if 1 in bits else 0
        found = totals[conv]
        assert (found.n_tokens, found.n_ones, found.response_length) == (len(bits), sum(bits), length)
