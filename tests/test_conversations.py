"""Chat texts of whole conversations."""

from tunelake.operators.records import conversation_prompts

SCHEMA = "conv_id long, turn long, role string, text string"


def test_turns_in_order_and_open_end(spark):
    rows = [
        (1, 2, "assistant", "Yes."), (1, 0, "system", "Be brief."), (1, 1, "user", "So?"),
        (2, 1, "user", None), (2, None, None, "first"), (2, 1, "user", None),
        (None, 5, "user", "no id"),
    ]
    got = {r.conv_id: (r.n_turns, r.prompt) for r in conversation_prompts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got[1] == (3, "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\nSo?<|im_end|>\n<|im_start|>assistant\nYes.<|im_end|>\n")
    assert got[2] == (3, "<|im_start|>\nfirst<|im_end|>\n" + "<|im_start|>user\n<|im_end|>\n" * 2 + "<|im_start|>assistant\n")
    assert got[None] == (1, "<|im_start|>user\nno id<|im_end|>\n<|im_start|>assistant\n")


def test_no_turns(spark):
    assert conversation_prompts(spark.createDataFrame([], SCHEMA)).collect() == []
