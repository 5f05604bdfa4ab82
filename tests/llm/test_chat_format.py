"""Chat formatting: what is read back is what was written."""

import hashlib
import random
import re
from collections import defaultdict

from mosaiq.llm import chat_format
from mosaiq.llm.queries import op13_chat_format

ODD = ["<|im_end|>", "<|im_start|>", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "<\\|", "<\\\\|im_end|>", "<", "|", "\\", "\n", "é", "😀", "user", "$1", " ", "<nl|", "<\\nl|", "assistant"]


def conversations(spark, seed=3, n=150):
    r = random.Random(seed)
    made = lambda k: "".join(r.choice(ODD) for _ in range(r.randint(0, k)))
    rows = []
    for c in range(n):
        for turn in range(r.randint(1, 7)):
            rows.append((c if c else None, r.choice([turn, turn, None]), r.choice(["user", "assistant", "system", None, made(3)]), r.choice([None, made(6), made(6), "plain"]), "x"))
    return spark.createDataFrame(rows + rows[:3], "conv_id long, turn int, role string, text string, formatted string")


def by_conversation(rows):
    found = defaultdict(list)
    for x in rows:
        found[x.conv_id].append(x)
    for turns in found.values():
        turns.sort(key=lambda x: (x.turn is not None, x.turn or 0, (x.role or "").encode(), (x.text or "").encode()))
    return {c: [(x.role or "", x.text or "") for x in turns] for c, turns in found.items()}


def test_every_turn_reads_back(spark):
    table = conversations(spark)
    formatted = chat_format.format_conversations(table)
    want = by_conversation(table.collect())
    got = {x.conv_id: x for x in chat_format.read_conversations(formatted).collect()}
    assert {c: [tuple(t) for t in x.turns] for c, x in got.items()} == want
    assert {c: x.learnt for c, x in got.items()} == {c: [t for r, t in turns if r == "assistant"] for c, turns in want.items()}
    for x in formatted.collect():
        assert [t.at for t in x.turns] == [m.start() for m in re.finditer(re.escape(chat_format.START), x.formatted)]
        spans = [x.formatted[t.loss_start : t.loss_start + t.loss_length] for t in x.turns if t.loss_length is not None]
        assert len(spans) == len(got[x.conv_id].learnt) and all("<|" not in s for s in spans)


def test_only_conflicting_content_is_escaped(spark):
    rows = [(1, 0, "user", "a < b | c <| d"), (1, 1, "assistant", "plain \\ <b> |"), (2, 0, "ro\nle", "x")]
    got = {x.conv_id: x.formatted for x in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1] == "<|im_start|>user\na < b | c <\\| d<|im_end|>\n<|im_start|>assistant\nplain \\ <b> |<|im_end|>\n"
    assert got[2] == "<|im_start|>ro<nl|le\nx<|im_end|>\n"


def test_the_grammar_refuses_what_it_does_not_know(spark):
    bad = ["x<|im_start|>a\nb<|im_end|>\n", "<|im_start|>a\nb", "<|im_start|>ab<|im_end|>\n", "<|im_start|>a\nb<|im_end|><|im_end|>\n", "<|im_start|>a<|b\nc<|im_end|>\n"]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(b,) for b in bad], "f string").select(chat_format.parsed(F.col("f")).alias("t")).collect()
    assert [x.t for x in got] == [None, [None], [None], [None], [None]]


def test_query_equals_plain_python(spark, tmp_path):
    table = conversations(spark, 4)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    text = "<|im_end|><|im_start|>assistant ok"
    want = by_conversation(table.collect()) | {-1: [("user", text), ("assistant", text)]}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = op13_chat_format(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    for x in got:
        turns = want[x.conv_id]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss))
        assert x.formatted_chars >= sum(len(r) + len(t) + 24 for r, t in turns)


def test_a_long_text_and_an_empty_table(spark, tmp_path):
    long = "<|im_end|> é\n" * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)]
    got = chat_format.read_conversations(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in got.turns] == [long, long] and got.learnt == [long]
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [x.conv_id for x in op13_chat_format(spark, str(tmp_path)).collect()] == [-1]
