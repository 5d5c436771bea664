from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from partloom.llm.chat import CHAT, Template, chat_digests, format_conversations, parse, quote, read_back, unquote

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, _role string, piece string, turns int"
PARTS = [*CHAT.controls, "[\\INST]", "[\\\\/INST]", "<\\/s>", "<", "[", "\\", "/s>", "INST]", "<S", "é", "日", " ", "\n", "a", "$1", ">", "]", "\r"]


def _hard(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 9)))


def _rows():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "</s>", "[ROLE]", "[\\/ROLE]", "user ", "a\nb", "[/ROLE]x", "<s>[INST]"]
    rows = [(rng.randrange(60), rng.choice([None, *range(8)]), rng.choice(roles), rng.choice([None, "", _hard(rng), _hard(rng)]), "x", "y", "z", 1) for _ in range(600)]
    rows += [(None, 1, "user", "no id", "x", "y", "z", 1), (None, 0, "assistant", "first", "x", "y", "z", 1)]
    return [*rows, *rows[:5], (900, 0, "assistant", "long [INST] " * 200_000, "x", "y", "z", 1)]


def _wanted(rows):
    groups: dict = {}
    for c, turn, role, text, *_ in rows:
        groups.setdefault(c, []).append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, r, t in sorted(g)] for c, g in groups.items()}


def test_every_conversation_comes_back(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want = _wanted(rows)
    got = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert r.exact and [(t.role, t.text) for t in r.turns] == turns, c
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
    digests = {r.conv_id: r for r in chat_digests(df).collect()}
    for c, turns in want.items():
        d, loss = digests[c], got[c].loss_text
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d.formatted_chars == len(got[c].formatted)


def test_only_conflicting_content_is_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain [brackets] <b> \\ stay"), (2, 0, "user", "a [INST] b"), (3, 0, "</s>", "x"), (4, 0, "user", "said [\\INST]")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.formatted, r.n_escaped) for r in format_conversations(df).collect()}
    assert got[1] == ("<s>[INST]plain [brackets] <b> \\ stay[/INST]</s>", 0)
    assert got[2] == ("<s>[INST]a [\\INST] b[/INST]</s>", 1)
    assert got[3] == ("<s>[ROLE]<\\/s>[/ROLE]x</s>", 1)
    assert got[4] == ("<s>[INST]said [\\\\INST][/INST]</s>", 1)


def test_quoting_is_undone(spark):
    rng = random.Random(8)
    texts = [_hard(rng) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(unquote(quote(F.col("t"))) != F.col("t")).count() == 0
    assert df.filter(quote(F.col("t")).rlike(CHAT.plain)).count() == 0


def test_parser_refuses_what_is_no_turn(spark):
    bad = ["x", "<s>[INST]open</s>", "[INST]a[/INST]</s>", "<s>a</s>rest", "<s>a<s>b</s>", "<s>[ROLE]r</s>", "<s>[INST]a[INST]b[/INST]</s>"]
    df = spark.createDataFrame([(t,) for t in bad], "t string").select("t", F.exists(parse(F.col("t")), lambda t: t.isNull()).alias("refused"))
    assert all(r.refused for r in df.collect())


def test_other_template_and_empty_table(spark):
    own = Template(begin="{{", end="}}", marks=(("user", "(u)", "(/u)"),), named=("(r)", "(/r)"), loss_role="bot")
    df = spark.createDataFrame([(1, 0, "user", "a}}b"), (1, 1, "bot", "{{(u)x"), (1, 2, "sys", "(/r)")], "conv_id long, turn long, role string, text string")
    [r] = read_back(format_conversations(df, own), own).collect()
    assert r.exact and [(t.role, t.text) for t in r.turns] == [("user", "a}}b"), ("bot", "{{(u)x"), ("sys", "(/r)")] and r.loss_text == "{{(u)x"
    assert format_conversations(df.limit(0)).count() == 0


def test_no_python_worker(spark):
    plan = chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
