import hashlib
import random

from pyspark.sql import functions as F

from linescan.llm import chat


def test_escapes_are_reversible(spark):
    rng = random.Random(0)
    bits = [*chat.TEMPLATE["controls"], "<", "[", "\\", "|im_end|>", "INST]", "/s>", "a", "\n", "%", "%25", "é", "<SYS>>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    held = chat.escape_text(F.col("t"))
    rows = df.select("t", held.alias("e"), chat.unescape_text(held).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect()
    for r in rows:
        assert r.u == r.t and r.r == r.t
        assert not any(c in r.e for c in chat.TEMPLATE["controls"])


TURNS = [
    (1, 0, "user", "hi <|im_end|>\n"), (1, 1, "assistant", "[/INST] yes"), (1, 2, "user", None), (1, 3, "assistant", "\\</s>"),
    (2, 0, "assistant", "first"), (3, 0, "system", "s"), (3, 1, "user", "u"), (4, None, None, None), (4, 5, "we<ird\n", "x"),
    (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 0, "assistant", "tie"), (None, 0, "user", "q"), (None, 1, "assistant", "a"),
]


def test_conversations(spark):
    df = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, segments string, n_turns int")
    made = chat.format_conversations(df)
    rows = made.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    expected = {}
    for c, n, role, text in TURNS:
        expected.setdefault(c, []).append((n if n is not None else -1, role or "", text or ""))
    assert {r.conv_id for r in rows} == set(expected)
    bad = {}
    for r in rows:
        turns = sorted(expected[r.conv_id])
        assert [(t.role, t.text) for t in r.back] == [(a, b) for _, a, b in turns] and r.n_turns == len(turns)
        assert r.loss == "".join(b for _, a, b in turns if a == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        bad[r.conv_id] = r.bad_turn
    assert bad == {1: None, 2: 0, 3: 2, 4: 0, 5: 0, None: None}
    assert chat.format_conversations(df.where("false")).count() == 0


def test_probe(spark):
    from tests.conftest import DATA

    r = chat.op9_chat_formatting(spark, DATA).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_long_conversations(spark):
    import random

    rng = random.Random(1)
    turns = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </s> {rng.random()}") for i in range(4000)]
    turns += [(2, 0, "user", "x [INST] " * 120_000), (2, 1, "assistant", "<|im_end|>\\" * 80_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    made = chat.format_conversations(df)
    for r in made.select("conv_id", "n_turns", "bad_turn", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect():
        own = [t for t in turns if t[0] == r.conv_id]
        assert r.bad_turn is None and r.n_turns == len(own) and [(t.role, t.text) for t in r.back] == [t[2:] for t in own]
        assert r.loss == "".join(t[3] for t in own if t[2] == "assistant")
    assert chat.format_conversations(df.where("false")).count() == 0


def test_machine_over_blocks(spark, monkeypatch):
    """Whatever the block, the machine stops at the same turn and emits the same; a long conversation is walked in parts."""
    rng = random.Random(2)
    talks = [[rng.choice(["user", "assistant"]) for _ in range(rng.randint(1, 12))] for _ in range(60)] + [["system", *["user", "assistant"] * 400], ["user", "assistant"] * 300 + ["assistant", "user"]]
    rows = [(c, n, role, f"{role} {n}") for c, talk in enumerate(talks) for n, role in enumerate(talk)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def brute(talk):
        state = "start"
        for n, role in enumerate(talk):
            if (state, role) not in chat.TEMPLATE["moves"]:
                return n
            state = chat.TEMPLATE["moves"][state, role]
        return None if state in chat.TEMPLATE["accept"] else len(talk)

    for block in (1, 3, 128):
        monkeypatch.setattr(chat, "BLOCK_TURNS", block)
        for r in chat.format_conversations(df.where("conv_id < 60") if block == 1 else df).collect():
            talk = talks[r.conv_id]
            assert r.bad_turn == brute(talk) and r.n_turns == len(talk)
            assert [s.text for s in r.segments if s.loss] == [f"assistant {n}" for n, role in enumerate(talk) if role == "assistant"]
            assert len(r.segments) == 3 * len(talk)


def test_loss_follows_the_state(spark):
    """States of one's own: loss is that of the state a turn leads to, here only of answers to a question."""
    template = chat.TEMPLATE | {"moves": {("start", "ask"): "asked", ("asked", "bot"): "answered", ("answered", "ask"): "asked"}, "loss_roles": ["bot"], "accept": ["answered"]}
    rows = [(1, n, role, f"{role}{n}") for n, role in enumerate(["ask", "bot", "ask", "bot"])] + [(2, 0, "bot", "refused")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.bad_turn, [s.text for s in r.segments if s.loss]) for r in chat.format_conversations(df, template).collect()}
    assert got == {1: (None, ["bot1", "bot3"]), 2: (0, ["refused"])}
