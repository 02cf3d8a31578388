"""Chat formatting: a role machine that emits segments with loss flags, by a declarative template.

Everything is DataFrame functions over one row per conversation. Turns are
gathered by conversation, since a formatted conversation is one value.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: A turn is ``open + role + role_end + text + close``. ``controls`` never occur in
#: formatted roles or texts. ``moves`` is the role machine: state and role to state.
TEMPLATE = {
    "open": "<|im_start|>",
    "role_end": "\n",
    "close": "<|im_end|>\n",
    "loss_roles": ["assistant"],
    "controls": ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"],
    "start": "start",
    "moves": {
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    "accept": ["assistant"],
}

_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def _control_pattern(template: dict, least: str) -> str:
    """First character, backslashes, rest: each control string, with the backslashes put in."""
    firsts = sorted({c[0] for c in template["controls"]})
    rests = sorted({c[1:] for c in template["controls"]}, key=lambda r: (-len(r), r))
    java = lambda s: re.sub(r"([^\w<>/ ])", r"\\\1", s)
    return f"([{''.join(java(f) for f in firsts)}]){least}({'|'.join(java(r) for r in rests)})"


def escape_text(text: Column, template: dict = TEMPLATE) -> Column:
    """Put one more backslash behind the first character of each control string."""
    return F.regexp_replace(text, _control_pattern(template, r"(\\*)"), r"$1\\$2$3")


def unescape_text(text: Column, template: dict = TEMPLATE) -> Column:
    return F.regexp_replace(text, _control_pattern(template, r"\\(\\*)"), "$1$2$3")


def escape_role(role: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), _ROLE_CODES, role)


def unescape_role(role: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(_ROLE_CODES), role)


#: So many turns are walked with their segments at a time, so that a long conversation takes time that follows its length.
BLOCK_TURNS = 128


def _moved(template: dict):
    """(state, role) to the next state, null where the machine refuses; from a refusal nothing leads on."""
    moves = F.create_map(*(F.lit(x) for (a, b), to in template["moves"].items() for x in (f"{a} {b}", to)))
    return lambda state, role: F.element_at(moves, F.concat(state, F.lit(" "), role))


def _emitted(turn: Column, to: Column, template: dict) -> Column:
    """What the machine emits on its way to a state: the turn's marks without loss, and its text with the loss of that state.

    A turn that it refuses leads to no state; its role says whether there is loss.
    """
    lossy = {to for (_, role), to in template["moves"].items() if role in template["loss_roles"]}
    loss = F.coalesce(to.isin(sorted(lossy)) & to.isNotNull(), F.lit(False)) | (to.isNull() & turn["role"].isin(template["loss_roles"]))
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    return F.array(
        segment(F.concat(F.lit(template["open"]), escape_role(turn["role"]), F.lit(template["role_end"])), F.lit(False)),
        segment(escape_text(turn["text"], template), loss),
        segment(F.lit(template["close"]), F.lit(False)),
    )


def _blocks(turns: Column) -> Column:
    last = F.floor((F.size(turns) - 1) / BLOCK_TURNS).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(turns, k * BLOCK_TURNS + 1, F.lit(BLOCK_TURNS)))


def block_states(turns: Column, template: dict = TEMPLATE) -> Column:
    """Where the role machine is before each block of turns and behind the last: (state, at, bad), ``bad`` being the
    place from 0 of the first turn that it refused. Roles alone are walked."""
    move = _moved(template)
    at = lambda state, n, bad: F.struct(state.alias("state"), n.alias("at"), bad.alias("bad"))

    def walk(here: Column, turn: Column) -> Column:
        to = move(here["state"], turn["role"])
        bad = F.when(here["bad"].isNull() & to.isNull(), here["at"]).otherwise(here["bad"])
        return at(F.coalesce(to, F.lit("")), here["at"] + 1, bad)

    begin = F.array(at(F.lit(template["start"]), F.lit(0), F.lit(None).cast("int")))
    return F.aggregate(_blocks(turns), begin, lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.element_at(acc, -1), walk))))


def bad_turn(states: Column, template: dict = TEMPLATE) -> Column:
    """The place of the turn that the machine refuses, the number of turns if the end isn't accepted, null if the order is valid."""
    last = F.element_at(states, -1)
    return F.coalesce(last["bad"], F.when(~last["state"].isin(template["accept"]), last["at"]))


def emitted(turns: Column, states: Column, template: dict = TEMPLATE) -> Column:
    """The segments that the machine emits, block by block from the state that each begins in."""
    move = _moved(template)

    def emit(block: Column, start: Column) -> Column:
        first = F.struct(start["state"].alias("state"), F.array().cast("array<struct<text:string,loss:boolean>>").alias("out"))

        def step(here: Column, turn: Column) -> Column:
            to = move(here["state"], turn["role"])
            return F.struct(F.coalesce(to, F.lit("")).alias("state"), F.concat(here["out"], _emitted(turn, to, template)).alias("out"))

        return F.aggregate(block, first, step, lambda here: here["out"])

    blocks = _blocks(turns)
    return F.flatten(F.zip_with(blocks, F.slice(states, F.lit(1), F.size(blocks)), emit))


def format_conversations(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row for each conv_id: n_turns, bad_turn, segments, formatted.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns are
    ordered by turn, then role, then text, so ties have one order; repeated rows
    are turns of their own. A null role or text counts as empty, a null turn
    comes first, and a null conv_id is a conversation like others. ``segments``
    is an array of (text, loss); ``formatted`` is their texts joined. An order
    that the role machine refuses is formatted all the same and marked in
    ``bad_turn``. No turns give no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    grouped = (
        turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    ran = grouped.withColumn("states", block_states(F.col("turns"), template))
    made = ran.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), bad_turn(F.col("states"), template).alias("bad_turn"),
        emitted(F.col("turns"), F.col("states"), template).alias("segments"),
    )
    return made.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The (role, text) turns that a formatted conversation holds."""
    java = re.sub(r"([^\w\n ])", r"\\\1", template["close"])
    pieces = F.filter(F.split(formatted, java), lambda p: p != "")
    head = len(template["open"])

    def turn(piece: Column) -> Column:
        at = F.instr(piece, template["role_end"])
        role = F.substring(piece, F.lit(head + 1), at - F.lit(head + 1))
        text = F.substring(piece, at + F.lit(len(template["role_end"])), F.char_length(piece))
        return F.struct(unescape_role(role).alias("role"), unescape_text(text, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: dict = TEMPLATE) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape_text(s["text"], template)), "")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted output, of every conversation and of conversation -1."""
    probe = spark.sql(
        "SELECT CAST(-1 AS BIGINT) conv_id, CAST(t AS BIGINT) turn, r role, '</s>[INST] ok [/INST]' text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    made = format_conversations(turns)
    back = made.select(
        "conv_id", "bad_turn", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("bad_turn").isNull().alias("valid_order"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')) AS held,
    length(replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B')) AS role_held
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(held + role_held + 24) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
    AND last(role ORDER BY turn NULLS FIRST, role, text) = 'assistant' AS valid_order
FROM o GROUP BY conv_id
"""
