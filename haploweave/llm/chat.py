"""Chat formatting: a state machine over roles and a declarative template.

The template names, for each role, the marks around its text and whether the
text bears loss. Control strings inside texts are escaped by one backslash after
their first character (one more, if backslashes stand there already), which the
reader takes away again. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haploweave.llm._io import table


@dataclass(frozen=True)
class Template:
    """``roles``: role to (mark before, mark after, loss on the text). Other roles use ``other``, which also holds the role's name."""

    begin: str = "<s>"
    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n", False), "user": ("[INST] ", " [/INST]", False), "assistant": (" ", " </s>", True)}
    )
    other: tuple[str, str, str] = ("[ROLE] ", "[/ROLE] ", " [/END]")
    #: A control string: its first character, backslashes, the rest.
    control: str = r"([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|/END\])"
    #: One formatted turn. A text holds no control string, so the first closing mark is its own.
    turn: str = r"(?s)<<SYS>>\n.*?\n<</SYS>>\n|\[INST\] .*? \[/INST\]|\[ROLE\] .*?\[/ROLE\] .*? \[/END\]| .*? </s>"
    #: Which roles may follow a role; None: the start.
    order: dict[str | None, tuple[str, ...]] = field(default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.control, r"$1$2\\$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.control.replace(r"(\\*)", r"(\\*)\\"), "$1$2$3")

    def by_role(self, role: Column, values, otherwise) -> Column:
        out = None
        for name, marks in self.roles.items():
            out = (F if out is None else out).when(role == name, values(marks))
        return out.otherwise(otherwise)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """One row for each conv_id of ``turns(conv_id, turn, role, text)``.

    ``segments``: array of (text, loss); ``formatted``: their texts joined;
    ``valid``: the state machine accepts every step; ``first_bad``: index of the
    first step it doesn't accept, or null. Turns come by turn, then role, then
    text; a null turn comes first, null roles and texts count as empty, repeated
    rows stay. Invalid conversations are formatted too and marked. Null conv_ids
    form one conversation. Other columns are not read. A conversation is one
    text, so it is built in one task, whatever its length.
    """
    turns = turns.select(F.col("conv_id").cast("long"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segment(text, loss=F.lit(False)):  # noqa: B008
        return F.struct(text.alias("text"), loss.alias("loss"))

    def emit(t):
        name_before, name_after, after = template.other
        other = F.concat(F.lit(name_before), template.escape(t["role"]), F.lit(name_after))
        return F.array(
            segment(template.by_role(t["role"], lambda m: F.lit(m[0]), other)),
            segment(template.escape(t["text"]), template.by_role(t["role"], lambda m: F.lit(m[2]), F.lit(False))),
            segment(template.by_role(t["role"], lambda m: F.lit(m[1]), F.lit(after))),
        )

    def step(state, t):
        ok = F.lit(False)
        for before, after in template.order.items():
            ok = ok | (state["role"].eqNullSafe(F.lit(before)) & t["role"].isin(*after))
        bad = F.when(state["bad"].isNull() & ~F.coalesce(ok, F.lit(False)), state["i"]).otherwise(state["bad"])
        return F.struct(t["role"].alias("role"), (state["i"] + 1).alias("i"), bad.alias("bad"))

    start = F.struct(F.lit(None).cast("string").alias("role"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))
    chats = chats.select("conv_id", F.concat(F.array(segment(F.lit(template.begin))), F.flatten(F.transform("turns", emit))).alias("segments"), F.aggregate("turns", start, step)["bad"].alias("first_bad"))
    return chats.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("first_bad").isNull().alias("valid"), "first_bad")


def read_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """The turns again from ``formatted``, as ``turns``: array of (role, text); and ``loss_text`` from the segments under the loss mask."""

    def role_of(block):
        name = template.unescape(F.regexp_extract(block, r"(?s)^\[ROLE\] (.*?)\[/ROLE\] ", 1))
        out = None
        for role, marks in template.roles.items():
            out = (F if out is None else out).when(block.startswith(marks[0]), F.lit(role))
        return out.otherwise(name)

    def text_of(block):
        before = F.length(F.regexp_extract(block, r"(?s)^\[ROLE\] .*?\[/ROLE\] ", 0))
        out = None
        for _, (opened, closed, _) in template.roles.items():
            out = (F if out is None else out).when(block.startswith(opened), F.substring(block, F.lit(len(opened) + 1), F.length(block) - len(opened) - len(closed)))
        return template.unescape(out.otherwise(F.substring(block, before + 1, F.length(block) - before - len(template.other[2]))))

    body = F.substring("formatted", F.lit(len(template.begin) + 1), F.length("formatted"))
    blocks = F.regexp_extract_all(body, F.lit(template.turn), F.lit(0))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    return chats.withColumn("turns", F.transform(blocks, lambda b: F.struct(role_of(b).alias("role"), text_of(b).alias("text")))).withColumn("loss_text", loss)


#: A conversation whose texts look like the template's marks.
PLANTED = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op5_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PLANTED))
    back = read_chats(format_chats(turns))
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|/END\])', '\1\2\\\3', 'g')) AS chars,
    length(regexp_replace(role, '([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|/END\])', '\1\2\\\3', 'g')) AS role_chars,
    row_number() OVER w AS i, lag(role) OVER w AS before
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(3 + sum(chars + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 22 + role_chars END) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN i = 1 THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END) AS valid
FROM e GROUP BY conv_id
"""
