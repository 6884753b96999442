"""Operator 5: chat formatting by a finite-state machine and a declarative template. DataFrame operations only.

A ``Template`` says how a turn opens and closes, which roles carry loss, and
which role may follow which. The machine walks over a conversation's roles in
turn order; a conversation is valid if every step is allowed and it ends in an
accepting state. Valid or not, its turns are emitted as text segments, each
with a loss flag, and the formatted text is their concatenation. What is written
is that text and its loss mask: the number of characters of each segment, with
the segment's flag.

Texts cannot forge control strings: every control string starts with the
template's lead character, and no escaped text has one. The escape character
and the lead character are written as the escape character and a digit, which
is undone exactly. Roles are escaped likewise, their closing character too.

Reading back takes the turns from the formatted text alone, split at the control
strings, and the loss text from the places in it that the mask marks.

A conversation is one output text, so its turns meet in one row, which Spark
bounds at 2 GB; conversations do not share anything else.

Defined results: null text and null role are empty; null turns come first, and
rows with equal turns are ordered by role and text; a row with a null conv_id
is a conversation of its own; the query's conversation -1 stays apart from one
of that id in the table; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.shared import fresh, written


@dataclass(frozen=True)
class Template:
    """How conversations are written down, and which are valid."""

    lead: str = "<"  # every control string starts with it
    role_end: str = ">"  # ends the role within the opening string
    escape: str = "~"
    turn_open: tuple[str, str] = ("<|turn ", ">\n")  # around the role
    turn_close: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> state
    steps: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        assert self.turn_open[0].startswith(self.lead) and self.turn_close.startswith(self.lead) and self.turn_open[1].startswith(self.role_end)
        assert len({self.lead, self.role_end, self.escape}) == 3 and not any(c.isdigit() for c in (self.lead, self.role_end, self.escape))


CHAT = Template()
#: A conversation whose texts look like control strings of common templates.
PROBE = "</s>[INST] ok [/INST]"
FAILED = "failed"


def escape(text: Column, t: Template) -> Column:
    out = F.replace(F.replace(text, F.lit(t.escape), F.lit(t.escape + "0")), F.lit(t.lead), F.lit(t.escape + "1"))
    return F.replace(out, F.lit(t.role_end), F.lit(t.escape + "2"))


def unescape(text: Column, t: Template) -> Column:
    out = F.replace(F.replace(text, F.lit(t.escape + "2"), F.lit(t.role_end)), F.lit(t.escape + "1"), F.lit(t.lead))
    return F.replace(out, F.lit(t.escape + "0"), F.lit(t.escape))


def final_state(roles: Column, t: Template) -> Column:
    """The machine's state after the roles; FAILED once a step is not allowed."""
    table = F.create_map(*[F.lit(x) for state, row in t.steps.items() for role, to in row.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\n"), role)), F.lit(FAILED)))


def format_conversations(rows: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", apart: tuple[str, ...] = (), template: Template = CHAT) -> DataFrame:
    """conv_id, valid, segments (array of text and loss), formatted and mask (array of chars and loss) for each conversation.

    Rows that differ in the columns ``apart`` belong to different conversations.
    """
    t = template
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    turns = rows.withColumn(fresh(rows, "alone"), alone).groupBy(F.col(conv_col).alias("conv_id"), fresh(rows, "alone"), *apart).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**63))).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")))).alias("turns"))

    def segments(turn: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        never = F.lit(False)
        return F.array(part(F.concat(F.lit(t.turn_open[0]), escape(turn["role"], t), F.lit(t.turn_open[1])), never), part(escape(turn["text"], t), turn["role"].isin(*t.loss_roles)), part(F.lit(t.turn_close), never))

    out = turns.select("conv_id", final_state(F.col("turns.role"), t).isin(*t.accepting).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    mask = F.transform("segments", lambda s: F.struct(F.char_length(s["text"]).alias("chars"), s["loss"].alias("loss")))
    return out.withColumns({"formatted": F.array_join(F.col("segments.text"), ""), "mask": mask})


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Adds turns (array of role and text) parsed from ``formatted``, and loss_text: the text that ``mask`` marks in it."""
    t = template
    pieces = F.split("formatted", _quoted(t.turn_close))  # no text has the lead character, so these are the turns' ends
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        end = F.locate(t.role_end, piece)  # no role has this character
        return F.struct(
            unescape(F.substring(piece, F.lit(len(t.turn_open[0]) + 1), end - len(t.turn_open[0]) - 1), t).alias("role"),
            unescape(F.substring(piece, end + len(t.turn_open[1]), F.char_length(piece)), t).alias("text"),
        )

    def marked(piece: Column, k: Column) -> Column:
        """What the mask marks in the k-th turn: its second of three segments, the one before it and the turn's closing string aside."""
        before, own = F.get("mask", 3 * k), F.get("mask", 3 * k + 1)
        return F.when(own["loss"], unescape(F.substring(piece, before["chars"] + 1, own["chars"]), t)).otherwise("")

    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(F.transform(pieces, marked), ""))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts look like control strings."""
    probe = rows.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"), F.lit(True).alias("probe"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.lit(False).alias("probe")).unionByName(probe)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = read_back(written(format_conversations(rows, apart=("probe",)).select("conv_id", "valid", "formatted", "mask"), "chat-formatted"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, false AS probe FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL, true UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL, true
), t AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(7 + 2 + 8 + length(role) + length(text) + length(regexp_replace(role || text, '[^<>~]', '', 'g'))) AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
  FROM c GROUP BY conv_id, alone, probe
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid
FROM t
"""
