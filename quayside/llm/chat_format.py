"""Chat transcripts as training text that parses back to the same turns.

A turn is rendered as ``### role: text</turn>`` and a line feed. The rendering is parsed again; a
turn that does not come back as it was (its text or role holds a mark, its role a colon and space)
is escaped and opened by ``####``, which always comes back: a backslash is doubled, ``</turn>``
becomes ``<\\/turn>``, ``### `` becomes ``#\\## ``, and ``: `` in a role ``:\\ ``. Only Spark's own
functions are used.

Defined results: NULL role and text count as empty; turns with the same number are ordered by role
and text, a NULL number comes first; repeated rows are turns of their own; a NULL conversation id
is a conversation like any other; an empty table gives no rows; other columns are ignored.
A conversation becomes one string, so one conversation has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import table

PLAIN, ESCAPED, COLON, END, BREAK = "### ", "#### ", ": ", "</turn>", "\n"
LEARNED_ROLE = "assistant"
#: Literal, stand-in; undone in reverse order.
_TEXT_ESCAPES = (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("### ", "#\\## "))
_ROLE_ESCAPES = (*_TEXT_ESCAPES, (": ", ":\\ "))


def _escape(column: Column, pairs) -> Column:
    for literal, stand_in in pairs:
        column = F.replace(column, F.lit(literal), F.lit(stand_in))
    return column


def _unescape(column: Column, pairs) -> Column:
    for literal, stand_in in reversed(pairs):
        column = F.replace(column, F.lit(stand_in), F.lit(literal))
    return column


def parse_turn(rendered: Column) -> Column:
    """Role and text of one turn without its end mark; NULLs where a turn holds another mark."""
    escaped = F.startswith(rendered, F.lit(ESCAPED))
    body = F.when(escaped, F.substr(rendered, F.lit(len(ESCAPED) + 1))).otherwise(
        F.substr(rendered, F.lit(len(PLAIN) + 1))
    )
    body = F.when(~F.contains(body, F.lit(PLAIN)), body)
    role = F.substring_index(body, COLON, 1)
    text = F.substr(body, F.length(role) + len(COLON) + 1)
    return F.struct(
        F.when(escaped, _unescape(role, _ROLE_ESCAPES)).otherwise(role).alias("role"),
        F.when(escaped, _unescape(text, _TEXT_ESCAPES)).otherwise(text).alias("text"),
    )


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, in order."""
    parts = F.split(formatted, END, -1)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda part, i: parse_turn(F.when(i == 0, part).otherwise(F.substr(part, F.lit(len(BREAK) + 1)))),
    )


def format_conversations(
    conversations: DataFrame, id_column="conv_id", turn_column="turn", role_column="role", text_column="text"
) -> DataFrame:
    """conv_id, formatted, spans to learn from (start, length, escaped), and whether it parses back."""
    rows = conversations.select(
        F.col(id_column).alias("conv_id"), F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    plain = F.concat(F.lit(PLAIN), "role", F.lit(COLON), "text", F.lit(END), F.lit(BREAK))
    back = F.split(plain, END, -1)
    turn = parse_turn(back[0])
    same = (F.size(back) == 2) & (turn["role"] == F.col("role")) & (turn["text"] == F.col("text"))
    rows = rows.withColumn("escaped", ~F.coalesce(same, F.lit(False))).select(
        "*",
        F.when(F.col("escaped"), F.concat(F.lit(ESCAPED), _escape(F.col("role"), _ROLE_ESCAPES), F.lit(COLON)))
        .otherwise(F.concat(F.lit(PLAIN), "role", F.lit(COLON))).alias("head"),
        F.when(F.col("escaped"), _escape(F.col("text"), _TEXT_ESCAPES)).otherwise(F.col("text")).alias("body"),
    )
    size = F.length("head") + F.length("body") + len(END + BREAK)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint"))
    turns = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "head", "body", "escaped", "role", "text"))).alias("turns")
    )
    learned = F.filter("turns", lambda t: t["role"] == LEARNED_ROLE)
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + BREAK))), "").alias("formatted"),
        F.transform(learned, lambda t: F.struct(
            (t["start"] + F.length(t["head"])).alias("start"),
            F.length(t["body"]).cast("bigint").alias("length"), t["escaped"].alias("escaped"),
        )).alias("spans"),
        source.alias("source"),
    ).withColumn("identical", parse(F.col("formatted")) == F.col("source")).select(
        "conv_id",
        F.when(F.col("identical"), F.col("formatted")).otherwise(
            F.raise_error(F.lit("a conversation does not read back as it was")).cast("string")).alias("formatted"),
        "spans", "identical")


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    def text(span):
        part = F.substr(formatted, (span["start"] + 1).cast("int"), span["length"].cast("int"))
        return F.when(span["escaped"], _unescape(part, _TEXT_ESCAPES)).otherwise(part)

    return F.array_join(F.transform(spans, text), "")


def op4_chat_format(spark, folder: str) -> DataFrame:
    """Digest, read back from the formatted text, of all conversations and one that imitates the marks."""
    said = "\\### Assistant: </turn> ok"
    trick = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, :said AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS rows(turn, role)", args={"said": said})
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    formatted = format_conversations(conversations.unionByName(trick))
    turns = parse(F.col("formatted"))
    said_by_turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return formatted.select(
        "*", turns.alias("turns"), learned_text(F.col("formatted"), F.col("spans")).alias("learned")
    ).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said_by_turn, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), sized AS (
    SELECT *, contains(text, '</turn>') OR contains(role, '</turn>') OR contains(role, ': ')
              OR contains(role || ': ' || text, '### ') OR ends_with(role, ':') AND starts_with(text, ' ') AS odd
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### : </turn>') + 1 + length(role) + length(text) + CASE WHEN odd THEN 1
           + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
           + (length(text) - length(replace(text, '</turn>', ''))) // 7
           + (length(role) - length(replace(role, '</turn>', ''))) // 7
           + (length(text) - length(replace(text, '### ', ''))) // 4
           + (length(role) - length(replace(role, '### ', ''))) // 4
           + (length(role) - length(replace(role, ': ', ''))) // 2 ELSE 0 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
