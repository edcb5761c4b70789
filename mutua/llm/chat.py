"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; runs of turns with one role are merged
by array functions; control strings mark conversations, turns and the joins inside
a merged turn; everything is concatenated. Texts are escaped so that no control
string can occur in them: ``escape`` comes first, then the first character of every
control string. Both steps are undone in reverse order, so any text comes back.

The output keeps the loss mask as ``segments`` of the formatted text (text, loss):
true for the assistant's texts, false for everything else, control strings included.

Defined cases: a null text is empty, a null role is ``user``, a null conv_id is a
conversation of its own; turns that tie are ordered by role, then text, and repeated
rows all stay; null turns come first; an empty table gives an empty table; other
columns are ignored. A conversation is one output row, so its turns meet in one
task: it is the unit that a reader of the format loads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.storage import table

QUERY = "op6_chat"


@dataclass(frozen=True)
class Template:
    """Control strings; each begins with a character of ``guarded``."""

    opening: str = "<s>"
    turn: str = "<|turn|>"
    body: str = "<|body|>"
    joined: str = "<|and|>"
    closing: str = "<|end|>"
    guarded: tuple[tuple[str, str], ...] = (("&", "&a"), ("<", "&l"), ("[", "&b"))
    trained: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        for plain, escaped in self.guarded:
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, escaped in reversed(self.guarded):
            text = F.replace(text, F.lit(escaped), F.lit(plain))
        return text


CHAT = Template()


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: ``conv_id``, ``messages`` (merged turns), ``segments`` (text, loss) and ``formatted``."""
    row = F.struct(
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    opens = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: (i == 1) | (F.get("rows", i - 1)["role"] != F.get("rows", i - 2)["role"]))
    runs = F.transform(
        "opens",
        lambda at, k: F.struct(
            F.get("rows", at - 1)["role"].alias("role"),
            F.transform(F.slice("rows", at, F.coalesce(F.get("opens", k + 1), F.size("rows") + 1) - at), lambda r: r["text"]).alias("texts"),
        ),
    )
    messages = grouped.withColumn("opens", opens).select("conv_id", runs.alias("messages"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_message(m: Column) -> Column:
        trained = m["role"].isin(*template.trained)
        head = segment(F.concat(F.lit(template.turn), template.escape(m["role"]), F.lit(template.body)), F.lit(False))
        texts = F.flatten(
            F.transform(
                m["texts"],
                lambda x, i: F.array(segment(F.when(i == 0, "").otherwise(template.joined), F.lit(False)), segment(template.escape(x), trained)),
            )
        )
        return F.concat(F.array(head), texts, F.array(segment(F.lit(template.closing), F.lit(False))))

    first = F.array(segment(F.lit(template.opening), F.lit(False)))
    segments = F.concat(first, F.flatten(F.transform("messages", of_message)))
    out = messages.withColumn("segments", segments)
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def parse_chats(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted conversation, as an array of (role, text), merged turns taken apart again."""
    blocks = F.filter(F.split(F.substr(formatted, F.lit(len(template.opening) + 1)), _literal(template.turn)), lambda b: b != "")

    def of_block(b: Column) -> Column:
        parts = F.split(b, _literal(template.body))
        role = template.unescape(F.get(parts, F.lit(0)))
        body = F.get(parts, F.lit(1))
        body = F.substr(body, F.lit(1), F.length(body) - len(template.closing))
        return F.transform(F.split(body, _literal(template.joined)), lambda x: F.struct(role.alias("role"), template.unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def loss_spans(segments: Column) -> Column:
    """(start, end) in code points of the parts of the formatted text under the loss mask."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["loss"] & (end > acc["at"]), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, zero, step, lambda acc: acc["spans"])


PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = format_chats(turns.unionByName(probe)).select("conv_id", "segments", "formatted", parse_chats(F.col("formatted")).alias("read"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = CHAT.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_LEN = "length({0}) + length({0}) - length(replace(replace(replace({0}, '&', ''), '<', ''), '[', ''))"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
m AS (SELECT *, row_number() OVER w AS k, coalesce(role <> lag(role) OVER w, true) AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({len(CHAT.opening)} + sum({_LEN.format('text')} + CASE WHEN opens THEN {len(CHAT.turn + CHAT.body + CHAT.closing)} + {_LEN.format('role')} ELSE {len(CHAT.joined)} END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
