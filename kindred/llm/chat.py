"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example: all turns before it as context, and only its reply trainable. Turns after the
last reply make one more example without a target, so that no turn is lost. A turn is written as

    <|role|>text<|end|>\\n

Inside roles and texts `<` is written as `<<>` and `|` as `<!>`. No `|` is left, so neither the template's control
strings nor any other that has a `|` can occur in an escaped text, and reading back undoes the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, read_table

#: Fixed values of the template.
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
#: Characters of examples that a worker gathers before it hands them on.
EXAMPLE_CHARS = 4 << 20


def escape(text: str) -> str:
    return text.replace("<", "<<>").replace("|", "<!>")


def unescape(text: str) -> str:
    return text.replace("<!>", "|").replace("<<>", "<")


def render(role: str, text: str) -> tuple[str, str]:
    """The turn's opening and its body with the end mark."""
    return OPEN + escape(role) + CLOSE, escape(text) + END


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, body = part.removeprefix(OPEN).partition(CLOSE)
        turns.append((unescape(role), unescape(body)))
    return turns


def conversations_of(rows: DataFrame) -> DataFrame:
    """`conv_id, turns`: the turns of each conversation in order of turn, role and text. A conversation is the unit
    that an example holds whole, so gathering it is bounded by the longest example."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


EXAMPLE_KINDS = {"conv_id": pa.int64(), "example": pa.int32(), "context": pa.string(), "target": pa.string(), "trainable": pa.bool_()}
READ_KINDS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def batch_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def prefix_examples(rows: DataFrame) -> DataFrame:
    """`conv_id, example, context, target, trainable` for `rows` of `conv_id, turn, role, text`.

    context: the formatted turns before the reply and the reply's opening; target: the reply with its end mark, the
    only part under the loss mask, of which `target_chars` are text. Null roles and texts count as empty, equal turn
    numbers are ordered by role and text, repeated rows are repeated turns, a null conv_id is one conversation, an
    empty table gives an empty result, and other columns are ignored. Ids stay exact, whatever their size.
    """
    bounded_batches(rows.sparkSession)
    grouped = conversations_of(rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, chars = [], 0
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                context, made, pending = "", 0, False
                for t in turns.as_py():
                    opening, body = render(t["role"], t["text"])
                    if pending := t["role"] != "assistant":
                        context += opening + body
                        continue
                    out.append((conv, made, context + opening, body, True))
                    made, context = made + 1, context + opening + body
                    chars += len(context)
                    if chars >= EXAMPLE_CHARS:
                        yield batch_of(out, EXAMPLE_KINDS)
                        out, chars = [], 0
                if pending:
                    out.append((conv, made, context, "", False))
                    chars += len(context)
            yield batch_of(out, EXAMPLE_KINDS)

    return grouped.mapInArrow(run, "conv_id long, example int, context string, target string, trainable boolean")


def read_back(examples: DataFrame) -> DataFrame:
    """`conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`, all from the formatted examples.

    The last example of a conversation holds all turns; the targets, in order, hold all text under the loss mask.
    formatted_chars adds up all examples.
    """
    whole = examples.groupBy("conv_id").agg(
        F.max_by(F.concat("context", "target"), "example").alias("formatted"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", "target")))), lambda x: x["target"]).alias("targets"),
        F.sum(F.length("context") + F.length("target")).cast("long").alias("formatted_chars"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, formatted, targets, chars in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                turns = parse(formatted.as_py())
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(t.removesuffix(END)) for t in targets.as_py())
                out.append((conv, len(turns), digest(said), len(loss), digest(loss), chars))
            yield batch_of(out, READ_KINDS)

    return whole.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


#: The text of both turns of conversation -1, which control strings of other templates fill.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(prefix_examples(rows.union(probe)))


#: A conversation's turns in order, as the operator takes them; the template adds `<||>`, `<|end|>` and a line end to a turn.
OP7_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    12 + length(replace(replace(role, '<', '<<>'), '|', '<!>')) + length(replace(replace(text, '<', '<<>'), '|', '<!>')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), s AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM o
)
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR place = n), 0)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
