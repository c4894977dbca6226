"""Chat formatting with a grammar round trip, in column expressions alone.

A turn is written `<turn ROLE>TEXT</turn>`. A text that the parser would not give back as it was, because it holds the
end mark, is written escaped and its turn marked `<turn ROLE!>`: then a backslash becomes `\\b` and `<` becomes `\\l`, so
no mark can occur in it, and the way back is exact. Roles are always escaped, `>` and `!` too. The parser splits at the
end mark and cuts each piece at the first `>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPEN, _CLOSE = "<turn ", "</turn>"
LOSS_ROLE = "assistant"
# the backslash is written first and read last
_TEXT = [("\\", "\\b"), ("<", "\\l")]
_ROLE = [*_TEXT, (">", "\\g"), ("!", "\\x")]


def _escape(text: Column, codes: list[tuple[str, str]]) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescape(text: Column, codes: list[tuple[str, str]]) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _header(role: Column, escaped: Column) -> Column:
    return F.concat(F.lit(_OPEN), _escape(role, _ROLE), F.when(escaped, F.lit("!")).otherwise(F.lit("")), F.lit(">"))


def _body(text: Column, escaped: Column) -> Column:
    return F.when(escaped, _escape(text, _TEXT)).otherwise(text)


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text, raw), raw being the text as written."""

    def turn(piece: Column) -> Column:
        header = F.substring_index(piece, ">", 1)
        raw = F.substr(piece, F.length(header) + 2)
        name = F.substr(header, F.lit(len(_OPEN) + 1))
        escaped = F.endswith(name, F.lit("!"))
        role = F.when(escaped, F.substr(name, F.lit(1), F.length(name) - 1)).otherwise(name)
        return F.struct(_unescape(role, _ROLE).alias("role"), F.when(escaped, _unescape(raw, _TEXT)).otherwise(raw).alias("text"), raw.alias("raw"))

    pieces = F.split(formatted, _CLOSE, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def _comes_back(role: Column, text: Column, escaped: Column) -> Column:
    """Whether a single turn, written and parsed again, is one turn with the same role and text."""
    back = parse(F.concat(_header(role, escaped), _body(text, escaped), F.lit(_CLOSE)))
    return (F.size(back) == 1) & (F.get(back, 0)["role"] == role) & (F.get(back, 0)["text"] == text)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans, identical), one row per conversation.

    Turns are rows (conv_id, turn, role, text), ordered by turn (null first), ties by role and text; repeated rows are
    turns of their own; null roles and texts count as empty; rows with a null conv_id form one conversation. `spans` has
    for every turn where its text stands (start, end in code points, as written) and whether the loss covers it: the
    assistant's turns. Texts that do not come back as they were are escaped; `identical` states that the whole
    conversation, parsed again, equals its source, which then holds for all.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("escaped", ~_comes_back(F.col("role"), F.col("text"), F.lit(False)))
    rows = rows.withColumn("head", _header(F.col("role"), F.col("escaped"))).withColumn("body", _body(F.col("text"), F.col("escaped")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    size = F.length("head") + F.length("body") + len(_CLOSE)
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("stop", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.col("stop") - len(_CLOSE)
    turn = F.struct("place", "role", "text", "head", "body", (end - F.length("body")).alias("start"), end.alias("end"), (F.col("role") == LOSS_ROLE).alias("loss"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(_CLOSE))), ""))
    pair = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    same = F.transform(parse(F.col("formatted")), pair) == F.transform("turns", pair)
    spans = F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["loss"].alias("loss")))
    return whole.select("conv_id", "formatted", spans.alias("spans"), same.alias("identical"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss): the turns parsed from the formatted text, and the unescaped text under the loss mask.

    A span counts only if the parser finds a text of its length as that turn.
    """
    turns = parse(F.col("formatted"))
    both = F.arrays_zip(turns.alias("t"), F.col("spans").alias("s"))
    masked = F.filter(both, lambda x: x["s"]["loss"] & (F.length(x["t"]["raw"]) == x["s"]["end"] - x["s"]["start"]))
    return formatted.select("conv_id", "formatted", "identical", turns.alias("turns"), F.array_join(F.transform(masked, lambda x: x["t"]["text"]), "").alias("loss"))
