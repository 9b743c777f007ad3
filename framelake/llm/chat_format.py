"""Chat formatting with typed content parts.

A turn becomes ``<s>[ROLE]role[/ROLE]text</s>`` and a line feed. Control strings inside roles and texts get a backslash
after their first character (one more if they have some), so no formatted text holds a control string that the template
didn't write, and taking one backslash away restores the text. Content parts are flattened in order: text is escaped,
an image, audio or document part becomes a placeholder such as ``[IMAGE:0]``, numbered within the turn; its reference
and the tokens it stands for are recorded.

The output is a row per turn with its place in the conversation's string, so a conversation of any length needs no more
memory than a turn. Turns are ordered by turn (null first), then role, then text; null roles and texts are empty;
repeated rows are turns of their own; an empty table gives an empty result; extra columns are ignored. Ids may be of any
type; turns whose id is null are one conversation, and so are those whose id is NaN. read_back() needs no order or place of its rows, so they may have been stored in between.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, strings, trimmed

#: What follows the first character of each control string.
_TAILS = r"(s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\]|(?:IMAGE|AUDIO|DOCUMENT):)"
_ESCAPE, _UNESCAPE = r"([<\[])(\\*)" + _TAILS, r"([<\[])(\\*)\\" + _TAILS
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"
#: Tokens a unit of each kind stands for: an image tile, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 85, "audio": 25, "document": 500}
#: Characters before a text: <s>[ROLE] and [/ROLE], without the role.
_HEAD = len("<s>[ROLE][/ROLE]")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescape(text: str) -> str:
    return re.sub(_UNESCAPE, r"\1\2\3", text)


def flatten(parts: Column) -> Column:
    """struct(text, attachments, expanded_tokens) of typed parts: the visitor, one case for each type.

    Null parts and parts of an unknown type give nothing; null units count as one.
    """
    media = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p["type"].isin(*UNIT_TOKENS))
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)).cast("long") * F.coalesce(*[F.when(p["type"] == k, n) for k, n in UNIT_TOKENS.items()])
    attachments = F.transform(media, lambda p, i: F.struct(i.cast("int").alias("ordinal"), p["type"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    visit = lambda s, p: F.when(p["type"] == "text", F.struct(F.concat(s["text"], escape(F.coalesce(p["text"], F.lit("")))).alias("text"), s["n"].alias("n"))).when(p["type"].isin(*UNIT_TOKENS), F.struct(F.concat(s["text"], F.lit("["), F.upper(p["type"]), F.lit(":"), s["n"].cast("string"), F.lit("]")).alias("text"), (s["n"] + 1).alias("n"))).otherwise(s)
    text = F.aggregate(F.coalesce(parts, F.array().cast(PARTS)), start, visit)["text"]
    return F.struct(text.alias("text"), attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def text_part(text: str = "text") -> Column:
    """A text column as a list of one typed part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.col(text).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def format_turns(turns: DataFrame, content: Column, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, formatted, attachments, expanded_tokens, loss_start, loss_chars), a row per turn.

    loss_start: code points from the turn's start to its trained text, null for other roles.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), flatten(content).alias("flat"))
    said = escape(F.col("role"))
    formatted = F.concat(F.lit("<s>[ROLE]"), said, F.lit("[/ROLE]"), F.col("flat.text"), F.lit("</s>\n"))
    trained = F.col("role").isin(*loss_roles)
    return rows.select("conv_id", "turn", "role", formatted.alias("formatted"), "flat.attachments", "flat.expanded_tokens", F.when(trained, F.length(said) + _HEAD).alias("loss_start"), F.when(trained, F.length("flat.text")).alias("loss_chars"))


def format_conversations(turns: DataFrame, content: Column | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """format_turns with turn_no (from 0) and offset, the turn's place in the conversation's string in code points."""
    rows = format_turns(turns, text_part() if content is None else content, loss_roles)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "formatted")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("turn_no", F.row_number().over(order) - 1).withColumn("offset", F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)).cast("long"))


def conversation_strings(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): whole strings, for conversations that fit a row."""
    span = F.when(F.col("loss_start").isNotNull(), F.struct((F.col("offset") + F.col("loss_start")).alias("start"), F.col("loss_chars").cast("long").alias("chars")))
    both = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "formatted"))).alias("t"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return both.select("conv_id", F.array_join(F.col("t.formatted"), "").alias("formatted"), "loss_spans")


_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*)</s>\n", re.S)
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the formatted turns alone and hashed as they stream by in order."""
    # the window deals by conv_id and sorts, unless its input is dealt so already
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn_no"))
    ordered = formatted.select("conv_id", "formatted", "loss_start", "loss_chars", at.alias("at"))
    id_type = ordered.schema["conv_id"].dataType.simpleString()

    bounded_batches(formatted)

    @trimmed
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out, kind = object(), None, [], None

        def close() -> None:
            if state:
                out.append((last, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 6
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            turns = zip(strings(batch.column("formatted"), 64), *(batch.column(c).to_pylist() for c in ("conv_id", "loss_start", "loss_chars")))
            for text, conv, start, chars in turns:
                if not (conv == last or (conv != conv and last != last)):
                    close()
                    last, state = conv, {"n": 0, "chars": 0, "loss_chars": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                role, body = (unescape(x) for x in _TURN.fullmatch(text).groups())
                state["turns"].update(f"{role}\n{body}\n".encode())
                if start is not None:
                    trained = unescape(text[start : start + chars])
                    state["loss"].update(trained.encode())
                    state["loss_chars"] += len(trained)
                state["n"] += 1
                state["chars"] += len(text)
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        close()
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(digest, f"conv_id {id_type}, {DIGESTS}")
