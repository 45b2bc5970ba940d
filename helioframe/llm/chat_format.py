"""Chat formatting of typed content parts, and reading the formatted text back.

A turn's content is a list of parts: text, image, audio or document. A visitor turns each part into pieces of the
formatted text: text parts are escaped, other parts become a placeholder such as [image:2], numbered by the part's
place in its turn, with a record of what it refers to and of how many tokens it expands to. The template marks turns:

    user        [INST] ... [/INST]
    assistant    ...</s>
    any other   [ROLE:name]...[/ROLE]

A text part that isn't a turn's first part is led by [text:n], so parts never run together. Control strings within
texts get a ~ after their first sign, and those that look escaped already one more, so unescaping gives back the
exact text. Loss spans cover each text part of the assistant, escaped, without marks.

Every turn is formatted where it is read. Turns are then dealt to tasks by ranges of (conversation, turn), so that
a conversation with most of all turns is spread too, and strung together to chunks of a bounded size; a
conversation's chunks in order are its text. A batch and a chunk are all that a task holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from helioframe.llm.shared import in_arrow, written

#: Code points and turns after which a chunk ends; a longer turn is a chunk of its own.
CHUNK_CHARS, CHUNK_TURNS = 1 << 20, 4096
#: Control strings without their first sign, which is < or [.
CONTROLS = r"s>|/s>|INST\]|/INST\]|ROLE:|/ROLE\]|text:|image:|audio:|document:"
#: Pixels of a side of an image patch, tokens of a second of sound, and of a page: what attachments expand to.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256

PARTS = "array<struct<type string, text string, ref string, width int, height int, seconds double, pages int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(~*)({CONTROLS})", "$1~$2$3")


def unescape(text: str) -> str:
    return re.sub(rf"([<\[])~(~*)({CONTROLS})", r"\1\2\3", text)


def ceiling(x: Column) -> Column:
    return F.coalesce(F.ceil(F.greatest(x, F.lit(0))).cast("long"), F.lit(0).cast("long"))


#: How many tokens a placeholder stands for, by type of the part; unknown sizes count as none.
EXPANSIONS: dict[str, Callable[[Column], Column]] = {
    "image": lambda p: ceiling(p["width"] / PATCH) * ceiling(p["height"] / PATCH),
    "audio": lambda p: ceiling(p["seconds"] * PER_SECOND),
    "document": lambda p: ceiling(p["pages"].cast("double")) * PER_PAGE,
}


#: A stretch of formatted text; loss: under the mask; the rest is known of placeholders only.
PIECE = {"text": "string", "loss": "boolean", "type": "string", "part": "int", "ref": "string", "tokens": "long"}


def piece(**known: Column) -> Column:
    return F.struct(*[known.get(c, F.lit(False if c == "loss" else None)).cast(t).alias(c) for c, t in PIECE.items()])


def visit(p: Column, n: Column, loss: Column) -> Column:
    """The pieces of part p, the n-th of its turn. Parts of other types, or none, are read as text."""
    mark = F.concat(F.lit("["), F.coalesce(p["type"], F.lit("text")), F.lit(":"), n.cast("string"), F.lit("]"))
    lead = F.when(n > 0, F.concat(F.lit("[text:"), n.cast("string"), F.lit("]"))).otherwise("")
    found = F.array(piece(text=lead), piece(text=escape(F.coalesce(p["text"], F.lit(""))), loss=loss))
    for kind, tokens in EXPANSIONS.items():
        found = F.when(p["type"] == kind, F.array(piece(text=mark, type=p["type"], part=n, ref=p["ref"], tokens=tokens(p)))).otherwise(found)
    return found


def segments(turns: DataFrame, conv: str, turn: str, role: str, content: Column) -> DataFrame:
    """A row per turn: conv, turn, role, and the pieces of its text in order."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content.cast(PARTS).alias("parts"))
    rows = rows.withColumn("parts", F.filter(F.coalesce("parts", F.array().cast(PARTS)), lambda p: p.isNotNull()))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    head = F.when(user, "[INST] ").when(assistant, " ").otherwise(F.concat(F.lit("[ROLE:"), F.url_encode("role"), F.lit("]")))
    tail = F.when(user, " [/INST]").when(assistant, "</s>").otherwise("[/ROLE]")
    inner = F.flatten(F.transform("parts", lambda p, n: visit(p, n, assistant)))
    return rows.select("conv_id", "turn", "role", F.filter(F.concat(F.array(piece(text=head)), inner, F.array(piece(text=tail))), lambda x: (x["text"] != "") | x["loss"]).alias("pieces"))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """Formatted conversations as chunks: conv_id, chunk (increasing), n_turns, text, loss, attachments, media_tokens.

    loss: spans of code points of the chunk's text (start, end exclusive) under the loss mask, in order, one per text
    part of an assistant's turn, empty ones too. attachments: at (where the placeholder starts), turn, part, type, ref and
    tokens. With parts, that column (see PARTS; sizes may be null) is the content, else text is, as one part.

    Turns go by turn, role and formatted text, nulls first; repeated rows are all formatted. Null texts and roles
    count as empty, null parts are left out, and a turn without parts reads back as one empty text. Roles are exact:
    only "assistant" is under the loss mask. A null conversation is one like any other; other columns are ignored;
    an empty table gives an empty result.
    """
    content = F.col(parts) if parts else F.array(F.struct(F.lit("text").alias("type"), F.col(text).cast("string").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))
    rows = segments(turns, conv, turn, role, content)
    order = ["conv_id", "turn", "role"]
    # bounds of the ranges come from a sample on the driver, so whole texts are no part of them
    dealt = rows.repartitionByRange(*order, F.substring(F.col("pieces")[1]["text"], 1, 64)).sortWithinPartitions(*order, "pieces")
    spans, kinds = "array<struct<start: long, end: long>>", "array<struct<at: long, turn: long, part: int, type: string, ref: string, tokens: long>>"
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(f"chunk long, n_turns long, text string, loss {spans}, attachments {kinds}, media_tokens long").fields])
    return in_arrow(dealt.drop("role"), strung, schema)


def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """String consecutive turns of a conversation together; chunks are numbered by the task and within it."""
    number, at, texts, size, turns, loss, found = TaskContext.get().partitionId() << 32, None, [], 0, 0, [], []
    kinds = pa.struct([("at", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
    ids = None

    def chunk() -> pa.RecordBatch:
        spans = pa.array([[{"start": a, "end": b} for a, b in loss]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        values = [pa.array([at], ids), pa.array([number], pa.int64()), pa.array([turns], pa.int64()), pa.array(["".join(texts)], pa.string()), spans, pa.array([found], pa.list_(kinds)), pa.array([sum(x["tokens"] for x in found)], pa.int64())]
        return pa.RecordBatch.from_arrays(values, ["conv_id", "chunk", "n_turns", "text", "loss", "attachments", "media_tokens"])

    for batch in batches:
        ids = batch.column("conv_id").type
        for conv, turn, pieces in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "pieces")), strict=True):
            if turns and (conv != at or turns >= CHUNK_TURNS or size + sum(len(p["text"]) for p in pieces) > CHUNK_CHARS):
                yield chunk()
                number, texts, size, turns, loss, found = number + 1, [], 0, 0, [], []
            at, turns = conv, turns + 1
            for p in pieces:
                if p["loss"]:
                    loss.append((size, size + len(p["text"])))
                elif p["type"] is not None:
                    found.append({"at": size, "turn": turn, "part": p["part"], "type": p["type"], "ref": p["ref"], "tokens": p["tokens"]})
                texts.append(p["text"])
                size += len(p["text"])
    if turns:
        yield chunk()


TURN = re.compile(r"\[INST\] (.*?) \[/INST\]| (.*?)</s>|\[ROLE:([^\]]*)\](.*?)\[/ROLE\]", re.S)
MARK = re.compile(r"\[(text|image|audio|document):([0-9]+)\]")


def turns_of(text: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """The turns of formatted text: role, and parts as (type, text; empty for attachments). Raises on other text."""
    end = 0
    for m in TURN.finditer(text):
        if m.start() != end:
            raise ValueError("text outside of the template's turns")
        end = m.end()
        role, content = ("user", m[1]) if m[1] is not None else ("assistant", m[2]) if m[2] is not None else (unquote_plus(m[3]), m[4])
        pieces = MARK.split(content)
        marks = list(zip(pieces[1::3], pieces[2::3], pieces[3::3], strict=True))
        parts = [] if marks and marks[0][1] == "0" else [("text", unescape(pieces[0]))]
        yield role, parts + [(kind, unescape(rest) if kind == "text" else "") for kind, _, rest in marks]
    if end != len(text):
        raise ValueError("text outside of the template's turns")


def read_back(chunks: DataFrame) -> DataFrame:
    """What the chunks say again: conv_id, chunk, turns (role, and parts with type and text), learnt and n_chars.

    learnt has the unescaped texts under the loss mask, n_chars the code points of the chunk.
    """
    parts = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))
    turns = pa.list_(pa.struct([("role", pa.string()), ("parts", parts)]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, loss = batch.column("text")[i].as_py(), batch.column("loss")[i].as_py()
                said = [{"role": role, "parts": [{"type": kind, "text": t} for kind, t in found]} for role, found in turns_of(text)]
                values = [pa.array([said], turns), pa.array([[unescape(text[s["start"] : s["end"]]) for s in loss]], pa.list_(pa.string())), pa.array([len(text)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).select(["conv_id", "chunk"]).columns, *values], ["conv_id", "chunk", "turns", "learnt", "n_chars"])

    more = StructType.fromDDL("chunk long, turns array<struct<role: string, parts: array<struct<type: string, text: string>>>>, learnt array<string>, n_chars long").fields
    return in_arrow(chunks.select("conv_id", "chunk", "text", "loss"), task, StructType([chunks.schema["conv_id"], *more]))


def with_probe(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the conversations, and conversation -1, whose two texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def report(turns: DataFrame) -> DataFrame:
    """Format turns, write the chunks, read them back, and tell of each conversation what they say.

    Chunks are parsed where they lie. The two digests of a conversation are sequential by nature: its chunks stream
    through one task in order, which holds one batch of them and the states of the hashes.
    """
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(F.transform(t["parts"], lambda p: p["text"]), ""), F.lit("\n")))
    parsed = read_back(written(format_chat(turns), "chat"))
    dealt = parsed.select("conv_id", "chunk", "n_chars", F.size("turns").cast("long").alias("n"), F.array_join(said, "").alias("said"), F.array_join("learnt", "").alias("learnt"))
    schema = StructType([parsed.schema["conv_id"], *StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    return in_arrow(dealt.repartition("conv_id").sortWithinPartitions("conv_id", "chunk"), digests, schema)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks in order of their conversations: counts and digests of each conversation."""
    begun, ids, n, learnt_chars, chars, hashes = False, None, 0, 0, 0, (hashlib.sha256(), hashlib.sha256())

    def told() -> pa.RecordBatch:
        values = [pa.array([at], ids), pa.array([n], pa.int64()), pa.array([hashes[0].hexdigest()]), pa.array([learnt_chars], pa.int64()), pa.array([hashes[1].hexdigest()]), pa.array([chars], pa.int64())]
        return pa.RecordBatch.from_arrays(values, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    at = None
    for batch in batches:
        ids = batch.column("conv_id").type
        for conv, count, size, said, learnt in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "n_chars", "said", "learnt")), strict=True):
            if begun and conv != at:
                yield told()
                n, learnt_chars, chars, hashes = 0, 0, 0, (hashlib.sha256(), hashlib.sha256())
            begun, at, n, learnt_chars, chars = True, conv, n + count, learnt_chars + len(learnt), chars + size
            hashes[0].update(said.encode())
            hashes[1].update(learnt.encode())
    if begun:
        yield told()
