"""Chat formatting: schema fingerprints choose how records become turns.

A data set's nested field paths are hashed; the hash selects a declarative
mapping that turns its layout (messages, prompt and completion, instruction and
output, one row per turn) into the same array of ``role, text`` turns. A template
marks the turns and escapes control strings, so formatted text can be read back.
Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Strings that steer the template; texts never hold them unescaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|>")
BEGIN, END, OPEN, CLOSE, SPLIT = CONTROL

TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of all leaves: ``messages[].role`` is a field of an array of structs."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: Column, text: Column) -> Column:
    return F.struct(
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )


def _fixed(**parts: str) -> Callable[[DataFrame, str], DataFrame]:
    """One column per role, in the order given."""

    def turns(df: DataFrame, key: str) -> DataFrame:
        made = F.array(*[_turn(F.lit(role), F.col(name)) for role, name in parts.items()])
        return df.select(F.col(key).alias("conv_id"), made.alias("turns"))

    return turns


def _list(column: str, role: str, text: str, names: dict[str, str]) -> Callable[[DataFrame, str], DataFrame]:
    """An array of structs; ``names`` renames roles."""

    def turns(df: DataFrame, key: str) -> DataFrame:
        def one(item: Column) -> Column:
            said = item[role]
            for old, new in names.items():
                said = F.when(item[role] == old, F.lit(new)).otherwise(said)
            return _turn(said, item[text])

        made = F.transform(F.coalesce(F.col(column), F.array()), one)
        return df.select(F.col(key).alias("conv_id"), made.alias("turns"))

    return turns


def _asked(df: DataFrame, key: str) -> DataFrame:
    """Instruction with an optional input below it, and output."""
    given = F.coalesce(F.col("input"), F.lit(""))
    asked = F.concat(
        F.coalesce(F.col("instruction"), F.lit("")),
        F.when(given == "", F.lit("")).otherwise(F.concat(F.lit("\n"), given)),
    )
    return df.select(
        F.col(key).alias("conv_id"),
        F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), F.col("output"))).alias("turns"),
    )


def _rows(df: DataFrame, key: str) -> DataFrame:
    """One row per turn, null turns first; rows that tie in ``turn`` go by role, then text."""
    thin = df.select(F.col(key).alias("conv_id"), F.struct("turn", _turn(F.col("role"), F.col("text")).alias("t")).alias("r"))
    return thin.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]).alias("turns")
    )


@dataclass(frozen=True)
class Mapping:
    name: str
    paths: frozenset[str]
    turns: Callable[[DataFrame, str], DataFrame]


MAPPINGS = (
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), _list("messages", "role", "content", {})),
    Mapping(
        "exchanges",
        frozenset({"conversations[].from", "conversations[].value"}),
        _list("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    ),
    Mapping("rows", frozenset({"turn", "role", "text"}), _rows),
    Mapping("instruction with input", frozenset({"instruction", "input", "output"}), _asked),
    Mapping("instruction", frozenset({"instruction", "output"}), _fixed(user="instruction", assistant="output")),
    Mapping(
        "system and prompt",
        frozenset({"system", "prompt", "completion"}),
        _fixed(system="system", user="prompt", assistant="completion"),
    ),
    Mapping("prompt", frozenset({"prompt", "completion"}), _fixed(user="prompt", assistant="completion")),
    Mapping("prompt and response", frozenset({"prompt", "response"}), _fixed(user="prompt", assistant="response")),
)
BY_FINGERPRINT = {fingerprint(set(m.paths)): m for m in MAPPINGS}


def mapping_for(schema: T.StructType, key: str = "conv_id") -> Mapping:
    """The mapping whose fingerprint the schema has, besides its key.

    A schema with further columns takes the mapping with the most paths among
    those it covers; one that covers none is an error.
    """
    paths = field_paths(schema) - {key}
    exact = BY_FINGERPRINT.get(fingerprint(paths))
    if exact:
        return exact
    covered = [m for m in MAPPINGS if m.paths <= paths]
    if not covered:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    return max(covered, key=lambda m: len(m.paths))


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """``conv_id, turns``: the records of a data set as role and text turns.

    Null roles and texts are empty strings; a null list has no turns; a null key
    is a conversation of its own. Repeated turn rows are repeated turns; records
    of the other layouts stay one each. Other columns are ignored.
    """
    return mapping_for(df.schema, key).turns(df, key)


def escaped(text: Column) -> Column:
    """Text without control strings: a backslash breaks them, and is doubled itself."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _parts(turn: Column) -> Column:
    """What stands before, in and after a turn's text, and whether it is trained on."""
    spoken = turn["role"] == "assistant"
    role = escaped(turn["role"])
    before = F.concat(F.when(spoken, F.lit(BEGIN)).otherwise(F.lit(BEGIN + OPEN)), role, F.lit(SPLIT))
    after = F.when(spoken, F.lit(END)).otherwise(F.lit(CLOSE + END))
    return F.struct(
        before.alias("before"), escaped(turn["text"]).alias("text"), after.alias("after"), spoken.alias("loss")
    )


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss``: one string per conversation and its loss mask.

    The mask is an array of ``start, length`` in code points, one span for each
    assistant text in order. A conversation is one value, as a document is: it
    must fit a row. A conversation without turns is an empty string.
    """
    parts = conversations.select("conv_id", F.transform("turns", _parts).alias("parts"))
    whole = F.concat(F.lit(""), F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["text"], p["after"])), ""))
    empty = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")
    )

    def step(seen: Column, p: Column) -> Column:
        begin = seen["at"] + F.char_length(p["before"])
        size = F.char_length(p["text"])
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct(
            (begin + size + F.char_length(p["after"])).alias("at"),
            F.when(p["loss"], F.concat(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"),
        )

    loss = F.aggregate("parts", empty, step, lambda seen: seen["spans"])
    return parts.select("conv_id", whole.alias("formatted"), loss.alias("loss"))


def read_back(text: Column) -> Column:
    """Turns of a formatted string, their texts unescaped."""

    def one(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(BEGIN) + 1))
        asked = F.startswith(body, F.lit(OPEN))
        body = F.when(
            asked,
            F.substr(body, F.lit(len(OPEN) + 1), F.char_length(body) - len(OPEN) - len(CLOSE)),
        ).otherwise(body)
        halves = F.split(body, r"<\|>", 2)
        return _turn(unescaped(halves[0]), unescaped(halves[1]))

    pieces = F.filter(F.split(text, END), lambda p: p != "")
    return F.transform(pieces, one)


def under_mask(text: Column, loss: Column) -> Column:
    """Unescaped text of all spans, with nothing between."""
    spans = F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["length"])))
    return F.concat(F.lit(""), F.array_join(spans, ""))


def digests(chats: DataFrame) -> DataFrame:
    """What a formatted set holds, read back from it."""
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = under_mask(F.col("formatted"), F.col("loss"))
    return (
        chats.withColumn("turns", turns)
        .withColumn("trained", trained)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.concat(F.lit(""), said), 256).alias("turns_sha256"),
            F.char_length("trained").cast("long").alias("loss_chars"),
            F.sha2("trained", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )
