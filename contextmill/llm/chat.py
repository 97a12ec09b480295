"""Chat formatting: schema fingerprints choose the mapping of each record.

Records of many layouts lie in one table, each filling its own columns and leaving the rest
NULL, as the JSON reader gives them. The hash of a record's nested field paths selects a
declared mapping to canonical turns; turns are written with a template whose control strings
are escaped inside texts. DataFrame functions only; a record is one row throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
#: What a text may not contain as it is, and its escape character.
CONTROL = r"\\|</?turn|###"


@dataclass(frozen=True)
class Layout:
    """Either turns from single fields, in order, or one list of turns.

    ``turns`` has (role, fields); several fields of a turn are joined by blank lines.
    """

    name: str
    turns: Sequence[tuple[str, Sequence[str]]] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    roles: Mapping[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.each:
            return sorted((f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"))
        return sorted(f for _, fields in self.turns for f in fields)


LAYOUTS = (
    Layout("prompt", (("user", ["prompt"]), ("assistant", ["completion"]))),
    Layout("system prompt", (("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"]))),
    Layout("instruction", (("user", ["instruction"]), ("assistant", ["output"]))),
    Layout("instruction with input", (("user", ["instruction", "input"]), ("assistant", ["output"]))),
    Layout("messages", each="messages", role="role", text="content"),
    Layout("speakers", each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
)


def fingerprint_of(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _leaves(kind: T.DataType, path: str, present: Column, value: Column):
    """(path, presence) of the string fields below a column."""
    if isinstance(kind, T.StringType):
        yield path, present & value.isNotNull()
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(f.dataType, f"{path}.{f.name}", present & value.isNotNull(), value.getField(f.name))
    elif isinstance(kind, T.ArrayType):
        filled = present & value.isNotNull()
        inner = kind.elementType
        if isinstance(inner, T.StructType):
            for f in inner.fields:
                if isinstance(f.dataType, T.StringType):
                    yield f"{path}[].{f.name}", filled
        elif isinstance(inner, T.StringType):
            yield f"{path}[]", filled


def fingerprint(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the paths a record fills, of those that any layout uses; others are metadata."""
    known = {p for x in layouts for p in x.paths()}
    found = [
        (path, there)
        for f in df.schema.fields
        for path, there in _leaves(f.dataType, f.name, F.lit(True), F.col(f"`{f.name}`"))
        if path in known
    ]
    names = F.array_compact(F.array(*[F.when(there, F.lit(path)) for path, there in sorted(found, key=lambda x: x[0])]))
    return F.sha2(F.array_join(names, "\n") if found else F.lit(""), 256)


def _turn_of(layout: Layout):
    """A list entry as a canonical turn."""

    def turn(m: Column) -> Column:
        role = F.coalesce(m[layout.role], F.lit(""))
        for said, meant in layout.roles.items():
            role = F.when(m[layout.role] == said, F.lit(meant)).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text"))

    return turn


def canonical_turns(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout`` and ``turns`` (role, text) by each record's fingerprint.

    A record of no declared layout has layout NULL and no turns. NULL list entries, roles and
    texts in a list are empty strings. Columns of ``df`` with these two names are replaced;
    further columns, and fields that are not strings, are not looked at.
    """
    columns = {f.name: f.dataType for f in df.schema.fields}
    none = F.lit(None).cast(TURNS)
    name, turns = F.lit(None).cast("string"), none
    for x in layouts:
        if not {p.split("[")[0].split(".")[0] for p in x.paths()} <= columns.keys():
            continue
        if x.each:
            if not isinstance(columns[x.each], T.ArrayType):
                continue
            made = F.transform(F.col(x.each), _turn_of(x))
        else:
            made = F.array(*[
                F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *map(F.col, fields)).alias("text"))
                for role, fields in x.turns
            ])
        hit = F.col("__print") == fingerprint_of(x.paths())
        name, turns = F.when(hit, F.lit(x.name)).otherwise(name), F.when(hit, made.cast(TURNS)).otherwise(turns)
    kept = [c for c in df.columns if c not in ("layout", "turns")]
    marked = df.withColumn("__print", fingerprint(df, layouts))
    return marked.select(*kept, name.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def escape(text: Column) -> Column:
    """A backslash before each control string and each backslash."""
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<turn>### "), F.url_encode(turn["role"]), F.lit(":\n"))


TAIL = "\n</turn>\n"
#: Header with the role, then the text up to a tail; a tail can't stand inside an escaped text.
PARSED = r"(?s)<turn>### ([^\n]*):\n(.*?)\n</turn>\n"


def format_chat(df: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans``: (start from 1, chars) of trained texts.

    Spans are code points of the formatted string and cover the escaped text alone, neither
    header nor tail. A record without turns gives an empty string and no spans.
    """
    parts = F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), _head(t).alias("head"), escape(t["text"]).alias("text")))
    df = df.withColumn("__parts", parts)
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        chars = F.length(p["text"]).cast("long")
        span = F.struct(begin.alias("start"), chars.alias("chars"))
        taken = p["role"].isin(*trained)
        return F.struct(
            (begin + chars + len(TAIL)).alias("at"),
            F.when(taken, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["text"], F.lit(TAIL))), "")
    return df.select(
        *[c for c in df.columns if c not in ("__parts", "formatted", "loss_spans")],
        text.alias("formatted"),
        F.aggregate("__parts", start, step)["spans"].alias("loss_spans"),
    )


def parse_chat(df: DataFrame) -> DataFrame:
    """``df`` with ``turns`` and ``loss_texts`` read back from ``formatted`` and ``loss_spans``."""
    found = F.arrays_zip(
        F.regexp_extract_all("formatted", F.lit(PARSED), F.lit(1)).alias("role"),
        F.regexp_extract_all("formatted", F.lit(PARSED), F.lit(2)).alias("text"),
    )
    turns = F.transform(found, lambda t: F.struct(
        F.url_decode(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    spans = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"].cast("int"), s["chars"].cast("int"))))
    return df.withColumn("turns", turns).withColumn("loss_texts", spans)
