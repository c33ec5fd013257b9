r"""Chat formatting: records of many layouts become turns, turns become marked text with a loss mask, and back.

A record's *shape* is the set of its nested field paths (``messages[].role``). The hash of the paths that
any layout knows is the record's fingerprint; it selects one declarative ``Layout``, which says where the
turns lie. Everything is a DataFrame expression: no Python runs on the executors.

A chat of any length is formatted in pieces of up to ``PIECE`` turns, so the rows of one long chat are
spread over tasks; only what is asked of the chat as a whole (its text, a digest) meets in one row, which
Spark bounds at 2 GB.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns of a piece, and the span of turn numbers whose rows make one piece.
PIECE = 64

TURNS = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class One:
    """A turn of a fixed role. Its text joins the fields that are there and not blank by an empty line."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for every element of a list. ``items`` is its path, empty for the record itself; ``roles`` renames roles."""

    items: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()
    #: Field of the text inside ``text``, where that is a list of parts; parts are joined as they are.
    part: str | None = None


@dataclass(frozen=True)
class Layout:
    """Paths that a record has if it is laid out so, paths it may have, and its turns in order."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[One | Each, ...]


# Layouts in common use, with their field and role names.
_SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("chatbot", "assistant"))
LAYOUTS = (
    Layout("message", ("role",), ("text",), (Each("", "role", "text"),)),
    Layout("message_content", ("role", "content"), (), (Each("", "role", "content"),)),
    Layout("messages", ("messages[].role",), ("messages[].content",), (Each("messages", "role", "content"),)),
    Layout("messages_parts", ("messages[].role", "messages[].content[].text"), ("messages[].content[].type",), (Each("messages", "role", "content", part="text"),)),
    Layout("messages_text", ("messages[].role", "messages[].text"), (), (Each("messages", "role", "text"),)),
    Layout("system_messages", ("system", "messages[].role"), ("messages[].content",), (One("system", ("system",)), Each("messages", "role", "content"))),
    Layout("shared", ("conversations[].from",), ("conversations[].value",), (Each("conversations", "from", "value", _SHARED_ROLES),)),
    Layout("system_shared", ("system", "conversations[].from"), ("conversations[].value",), (One("system", ("system",)), Each("conversations", "from", "value", _SHARED_ROLES))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",)))),
    Layout("instruction_response", ("instruction", "response"), ("context", "system"), (One("system", ("system",)), One("user", ("instruction", "context")), One("assistant", ("response",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("completion",)))),
    Layout("question_answer", ("question", "answer"), ("context", "system"), (One("system", ("system",)), One("user", ("context", "question")), One("assistant", ("answer",)))),
)


def _digest(paths: Iterable[str]) -> int:
    """As ``fingerprint`` on the executors."""
    return int(np.uint64(xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), seed=42)).view(np.int64))


def register(layouts: Sequence[Layout]) -> dict[int, int]:
    """Fingerprint -> place of its layout: the required paths with every choice of the optional ones.

    Two layouts with one shape are an error. The list of a layout may also be null or empty; where
    several layouts have that list, all of them say the same: no turns of it.
    """
    found: dict[int, int] = {}
    for place, layout in enumerate(layouts):
        for n in range(len(layout.optional) + 1):
            for extra in combinations(layout.optional, n):
                if found.setdefault(_digest({*layout.required, *extra}), place) != place:
                    raise ValueError(f"{layout.name} has a shape of another layout: {sorted({*layout.required, *extra})}")
    for place, layout in enumerate(layouts):
        for items in (t.items for t in layout.turns if isinstance(t, Each) and t.items):
            others = {p for p in layout.required if not p.startswith(f"{items}[]")}
            for end in ("", "[]"):
                found.setdefault(_digest(others | {f"{items}{end}"}), place)
    return found


def known_paths(layouts: Sequence[Layout]) -> list[str]:
    """Paths that count in a fingerprint; all others (ids, scores, sources) may be there or not."""
    lists = {f"{t.items}{end}" for layout in layouts for t in layout.turns if isinstance(t, Each) and t.items for end in ("", "[]")}
    return sorted({p for layout in layouts for p in (*layout.required, *layout.optional)} | lists)


_TOKENS = r"`(?:[^`]|``)*`:|\w+:|OBJECT<>|OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]+\))?"


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant, ``[]`` for the elements of a list; null for no or a broken record.

    Field names that are no plain words stand in backticks. A field whose value is null is there.
    """
    start = F.struct(F.array().cast("array<string>").alias("above"), F.lit("").alias("here"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, token: Column) -> Column:
        above, here, found = state["above"], state["here"], state["found"]
        outer = F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit(""))
        named = F.concat(outer, F.when(outer == "", "").otherwise("."), F.regexp_replace(token, ":$", ""))
        is_name, is_list, is_open, is_end = token.endswith(":"), token == "ARRAY<", token == "OBJECT<", token == ">"
        opened = F.when(is_list, F.concat(here, F.lit("[]"))).otherwise(here)
        return F.struct(
            F.when(is_open | is_list, F.array_append(above, opened)).when(is_end, F.slice(above, F.lit(1), F.size(above) - 1)).otherwise(above).alias("above"),
            F.when(is_name, named).when(is_list, opened).otherwise(here).alias("here"),
            F.when(is_name | is_open | is_list | is_end, found).otherwise(F.array_append(found, here)).alias("found"),
        )

    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(_TOKENS), F.lit(0))
    return F.aggregate(tokens, start, step, lambda s: F.array_sort(F.array_distinct(s["found"])))


def fingerprint(record: Column, known: Sequence[str]) -> Column:
    """Hash of the known paths of a record."""
    listed = F.array(*[F.lit(p) for p in known])
    return F.xxhash64(F.array_join(F.array_intersect(field_paths(record), listed), "\n"))


def _each(items: Column, t: Each, turn: Callable[[Each, Column], Column]) -> Column:
    return F.transform(items, lambda x: turn(t, x))


def _turns_of(layout: Layout, record: Column) -> Column:
    def field(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(record, f"$.{path}", kind)

    parts = []
    for t in layout.turns:
        if isinstance(t, One):
            texts = F.filter(F.array(*[field(p) for p in t.fields]), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
            turn = F.array(F.struct(F.lit(t.role).alias("role"), F.array_join(texts, "\n\n").alias("text")))
            absent = [p for p in t.fields if p in layout.optional]
            parts.append(F.when(F.size(texts) > 0, turn).otherwise(F.array().cast(TURNS)) if len(absent) == len(t.fields) else turn)
            continue
        kind = "string" if t.part is None else f"array<struct<`{t.part}` string>>"
        if t.items:
            items = F.coalesce(field(t.items, f"array<struct<`{t.role}` string, `{t.text}` {kind}>>"), F.array().cast(f"array<struct<`{t.role}` string, `{t.text}` {kind}>>"))
        else:
            items = F.array(F.struct(field(t.role).alias(t.role), field(t.text, kind).alias(t.text)))

        def turn(t: Each, x: Column) -> Column:
            role, text = x[t.role], x[t.text]
            for old, new in t.roles:
                role = F.when(x[t.role] == old, new).otherwise(role)
            if t.part is not None:
                text = F.array_join(F.transform(text, lambda p: p[t.part]), "")
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

        parts.append(_each(items, t, turn))
    return F.concat(*parts).cast(TURNS)


def canonical_turns(records: DataFrame, record: str | Column, keep: Sequence[str] = (), layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """The columns ``keep``, ``layout`` (its name) and ``turns`` (role, text) of every record.

    ``record`` is a variant, a JSON text or a struct. A broken or null record, and one of a shape that no
    layout has, gets a null layout and no turns; it is never dropped, so such rows can be counted.
    Null roles and texts are empty. An empty list gives no turns. Input columns not in ``keep`` are not
    read, whatever their names. Repeated records stay repeated.
    """
    value = F.col(record) if isinstance(record, str) else record
    kind = records.select(value.alias("r")).schema["r"].dataType.typeName()
    if kind == "string":
        value = F.try_parse_json(value)
    elif kind != "variant":
        value = F.to_variant_object(value)
    places = register(layouts)
    shaped = records.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], value.alias("record"))
    listed = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    placed = shaped.withColumn("place", F.try_element_at(listed, fingerprint(F.col("record"), known_paths(layouts))))
    turns, name = F.array().cast(TURNS), F.lit(None).cast("string")
    for place, layout in enumerate(layouts):
        here = F.col("place") == place
        turns = F.when(here, _turns_of(layout, F.col("record"))).otherwise(turns)
        name = F.when(here, F.lit(layout.name)).otherwise(name)
    return placed.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], name.alias("layout"), turns.alias("turns"))


# Control strings of chat templates in common use.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Template:
    """A turn is ``begin`` role, newline, text, ``end``. ``controls`` never stand in a formatted text but as marks.

    A control string in a text gets a backslash behind its first character, and one that has backslashes
    there already gets one more, so taking one away gives the text back. ``begin`` and ``end`` begin with
    a control string each. No control string may begin inside another one.
    """

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self):
        for c in self.controls:
            for k in range(1, len(c)):
                if any(c[k:].startswith(d) or d.startswith(c[k:]) for d in self.controls):
                    raise ValueError(f"a control string begins inside {c}")
        for mark in (self.begin, self.end):
            if not any(mark.startswith(c) for c in self.controls):
                raise ValueError(f"{mark} does not begin with a control string")

    def pattern(self, slashes: str) -> str:
        """First characters of control strings, by what follows them."""
        tails: dict[str, list[str]] = {}
        for c in self.controls:
            tails.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(f"{re.escape(first)}(?={slashes}(?:{'|'.join(rest)}))" for first, rest in tails.items())

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(f"({self.pattern(r'\\*')})"), F.lit(r"$1\\"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(rf"({self.pattern(r'\\+')})\\"), F.lit("$1"))

    def escape_role(self, role: Column) -> Column:
        r"""As a text; a backslash is written ``\\`` and a newline ``\n`` before."""
        return self.escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))

    def unescape_role(self, role: Column) -> Column:
        parts = F.split(self.unescape(role), r"\\\\", -1)
        return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


CHATML = Template()


def render(turns: Column, template: Template = CHATML, learned: Sequence[str] = ("assistant",)) -> Column:
    """struct(text, mask): the marked text of turns, and where the texts of the roles ``learned`` lie in it.

    mask is an array of struct(start, length) in code points, counted from 0, marks not included.
    """
    marked = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(template.begin), template.escape_role(t["role"]), F.lit("\n")).alias("head"),
            template.escape(t["text"]).alias("body"),
            t["role"].isin(*learned).alias("learned"),
        ),
    )
    spans = F.array().cast("array<struct<start bigint, length bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), spans.alias("spans"))

    def step(s: Column, m: Column) -> Column:
        begin = s["at"] + F.char_length(m["head"])
        size = F.char_length(m["body"]).cast("bigint")
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct((begin + size + len(template.end)).alias("at"), F.when(m["learned"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    text = F.array_join(F.transform(marked, lambda m: F.concat(m["head"], m["body"], F.lit(template.end))), "")
    return F.struct(text.alias("text"), F.aggregate(marked, start, step, lambda s: s["spans"]).alias("mask"))


def _cut(turns: Column) -> Column:
    """Turns in lists of up to ``PIECE``."""
    last = F.greatest(F.lit(0), F.floor((F.size(turns) - 1) / PIECE)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(turns, i * PIECE + 1, F.lit(PIECE)))


def format_pieces(chats: DataFrame, id: str = "conv_id", turn: str = "turn", template: Template = CHATML, learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """Chats in marked pieces: ``id``, piece (its order), text and mask (places in the piece's own text).

    ``chats`` has ``id``, ``turns`` and the order ``turn`` of a chat's rows: rows with equal turn go by role
    and text, a null turn comes first. A chat's pieces in order, one after another, are its formatted
    text. Rows with null ``id`` are one chat. A chat without turns gives no piece.
    """
    chunk = F.floor(F.col(turn) / PIECE).alias("chunk")
    rows = chats.filter(F.size("turns") > 0).select(F.col(id), chunk, F.struct(F.col(turn).alias("turn"), F.col("turns")).alias("row"))
    together = rows.groupBy(id, "chunk").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    parts = together.select(id, "chunk", F.posexplode(_cut(F.flatten(F.col("rows.turns")))).alias("part", "turns"))
    return parts.select(F.col(id), F.struct("chunk", "part").alias("piece"), render(F.col("turns"), template, learned).alias("made")).select(id, "piece", "made.*")


def read_pieces(pieces: DataFrame, id: str = "conv_id", template: Template = CHATML) -> DataFrame:
    """What ``format_pieces`` wrote, read back from its text and mask.

    ``id``, piece, chars (code points of the text), turns and learned (the unescaped texts under the mask).
    """
    marked = F.split(F.col("text"), "\\Q" + template.end + "\\E", -1)
    bodies = F.transform(F.slice(marked, F.lit(1), F.size(marked) - 1), lambda m: F.substring(m, F.lit(len(template.begin) + 1), F.char_length(m)))

    def turn(m: Column) -> Column:
        role = F.substring_index(m, "\n", 1)
        text = F.substring(m, F.char_length(role) + 2, F.char_length(m))
        return F.struct(template.unescape_role(role).alias("role"), template.unescape(text).alias("text"))

    learned = F.transform("mask", lambda s: template.unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return pieces.select(F.col(id), "piece", F.char_length("text").cast("bigint").alias("chars"), F.transform(bodies, turn).alias("turns"), learned.alias("learned"))


def _joined(pieces: Column) -> tuple[Column, Column]:
    """Text and mask of pieces (text, mask) in order."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<struct<start bigint, length bigint>>>").alias("mask"))

    def step(s: Column, p: Column) -> Column:
        moved = F.transform(p["mask"], lambda m: F.struct((m["start"] + s["at"]).alias("start"), m["length"].alias("length")))
        return F.struct((s["at"] + F.char_length(p["text"])).alias("at"), F.array_append(s["mask"], moved).alias("mask"))

    mask = F.aggregate(pieces, zero, step, lambda s: F.flatten(s["mask"]))
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"), mask.alias("mask")


def format_chats(chats: DataFrame, id: str = "conv_id", turn: str | None = "turn", template: Template = CHATML, learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """``id``, text and mask (struct(start, length) in code points) of every chat, one row each.

    Without ``turn`` every row of ``chats`` is a chat of its own, also with an id that others have, and
    nothing is shuffled; one without turns has an empty text. With it see ``format_pieces``.
    A chat's pieces meet in one row here; beyond 2 GB that is an error of Spark, its pieces are not.
    """
    if turn is None:
        pieces = F.transform(_cut(F.col("turns")), lambda t: render(t, template, learned))
        return chats.select(F.col(id), pieces.alias("pieces")).select(id, *_joined(F.col("pieces")))
    pieces = format_pieces(chats, id, turn, template, learned)
    together = pieces.groupBy(id).agg(F.sort_array(F.collect_list(F.struct("piece", "text", "mask"))).alias("pieces"))
    return together.select(F.col(id), *_joined(F.col("pieces")))


def digests(pieces: DataFrame, id: str = "conv_id", template: Template = CHATML) -> DataFrame:
    """Counts and digests of chats, read back from their pieces.

    ``id``, n_turns, turns_sha256 (of role, newline, text, newline a turn), loss_chars and loss_sha256 (of
    all text under the mask) and formatted_chars. Counts are added up from the pieces; a digest is of
    one text and needs it in one row.
    """
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    slim = read_pieces(pieces, id, template).select(id, "piece", "chars", F.size("turns").cast("bigint").alias("n"), spoken.alias("spoken"), F.array_join("learned", "").alias("loss"))
    together = slim.groupBy(id).agg(
        F.sum("n").alias("n_turns"),
        F.sum(F.char_length("loss").cast("bigint")).alias("loss_chars"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("piece", "spoken", "loss"))).alias("pieces"),
    )
    joined = lambda c: F.sha2(F.array_join(F.col(f"pieces.{c}"), ""), 256)
    return together.select(F.col(id), "n_turns", joined("spoken").alias("turns_sha256"), "loss_chars", joined("loss").alias("loss_sha256"), "formatted_chars")
