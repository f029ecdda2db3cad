"""Chat formatting chosen by schema fingerprints (operator 6).

Every record's whole set of nested field paths is hashed. ``mappings`` lists the different
fingerprints of a table, how many records have each, and the mapping chosen for it
from declared layouts, once a fingerprint; the table is data, and may be looked at and changed.
A record is turned into canonical turns by the mapping that its fingerprint finds there,
and by nothing else.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stage

TURN = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))

#: Declarative layouts, in the order in which they are tried: ``list`` is a repeated field with role and text, ``one`` a single
#: turn (its text may lack), ``fields`` are (role, fields joined by a blank line), of which those in ``may`` may lack. A system turn without text is left out.
LAYOUTS: dict[str, dict] = {
    "messages": {"list": ("messages", "role", "content")},
    "conversations": {"list": ("conversations", "from", "value")},
    "system_instruction": {"may": ("system",), "fields": (("system", ("system",)), ("user", ("question",)), ("assistant", ("output",)))},
    "instruction": {"may": ("input", "system"), "fields": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
    "prompt": {"may": ("system",), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))},
    "prompt_response": {"may": ("system",), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    "turn": {"one": ("role", "text")},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: What a part of a content may hold besides its text; parts of other kinds (images, calls) have no text to tell.
_PART_FIELDS = {"type", "text"}


# -- shapes ---------------------------------------------------------------------------------


def record_paths(value, at: str = "") -> set[str]:
    """The nested field paths of a record: names joined by dots, ``[]`` for the elements of a list, ``?`` after a null.

    Lists are told by what any of their elements holds; an empty list or object is a path of its own.
    Dots, brackets, marks and backslashes of names are escaped.
    """
    if isinstance(value, dict):
        if not value:
            return {at + "{}"}
        dot = at + "." if at else ""
        return set().union(*(record_paths(v, dot + re.sub(r"([.\\[\]{}?\n])", r"\\\1", k)) for k, v in value.items()))
    if isinstance(value, list):
        own = set().union(*(record_paths(v, at + "[]") for v in value if v is not None)) if value else set()
        return own or {at + "[]"}
    return {at + "?"} if value is None else {at}


def fingerprint(paths) -> int:
    """A signed 64-bit hash of a set of paths."""
    n = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode())
    return n - (1 << 64) if n >> 63 else n


def _objects(column: pa.Array) -> list:
    """Records as objects; of JSON, numbers are kept as they are written. What is no object is None."""
    if not pa.types.is_struct(column.type):
        return [_parsed(x) for x in column.to_pylist()]
    return column.to_pylist()


def _parsed(text: str | None):
    try:
        found = json.loads(text, parse_int=str, parse_float=str, parse_constant=str) if text else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


@F.arrow_udf(T.StructType([T.StructField("fingerprint", T.LongType()), T.StructField("paths", T.ArrayType(T.StringType()))]))
def _shape(record: pa.Array) -> pa.Array:
    out = []
    for value in _objects(record):
        paths = None if value is None else sorted(record_paths(value))
        out.append({"fingerprint": None if paths is None else fingerprint(paths), "paths": paths})
    return pa.array(out, pa.struct([("fingerprint", pa.int64()), ("paths", pa.list_(pa.string()))]))


@F.arrow_udf(T.LongType())
def _print(record: pa.Array) -> pa.Array:
    return pa.array([None if v is None else fingerprint(record_paths(v)) for v in _objects(record)], pa.int64())


# -- mappings -------------------------------------------------------------------------------


def _kind(paths: set[str], at: str, role: str = "role", content: str = "content") -> str | None:
    """How the field ``at`` is told: null, text, parts (a list of texts or of objects with one), messages, empty; else None."""
    below = {p[len(at) :] for p in paths if p == at or p.startswith((at + ".", at + "[", at + "?", at + "{"))}
    if not below:
        return "absent"
    if below <= {"", "?"}:
        return "text" if "" in below else "null"
    if below == {"[]"}:
        return "parts"
    if all(p.startswith("[].") for p in below):
        names = {re.split(r"(?<!\\)[.\[{?]", p[3:])[0] for p in below}
        if role in names and (content in names) and _kind({p[3:] for p in below}, role) in ("text", "null") and _kind({p[3:] for p in below}, content) in ("text", "null", "parts"):
            return "messages"
        if "text" in names and names <= _PART_FIELDS and below <= {f"[].{n}{q}" for n in names for q in ("", "?")}:
            return "parts"
    if below <= {"", "?", "[]", "[].text", "[].text?", "[].type", "[].type?"} and any(p.startswith("[]") for p in below):
        return "parts"  # text here and parts there
    return None


def _fits(layout: dict, paths: set[str], at: str) -> tuple[int, dict] | None:
    """How a layout's fields below ``at`` are told, and how many of those that it needs are null; None if it doesn't fit."""
    dot = at + "." if at else ""
    if "list" in layout:
        items, role, text = layout["list"]
        kind = _kind(paths, dot + items, role, text)
        return (0, {items: "messages"}) if kind == "messages" or (dot + items + "[]") in paths and kind == "parts" and not any(p.startswith(dot + items + "[].") for p in paths) and _empty(paths, dot + items) else None
    if "one" in layout:
        role, text = layout["one"]
        kinds = {role: _kind(paths, dot + role), text: _kind(paths, dot + text)}
        fit = not at and kinds[role] in ("text", "null") and kinds[text] in ("text", "null", "parts", "absent")
        return (0, kinds) if fit else None
    may, kinds, nulls = layout.get("may", ()), {}, 0
    for _, fields in layout["fields"]:
        for f in fields:
            kinds[f] = _kind(paths, dot + f)
            if kinds[f] is None or kinds[f] == "absent" and f not in may:
                return None
            nulls += kinds[f] == "null" and f not in may
    return nulls, kinds


def _empty(paths: set[str], at: str) -> bool:
    """Whether the list ``at`` is empty, or holds nulls or plain values alone."""
    return at + "[]" in paths


def choose_mapping(paths: set[str], layouts: dict | None = None) -> dict | None:
    """The mapping for a set of paths: its layout, the object that holds the fields, and how each is told.

    The record itself is tried before the objects within it, outer ones first; at each the
    layouts in their order, those whose needed fields are null after the others. A single turn is
    looked for in the record itself alone.
    """
    layouts = layouts or LAYOUTS
    paths = set(paths)
    inner = {p[:i] for p in paths for i, c in enumerate(p) if c == "." and p[i - 1 : i] != "\\" and "[" not in p[:i]}
    for at in ["", *sorted(inner, key=lambda x: (x.count("."), x))]:
        fits = [(fit[0], n, name, fit[1]) for n, (name, layout) in enumerate(layouts.items()) if (fit := _fits(layout, paths, at))]
        if fits:
            _, _, name, kinds = min(fits, key=lambda x: x[:2])
            return {"layout": name, "at": at, "kinds": kinds, **{k: layouts[name][k] for k in ("list", "one", "fields") if k in layouts[name]}}
    return None


def mappings(*records: DataFrame, record: str = "record", layouts: dict | None = None) -> DataFrame:
    """The different fingerprints of one or several tables of records: fingerprint, paths, n (records), layout, mapping.

    ``layout`` and ``mapping`` (JSON) are null where no layout fits; such records are rejected,
    and n counts them. Records that are null or no objects have no fingerprint and aren't listed.
    """
    shapes = reduce(DataFrame.union, [r.select(_shape(F.col(f"`{record}`")).alias("s")) for r in records]).select("s.*").where("fingerprint is not null")
    distinct = shapes.groupBy("fingerprint").agg(F.min("paths").alias("paths"), F.count("*").alias("n"))

    @F.arrow_udf(T.StringType())
    def chosen(paths: pa.Array) -> pa.Array:
        found = [choose_mapping(set(p), layouts) for p in paths.to_pylist()]
        return pa.array([None if m is None else json.dumps(m) for m in found], pa.string())

    listed = distinct.withColumn("mapping", chosen("paths"))
    return listed.select("fingerprint", "paths", "n", F.get_json_object("mapping", "$.layout").alias("layout"), "mapping")


# -- turns ----------------------------------------------------------------------------------


def _text(value) -> str | None:
    """A field as text: parts are joined by line feeds; None for what has no text to tell."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        parts = [_part(p) for p in value]
        return None if None in parts else "\n".join(parts)
    return None if isinstance(value, dict) else str(value)


def _part(part) -> str | None:
    if isinstance(part, dict):
        if part.get("type") not in (None, "text") or not isinstance(part.get("text"), str | None):
            return None
        return part.get("text") or ""
    return None if isinstance(part, list) else _text(part)


def _role(value) -> str:
    role = _text(value) or ""
    return ROLES.get(role, role)


def _messages(items: list, role: str, text: str) -> list[tuple] | None:
    out = []
    for m in items:
        if m is not None and not isinstance(m, dict):
            return None
        body = _text((m or {}).get(text))
        if body is None:
            return None
        out.append((_role((m or {}).get(role)), body))
    return out


@lru_cache(1024)
def _mapping(text: str) -> dict:
    return json.loads(text)


def record_turns(value: dict, mapping: dict) -> list[tuple] | None:
    """(role, text) of a record by its mapping; None if a value is not what the mapping says."""
    for name in filter(None, re.split(r"(?<!\\)\.", mapping["at"])):
        value = value.get(re.sub(r"\\(.)", r"\1", name)) or {}
    if "list" in mapping:
        items, role, text = mapping["list"]
        return _messages(value.get(items) or [], role, text)
    if "one" in mapping:
        role, text = mapping["one"]
        body = _text(value.get(text))
        return None if body is None else [(_text(value.get(role)) or "", body)]
    turns = []
    for role, fields in mapping["fields"]:
        parts = []
        for f in fields:
            if mapping["kinds"].get(f) == "messages":
                told = _messages(value.get(f) or [], "role", "content")
                if told is None:
                    return None
                turns += told
            else:
                parts.append(_text(value.get(f)))
        if None in parts:
            return None
        body = "\n\n".join(filter(None, parts))
        if parts and not (role == "system" and not body):
            turns.append((role, body))
    return turns


@F.arrow_udf(TURN)
def _turns(record: pa.Array, mapping: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    out = []
    for value, m in zip(_objects(record), mapping.to_pylist(), strict=True):
        turns = None if value is None or m is None else record_turns(value, _mapping(m))
        out.append(None if turns is None else [{"role": r, "text": t} for r, t in turns])
    return pa.array(out, kind)


_PLACES = "_canonical_turns_"


def canonical_turns(records: DataFrame, record: str = "record", layouts: dict | None = None, table: DataFrame | None = None) -> DataFrame:
    """Add ``layout`` and ``turns`` to heterogeneous records: JSON strings of any length, or structs as they are.

    The hash of a record's nested field paths finds its mapping in ``table``, which is
    ``mappings(records)`` unless another is given. Fields that no layout reads don't
    hinder a mapping. Texts may be numbers, strings, or lists of parts, which are joined; a prompt
    or an answer may be a list of messages; the fields may lie in an object within the record.
    A record that is null, no object, or has a fingerprint without a mapping has a null layout
    and null turns, see :func:`rejected`; so has one with parts of other kinds than text. An
    empty list of messages has no turns; null and absent texts and roles are empty. An
    empty table gives an empty result, repeated rows are kept, and of further columns only
    such as are called ``layout`` or ``turns`` are replaced.
    """
    base = records.drop(*[c for c in ("layout", "turns") if c != record])
    # a written table has its real size, so that a small one is broadcast and a hot fingerprint shuffles nothing
    known = table if table is not None else stage(mappings(records, record=record, layouts=layouts), "mappings")
    known = known.select(F.col("fingerprint").alias(f"{_PLACES}key"), F.col("layout").alias(f"{_PLACES}layout"), F.col("mapping").alias(f"{_PLACES}mapping")).where(f"{_PLACES}key is not null")
    here = base.withColumn(f"{_PLACES}print", _print(F.col(f"`{record}`")))
    here = here.join(known, F.col(f"{_PLACES}print") == F.col(f"{_PLACES}key"), "left")
    here = here.withColumn("turns", _turns(F.col(f"`{record}`"), F.col(f"{_PLACES}mapping")))
    here = here.withColumn("layout", F.when(F.col("turns").isNotNull(), F.col(f"{_PLACES}layout")))
    return here.select(*[F.col(f"`{c}`") for c in base.columns], "layout", "turns")


def rejected(records: DataFrame, record: str = "record", layouts: dict | None = None, table: DataFrame | None = None) -> DataFrame:
    """The records that no mapping fits, all columns kept; count them, or mend them (or the table) and try again."""
    return canonical_turns(records, record, layouts, table).where("layout is null").drop("layout", "turns")


#: The template: a turn is OPEN role, a line feed, text, CLOSE and a line feed.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other chat templates that no text may contain unescaped.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIRST = "|".join(rf"{re.escape(c)}(?=(?:{'|'.join(re.escape(x[1:]) for x in CONTROL if x[0] == c)}))" for c in ("<", "["))
_CONTROL, _ROLE_CONTROL, _BACK = re.compile(_FIRST), re.compile(rf"{_FIRST}|(?=\n)"), re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    r"""Double backslashes; put one after the first character of a control string, and before a role's line feeds."""
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


_TURN = re.compile(rf"{re.escape(OPEN)}((?:[^\\\n]|\\.)*)\n(.*?){re.escape(CLOSE)}\n", re.DOTALL)
#: Code points of formatted text in one row, but for the last turn; longer conversations go on in another row.
PART = 1 << 20
FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def format_chats(turns: DataFrame, part: int = PART) -> DataFrame:
    """``turns(conv_id, turn, k, role, text)`` to formatted conversations with a loss mask.

    Turns go by (turn, k, role, text), nulls first. Control strings inside roles and
    texts are escaped reversibly. ``loss`` holds the spans of code points of assistant
    texts. Rows of a conversation come sorted to one task and are formatted as they
    stream by; a conversation longer than ``part`` goes on in further rows, so that
    no conversation is held whole. Repeated rows are repeated turns; conversations of a
    null id are one conversation. An empty table gives an empty result.
    """
    rows = turns.select("conv_id", "turn", "k", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "k", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, held, size, loss, out = object(), 0, [], 0, [], []

        def close():
            if held:
                out.append({"conv_id": conv, "part": number, "formatted": "".join(held), "loss": loss})

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != conv or size >= part:
                    close()
                    number = number + 1 if conv_id == conv else 0
                    conv, held, size, loss = conv_id, [], 0, []
                head, body = f"{OPEN}{escape(role or '', True)}\n", escape(text or "")
                if role == "assistant":
                    loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
                held.append(f"{head}{body}{CLOSE}\n")
                size += len(held[-1])
            if out:
                yield _chats(out)
                out.clear()
        close()
        if out:
            yield _chats(out)

    return map_batches(rows, run, FORMATTED)


def _chats(rows: list[dict]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", span)]))


def read_chats(chats: DataFrame) -> DataFrame:
    """What formatted conversations say, read back from their rows alone.

    Rows of a conversation go to one task and stream by in the order of ``part``; a null
    conv_id is a conversation of its own. A conversation of empty turns has digests of
    their line feeds, an empty table gives an empty result, and text that is not of
    this format is an error. Returns conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.
    """
    rows = chats.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = object(), None, []

        def close():
            if state:
                out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv_id, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if conv_id != conv:
                    close()
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(formatted):
                    m = _TURN.match(formatted, at)
                    if not m:
                        raise ValueError(f"conversation {conv_id}: no turn at {at}")
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    at = m.end()
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            if out:
                yield _digests(out)
                out.clear()
        close()
        if out:
            yield _digests(out)

    return map_batches(rows, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=names)


def turns_of(records: DataFrame, record: str = "record", skip_rejected: bool = False, table: DataFrame | None = None) -> DataFrame:
    """``records(conv_id, turn, record)`` to their turns: conv_id, turn, k (place in the record), role, text.

    A record that no mapping fits ends the job with an error that names it, unless
    ``skip_rejected`` leaves such to :func:`rejected`.
    """
    found = canonical_turns(records.select("conv_id", "turn", F.col(f"`{record}`").alias("record")), table=table)
    if not skip_rejected:
        name = F.concat(F.lit("no layout fits a record of conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(", turn "), F.coalesce(F.col("turn").cast("string"), F.lit("null")))
        found = found.withColumn("turns", F.when(F.col("layout").isNull(), F.raise_error(name).cast(TURN)).otherwise(F.col("turns")))
    return found.select("conv_id", "turn", F.posexplode("turns").alias("k", "_t")).select("conv_id", "turn", "k", "_t.role", "_t.text")


def chat_formatting(*records: DataFrame, record: str = "record", skip_rejected: bool = False) -> DataFrame:
    """Heterogeneous ``records(conv_id, turn, record)`` to formatted conversations, written and read back.

    Several tables may be given, each with records of its own type; they have one table of
    mappings, and their turns meet in their conversations. See :func:`turns_of` for records of unknown layout and
    :func:`format_chats` for the rest.
    """
    table = stage(mappings(*records, record=record), "mappings")
    turns = [turns_of(r, record, skip_rejected, table) for r in records]
    return stage(format_chats(reduce(DataFrame.unionByName, turns)), "chats")
