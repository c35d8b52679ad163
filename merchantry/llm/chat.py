"""Chat formatting by schema fingerprints.

A record's nested field paths (``messages[].role``, ``instruction`` ...), as far as any known layout
uses them, are sorted and hashed; the hash selects a declarative ``Layout``, which says where the
turns are and what the roles are called. A record whose fingerprint no layout has is kept apart
(``layout`` null, no turns), never guessed. Records are VARIANT values, made from JSON text or from
typed rows, and everything up to the formatted segments is DataFrame functions.

A turn is formatted as ``BEGIN role MIDDLE text END``. Inside roles and texts every backslash is
doubled and a backslash is put after the first character of each control string, so that none
is left and the original comes back exactly. Assistant texts are under the loss mask.

Defined cases: null texts and roles are empty; records that are null, not JSON or of an unknown
layout have no turns; turns are ordered by their number, then role and text, nulls first; repeated
rows are repeated turns; a null conversation id is a conversation of its own; an empty table gives
no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.session import ship_package

BEGIN, MIDDLE, END = "<|turn|>", "<|says|>", "<|over|>"
CONTROLS = [BEGIN, MIDDLE, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]",
            "<<SYS>>", "<</SYS>>"]
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """``turns``: path of the array of turns, with ``role`` and ``text`` inside it ('' for a record
    that is itself one turn). Without ``role``: ``fixed`` lists (role, field); several fields of
    one role are joined by a blank line. ``optional`` fields may be missing."""
    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.role:
            prefix = f"{self.turns}[]." if self.turns else ""
            return [prefix + self.role, prefix + self.text]
        return [f for _, f in self.fixed]


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = [
    Layout("turn_row", turns="", role="role", text="text"),
    Layout("messages", turns="messages", role="role", text="content"),
    Layout("conversations", turns="conversations", role="from", text="value", aliases=_SPEAKERS),
    Layout("dialogue", turns="turns", role="speaker", text="utterance", aliases=_SPEAKERS),
    Layout("instruction", fixed=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
           optional=("system", "input")),
    Layout("prompt_completion", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question_answer", fixed=(("user", "question"), ("assistant", "answer"))),
]


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def registry(layouts: list[Layout]) -> dict[str, str]:
    """Fingerprint -> layout name, for every choice of optional fields."""
    out: dict[str, str] = {}
    for lay in layouts:
        for k in range(len(lay.optional) + 1):
            for gone in itertools.combinations(lay.optional, k):
                key = fingerprint_of(set(lay.paths()) - set(gone))
                if out.setdefault(key, lay.name) != lay.name:
                    raise ValueError(f"layouts {out[key]} and {lay.name} have the same fields")
    return out


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _text(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "string"), F.lit(""))


def _has(record: Column, path: str) -> Column:
    if "[]." in path:
        outer, inner = path.split("[].")
        return F.coalesce(F.exists(_get(record, outer, "array<variant>"),
                                   lambda e: _get(e, inner, "variant").isNotNull()), F.lit(False))
    return _get(record, path, "variant").isNotNull()


def fingerprint(record: Column, layouts: list[Layout]) -> Column:
    known = sorted({p for lay in layouts for p in lay.paths()})
    present = F.concat_ws("\n", *[F.when(_has(record, p), F.lit(p)) for p in known])
    return F.sha2(present.cast("binary"), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _turns(record: Column, lay: Layout) -> Column:
    def named(role):
        for old, new in lay.aliases.items():
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return role
    if lay.role and lay.turns == "":
        return F.array(_turn(named(_text(record, lay.role)), _text(record, lay.text)))
    if lay.role:
        return F.transform(_get(record, lay.turns, "array<variant>"),
                           lambda e: _turn(named(_text(e, lay.role)), _text(e, lay.text)))
    out = []
    for role in dict.fromkeys(r for r, _ in lay.fixed):
        own = [f for r, f in lay.fixed if r == role]
        given = F.concat_ws("\n\n", *[F.when(_text(record, f) != "", _text(record, f)) for f in own])
        turn = F.array(_turn(F.lit(role), given))
        optional = all(f in lay.optional for f in own)
        out.append(F.when(given == "", F.array().cast(f"array<{TURN}>")).otherwise(turn) if optional else turn)
    return F.concat(*out)


def canonical(records: DataFrame, record: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns`` (array of role, text) in place of the
    VARIANT column ``record``."""
    names = registry(layouts)
    chosen = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("fingerprint"))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for lay in layouts:
        turns = F.when(F.col("layout") == lay.name, _turns(F.col(record), lay)).otherwise(turns)
    return (records.withColumn("fingerprint", fingerprint(F.col(record), layouts))
            .withColumn("layout", chosen)
            .withColumn("turns", F.coalesce(turns, F.array().cast(f"array<{TURN}>"))).drop(record))


def escape(text: Column) -> Column:
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({starts})", r"$1\\")


def segments(canonical_turns: DataFrame, keys: list[str]) -> DataFrame:
    """One row per turn: ``keys``, ``nth`` (order within a record), ``segment``, and the characters of the
    segment that are under the loss mask (``loss_start``, ``loss_chars``)."""
    rows = canonical_turns.select(*keys, F.posexplode("turns").alias("nth", "t"))
    head = F.concat(F.lit(BEGIN), escape(F.col("t.role")), F.lit(MIDDLE))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("t.text")))
    learned = F.col("t.role") == "assistant"
    return rows.select(
        *keys, "nth", F.concat("head", "body", F.lit(END)).alias("segment"),
        F.char_length("head").alias("loss_start"),
        F.when(learned, F.char_length("body")).otherwise(0).alias("loss_chars"), "t.role", "t.text")


_PARSE = re.compile(f"{re.escape(BEGIN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_back(segment: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _PARSE.finditer(segment)]


def digests(formatted: DataFrame, conversation: str, order: list[str]) -> DataFrame:
    """Per conversation, read from the formatted segments alone: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Segments are streamed in order, so a conversation of any length needs
    the memory of one batch."""
    ship_package(formatted.sparkSession)
    id_type = formatted.schema[conversation].dataType.simpleString()

    def run(it):
        state, key, seen = None, None, False

        def row():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in it:
            done = []
            arrow_type = batch.schema.types[0]
            for k, seg, start, chars in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if not seen or k != key:
                    if seen:
                        done.append(row())
                    key, seen, state = k, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(seg):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(seg[start:start + chars])
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(seg)
            yield _digest_batch(done, arrow_type, conversation)
        if seen:
            yield _digest_batch([row()], arrow_type, conversation)

    return (formatted.select(conversation, "segment", "loss_start", "loss_chars", *order)
            .repartition(conversation).sortWithinPartitions(conversation, *order)
            .select(conversation, "segment", "loss_start", "loss_chars")
            .mapInArrow(run, f"{conversation} {id_type}, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))


def _digest_batch(rows, id_type, conversation) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                      [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
