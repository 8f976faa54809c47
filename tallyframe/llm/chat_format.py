"""Chat formatting with schema fingerprints.

A record is a JSON object in one of many layouts. The paths of its fields, with
those no layout knows left out, are hashed; the fingerprint selects a declarative
mapping that says where the turns stand, and the turns come out in one canonical
form (conversation, order, role, text). Rows of one conversation are then brought
together, in order of turn, and written in one template:

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  <s>text</s>
    other      <|name|>text<|end|>

Texts and other role names are escaped: a backslash is doubled and each control
string becomes a backslash and its letter, so a formatted conversation holds no
control string but those of the template, and reading it back is exact. The loss
mask covers the texts of the assistant turns, as code point ranges.

Edge cases: a null text is empty; a null role is the empty other role; a null
turn sorts first; rows with a null conversation form one conversation; ties in
turn are ordered by role and text; repeated rows are repeated turns; a record in
an unknown layout, or that is no JSON object, or nested too deep to parse, or holds
something else than objects among its turns, or an id that is no integer, goes to
unmapped(); a very long text is one string of its task, as its whole conversation is;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, tidy

# Control strings of the template and the letters that stand for them.
CONTROL = {"[INST]": "a", "[/INST]": "b", "<<SYS>>": "c", "<</SYS>>": "d", "<s>": "e", "</s>": "f", "<|end|>": "g", "<|": "h", "|>": "i"}
_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}

#: Where each layout has its turns. each: the list of turns ("" is the record itself);
#: turns: (role, or @field that holds it, and field of the text); roles: other names of roles;
#: conversation, turn: fields of a record that is but a part of a conversation.
LAYOUTS = {
    "messages": {"each": "messages", "turns": [("@role", "content")]},
    "sharegpt": {"each": "conversations", "turns": [("@from", "value")], "roles": {"human": "user", "gpt": "assistant"}},
    "instruction": {"each": "", "turns": [("system", "system"), ("user", "instruction+input"), ("assistant", "output")], "optional": ["system", "input"]},
    "prompt": {"each": "", "turns": [("system", "system"), ("user", "prompt"), ("assistant", "completion")], "optional": ["system"]},
    "response": {"each": "", "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")], "optional": ["system"]},
    "question": {"each": "", "turns": [("system", "system"), ("user", "question"), ("assistant", "answer")], "optional": ["system"]},
    "turn_rows": {"each": "", "turns": [("@role", "text")], "conversation": "conv_id", "turn": "turn"},
}

_ESCAPED = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_CODES = {"\\": "\\\\", **{k: "\\" + v for k, v in CONTROL.items()}}
_STRINGS = {v: k for k, v in _CODES.items()}
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|<\|(?P<role>.*?)\|>(?P<other>.*?)<\|end\|>", re.S)


def _paths(layout: dict) -> tuple[list[str], list[str]]:
    """The field paths a layout must and may have."""
    lead = f"{layout['each']}[]." if layout["each"] else ""
    fields = [f for role, text in layout["turns"] for f in ([role[1:]] if role[0] == "@" else []) + text.split("+")]
    named = [lead + f for f in fields] + [layout[k] for k in ("conversation", "turn") if k in layout]
    may = [lead + f for f in layout.get("optional", [])]
    return [p for p in named if p not in may], may


def fingerprint(paths: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


@cache
def _registry() -> tuple[dict[str, dict], frozenset[str]]:
    """The mapping of each fingerprint, and all paths that layouts know."""
    found, known = {}, set()
    for name, layout in LAYOUTS.items():
        must, may = _paths(layout)
        known |= {*must, *may}
        for extra in chain.from_iterable(combinations(may, k) for k in range(len(may) + 1)):
            found[fingerprint({*must, *extra})] = layout | {"name": name}
    return found, frozenset(known)


def nested_paths(value: object, lead: str = "") -> set[str]:
    """Paths of all leaves; an element of a list is []."""
    found, todo = set(), [(value, lead)]
    while todo:
        value, lead = todo.pop()
        if isinstance(value, dict):
            todo += [(v, f"{lead}.{k}" if lead else k) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(v, lead + "[]") for v in value]
        else:
            found.add(lead)
    return found


def _long(value: object) -> bool:
    return value is None or isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63


def _said(value: object) -> str:
    """A scalar as text; halves of characters, which JSON can hold, become U+FFFD."""
    return "" if value is None else str(value).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def canonical_turns(record: object) -> tuple[object, list[tuple[object, str, str]]] | None:
    """(conversation, [(turn, role, text)]) of a record, None if no layout fits: its items must be
    objects, its fields scalars, and its conversation and turn integers of 64 bits or null."""
    layouts, known = _registry()
    if not isinstance(record, dict):
        return None
    layout = layouts.get(fingerprint(nested_paths(record) & known))
    if layout is None:
        return None
    items = record.get(layout["each"]) if layout["each"] else [record]
    named = {f for role, fields in layout["turns"] for f in (*fields.split("+"), *([role[1:]] if role[0] == "@" else []))}
    if not isinstance(items, list) or not all(isinstance(x, dict) and not any(isinstance(x.get(f), (dict, list)) for f in named) for x in items):
        return None
    if not all(_long(record.get(layout[k])) for k in ("conversation", "turn") if k in layout):
        return None
    turns = []
    for i, item in enumerate(items):
        for k, (role, fields) in enumerate(layout["turns"]):
            present = [f for f in fields.split("+") if f in item]
            if not present:
                continue
            name = _said(item.get(role[1:])) if role[0] == "@" else role
            name = layout.get("roles", {}).get(name, name)
            text = "\n".join(_said(item[f]) for f in present if item[f]) if len(present) > 1 else _said(item[present[0]])
            turns.append((record.get(layout["turn"]) if "turn" in layout else i * len(layout["turns"]) + k, name, text))
    return record.get(layout["conversation"]) if "conversation" in layout else None, turns


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _STRINGS[m[0]], text)


def write_chat(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the ranges of its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        first, last = _MARKS.get(role, (f"<|{escape(role)}|>", "<|end|>"))
        said = escape(text)
        if role == "assistant":
            spans.append((at + len(first), at + len(first) + len(said)))
        parts += [first, said, last]
        at += len(first) + len(said) + len(last)
    return "".join(parts), spans


def read_chat(line: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation. Raises ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(line):
        found = _TURN.match(line, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        role = found.lastgroup
        turns.append((unescape(found["role"]), unescape(found["other"])) if role == "other" else (role, unescape(found[role])))
        at = found.end()
    return turns


def _parsed(value: str | None) -> object:
    try:
        return json.loads(value) if value else None
    except (ValueError, RecursionError):
        return None


def turns_of(records: DataFrame, record_col: str = "record", id_col: str = "record_id") -> DataFrame:
    """(conversation, turn, role, text) of all JSON records whose layout is known.
    The conversation is the record's id where the layout names none."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = _parsed(value)
                if (found := canonical_turns(record)) is not None:
                    own = isinstance(record, dict) and "conv_id" in record
                    out += [(found[0] if own else ident, turn, role, text) for turn, role, text in found[1]]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conversation", "turn", "role", "text"])

    return records.select(F.col(id_col).cast("long"), F.col(record_col)).mapInArrow(run, "conversation long, turn long, role string, text string")


def unmapped(records: DataFrame, record_col: str = "record", id_col: str = "record_id") -> DataFrame:
    """(id, fingerprint) of the records no layout fits; the fingerprint is of the known paths they have."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, r) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if canonical_turns(r := _parsed(v)) is None]
            marks = [fingerprint(nested_paths(r) & _registry()[1]) if isinstance(r, dict) else None for _, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(marks, pa.string())], names=["id", "fingerprint"])

    return records.select(F.col(id_col).cast("long"), F.col(record_col)).mapInArrow(run, "id long, fingerprint string")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns(conversation, turn, role, text): conversation,
    formatted, loss_spans (array of start, end in code points). A task holds one
    conversation at a time."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        now: object = run  # no conversation yet
        done: list[tuple] = []
        for batch in batches:
            for chat, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if chat != now:
                    if now is not run:
                        done.append((now, *write_chat(held)))
                    now, held = chat, []
                held.append((role or "", text or ""))
            yield _chats(done)
            done = []
        if now is not run:
            yield _chats([(now, *write_chat(held))])

    rows = turns.repartition("conversation").sortWithinPartitions("conversation", "turn", "role", "text").select("conversation", "role", "text")
    return rows.mapInArrow(run, "conversation long, formatted string, loss_spans array<struct<start:long,end:long>>")


def _chats(rows: list[tuple]) -> pa.RecordBatch:
    spans = [[{"start": a, "end": b} for a, b in r[2]] for r in rows]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(spans, kind)], names=["conversation", "formatted", "loss_spans"])


def digests(chats: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chat, line, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_chat(line)
                loss = "".join(unescape(line[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((chat, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(line)))
            columns = zip(*out, strict=True) if out else ([],) * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})
    records = rows.select(F.col("conv_id").alias("record_id"), F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    records = records.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("record_id"), F.lit(extra).alias("record")))
    return digests(format_chats(turns_of(records)))


ORACLE_OP6 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS said FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(replace(replace(replace(
      replace(said, '\', '\\'), '[INST]', '\a'), '[/INST]', '\b'), '<<SYS>>', '\c'), '<</SYS>>', '\d'), '<s>', '\e'), '</s>', '\f'),
      '<|end|>', '\g'), '<|', '\h'), '|>', '\i'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 11 + length(role) END AS wide
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), said, chr(10)), '' ORDER BY turn, role, said)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(said) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY turn, role, said) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(wide) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
