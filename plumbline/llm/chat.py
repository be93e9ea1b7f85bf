"""Chat formatting by schema fingerprints.

A record is a JSON object of any known layout. The hash of its sorted nested field
paths selects a declarative mapping, which turns it into canonical turns (role,
text). Turns are written in one template; control strings inside texts and roles are
escaped, so that parsing the output gives back exactly the turns, and the loss mask
covers the assistant's texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches

#: What marks turns in the template.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not appear unescaped inside a text: the template's own and those of other common templates.
CONTROL = (OPEN, MIDDLE, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ONES = "|".join(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_CONTROL = re.compile(_ONES)


def escaped(text: str) -> str:
    """One backslash more after the first character of every control string, escaped ones included."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def paths(value: object) -> set[str]:
    """Nested field paths of a JSON value, however deep; list items share the path with [], values in lists other than objects get its path with a !."""
    out: set[str] = set()
    todo = [("", value)]
    while todo:
        at, now = todo.pop()
        if isinstance(now, dict) and now:
            todo += [(f"{at}.{k}" if at else k, v) for k, v in now.items()]
        elif isinstance(now, list) and now:
            todo += [(at + "[]", v) for v in now]
        else:
            out.add(at + "[]" if now == [] else at + "!" if at.endswith("[]") else at)
    return out


def fingerprint(found: set[str]) -> str:
    """Hash of a layout: its sorted field paths."""
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list with a role and a text field, or fields with fixed roles.

    Texts of neighbouring fields of one role are joined by a blank line. A null field has
    no turn, an empty one an empty turn, as in lists."""

    name: str
    items: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()

    def layout(self) -> set[str]:
        if self.items is not None:
            return {f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"} | {f for f, _ in self.fields}
        return {f for f, _ in self.fields}

    def turns(self, record: dict) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for name, role in self.fields:
            value = record.get(name)
            if value is None:
                continue
            if value == "" and out and out[-1][0] == role:
                continue
            if out and out[-1][0] == role:
                out[-1] = (role, out[-1][1] + "\n\n" + str(value))
            else:
                out.append((role, str(value)))
        for item in record.get(self.items) or [] if self.items is not None else []:
            role, text = item.get(self.role), item.get(self.text)
            out.append((ROLES.get(role, "" if role is None else str(role)), "" if text is None else str(text)))
        return out


#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

MAPPINGS = (
    Mapping("messages", "messages"),
    Mapping("messages-with-system", "messages", fields=(("system", "system"),)),
    Mapping("messages-text", "messages", "role", "text"),
    Mapping("conversations", "conversations", "from", "value"),
    Mapping("conversations-with-system", "conversations", "from", "value", (("system", "system"),)),
    Mapping("dialog", "dialog", "speaker", "text"),
    Mapping("prompt-completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("prompt-response", fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("system-prompt-response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("instruction-output", fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction-input-output", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("question-answer", fields=(("question", "user"), ("answer", "assistant"))),
    Mapping("context-question-answer", fields=(("context", "user"), ("question", "user"), ("answer", "assistant"))),
)

#: A list without items has one path; it is the layout of its mapping too.
BY_PRINT = {fingerprint(m.layout()): m for m in MAPPINGS} | {fingerprint({f"{m.items}[]"} | {f for f, _ in m.fields}): m for m in reversed(MAPPINGS) if m.items}


def record_of(source: str | None) -> dict | None:
    """The JSON object of a text; None for anything else, nesting beyond what the parser takes included."""
    try:
        record = json.loads(source or "null")
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def whole(text: str) -> str:
    """Halves of surrogate pairs, which no encoding can hold, replaced."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical(record: dict) -> tuple[str | None, list[tuple[str, str]]]:
    """(name of the mapping, turns); no mapping and no turns for an unknown layout."""
    mapping = BY_PRINT.get(fingerprint(paths(record)))
    return (mapping.name, [(whole(role), whole(text)) for role, text in mapping.turns(record)]) if mapping else (None, [])


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The template's text, and the spans of it that are under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped(role)}{MIDDLE}", escaped(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE + "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for part in text.split(CLOSE + "\n")[:-1]:
        role, body = part.removeprefix(OPEN).split(MIDDLE)
        out.append((unescaped(role), unescaped(body)))
    return out


FORMATTED = "conv_id long, mapping string, formatted string, loss_spans array<struct<start:long,end:long>>"


def chats(records: DataFrame) -> DataFrame:
    """FORMATTED for each row of records (conv_id, record), record being JSON text.

    An unknown layout (lists of anything but objects included), broken or too deeply
    nested JSON and a null record give a null mapping and an empty output. Lone halves of
    surrogate pairs become U+FFFD. Null texts and roles are empty. Repeated rows are rows of their own; an
    empty table gives none; other columns are not read."""
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, spans = [], [], []
            for value in batch.column(1):
                record = record_of(value.as_py())
                name, turns = canonical(record) if record is not None else (None, [])
                text, masked = formatted(turns)
                names.append(name)
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in masked])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "mapping", "formatted", "loss_spans"])

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("record").cast("string").alias("record")).mapInArrow(run, FORMATTED)


def records_of_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of a table with a row for each turn (conv_id, turn, role, text).

    Turns are ordered by turn, equal ones by role and text, null first. A conversation is
    one record however long it is, as it is one text in the end. Null conv_id: a conversation of its own."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    held = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return held.select("conv_id", F.to_json(F.struct(F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))).alias("record"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(chat: DataFrame) -> DataFrame:
    """DIGESTS of a FORMATTED table, read back from its texts and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                turns = parsed(text)
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans.as_py())
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((conv.as_py(), len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chat.select("conv_id", "formatted", "loss_spans").mapInArrow(run, DIGESTS)
