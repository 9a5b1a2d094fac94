"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: the template text of all turns up to it, with only that reply under
the loss mask. Turns after the last reply, or a conversation without one, give one example without a mask, so that no
turn is lost. Control strings inside roles and texts are escaped with a backslash, reversibly.

Defined results: null role and null text are empty; turns go by turn (null first), then role, then text; repeated rows
are kept; rows of a null conv_id form one conversation. Texts of any length are formatted whole; examples are made one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrow import map_rows

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of every control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends in it."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted example."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def format_chat(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, example, text, loss_start, loss_end (code points; both null without a target).

    One shuffle by conv_id; the turns of a conversation stream through sorted, so that a task holds one growing prefix
    and not the rows of a group.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, prefix, example, open_turns, begun = None, "", 0, False, False
        for b in batches:
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not begun or conv != now:
                    if open_turns:
                        yield now, example, prefix, None, None
                    now, prefix, example, begun = conv, "", 0, True
                turn, start, end = render(role, text)
                at = len(prefix)
                prefix += turn
                open_turns = role != target_role
                if not open_turns:
                    yield conv, example, prefix, at + start, at + end
                    example += 1
        if open_turns:
            yield now, example, prefix, None, None

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_rows(ordered, run, "conv_id long, example long, text string, loss_start long, loss_end long", lambda r: len(r[2]))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Reads format_chat's examples back, in their order and without another shuffle, and digests each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, last, begun = None, "", False
        loss, chars, size = hashlib.sha256(), 0, 0

        def done() -> tuple:
            turns = parse(last)
            digest = hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            return now, len(turns), digest.hexdigest(), chars, loss.hexdigest(), size

        for b in batches:
            for i in range(b.num_rows):
                conv, text, start, end = (b.column(k)[i].as_py() for k in (0, 2, 3, 4))
                if not begun or conv != now:
                    if begun:
                        yield done()
                    now, begun, loss, chars, size = conv, True, hashlib.sha256(), 0, 0
                if start is not None:
                    masked = unescape(text[start:end])
                    loss.update(masked.encode())
                    chars += len(masked)
                size += len(text)
                last = text
        if begun:
            yield done()

    return map_rows(format_chat(conversations), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
