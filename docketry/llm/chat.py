"""Chat formatting by token-level assembly.

Every text is encoded alone, as ordinary text, so no text can yield a reserved id; turns are then framed
by splicing reserved ids, and the loss mask of a conversation comes from prefix sums over segment
lengths. The formatted text has control strings as marks; one that occurs inside a text is escaped, as is
the escape sign itself, so both the token ids and the text lead back to the turns.

Template: ``<s>`` once, then for each turn its opening mark, its text and its closing mark
(``<<SYS>>…<</SYS>>``, ``[INST]…[/INST]``, ``[ANS]…</s>``; for any other role
``<<ROLE>>role<<TEXT>>…</s>``). The loss mask covers an assistant turn's text, not its marks.

Encoding is per row, before rows meet; a conversation is then assembled as a stream in turn order and
written in parts, so neither a long conversation nor a frequent conv_id is ever held whole. Ties of
(conv_id, turn) go by role, then text. A null text is empty; a null role counts as the role ''; a null
turn comes first; rows with a null conv_id are one conversation. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import written

# The template's control strings, in the order of their reserved ids
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ANS]", "<<ROLE>>", "<<TEXT>>")
OPENING = {"system": "<<SYS>>", "user": "[INST]", "assistant": "[ANS]"}
CLOSING = {"system": "<</SYS>>", "user": "[/INST]"}
ROLE_OF = {v: k for k, v in OPENING.items()}
MARK = "␛"
_CONTROL = re.compile("|".join(map(re.escape, (*CONTROLS, MARK))))
_ESCAPED = re.compile(MARK + r"(\d)")
#: Fixed value: the byte-level vocabulary's word pattern
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PART_TOKENS = 1 << 16


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{MARK}{CONTROLS.index(m[0]) if m[0] != MARK else len(CONTROLS)}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (*CONTROLS, MARK)[int(m[1])], text)


@cache
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("docketry-chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def format_chats(turns: DataFrame, path: str = TOKENIZER, part_tokens: int = PART_TOKENS) -> DataFrame:
    """conv_id, part, input_ids, loss_mask and text of the formatted conversations; the parts of one follow on each other."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base = tokenizer(path)
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            texts = [escape(t or "") for t in batch.column(3).to_pylist()]
            ids = []
            for role, text in zip(roles, texts, strict=True):
                known = role in OPENING
                head = [base + CONTROLS.index(OPENING.get(role, "<<ROLE>>"))]
                if not known:
                    head += [*model.encode_ordinary(escape(role)), base + CONTROLS.index("<<TEXT>>")]
                body = model.encode_ordinary(text)
                ids.append(np.array([len(head), len(body), *head, *body, base + CONTROLS.index(CLOSING.get(role, "</s>"))], "<i4").tobytes())
            texts = [(OPENING[r] if r in OPENING else f"<<ROLE>>{escape(r)}<<TEXT>>") + t + CLOSING.get(r, "</s>") for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles), batch.column(3), pa.array(texts), pa.array(ids, pa.binary())], ["conv_id", "turn", "role", "raw", "text", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = tokenizer(path)[1]
        now, part, segments, loss, texts, size = object(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(s) for s in segments])
            turns_on = np.zeros(ends[-1] + 1, np.int8)
            for end, (skip, length) in zip(ends, loss, strict=True):  # +1 where a loss span begins, -1 behind it
                if length:
                    begin = end - skip
                    turns_on[begin] += 1
                    turns_on[begin + length] -= 1
            mask = np.cumsum(turns_on[:-1], dtype=np.int8)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], kind), pa.array([part], pa.int64()), pa.array([np.concatenate(segments)], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8())), pa.array(["".join(texts)], pa.string())],
                ["conv_id", "part", "input_ids", "loss_mask", "text"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for conv, role, text, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if type(now) is object or conv != now:
                    if segments:
                        yield flush()
                    now, part, segments, loss, texts, size = conv, 0, [np.array([base], "<i4")], [(0, 0)], ["<s>"], 1
                elif size >= part_tokens:
                    yield flush()
                    part, segments, loss, texts, size = part + 1, [], [], [], 0
                raw = np.frombuffer(blob, "<i4")
                head, body = int(raw[0]), int(raw[1])
                segments.append(raw[2:])
                loss.append((len(raw) - 2 - head, body if role == "assistant" else 0))
                texts.append(text)
                size += len(raw) - 2
        if segments:
            yield flush()

    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("raw"))
    turn = rows.schema["turn"].dataType.simpleString()
    encoded = rows.mapInArrow(encode, f"conv_id {kind}, turn {turn}, role string, raw string, text string, ids binary")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "raw")
    return ordered.mapInArrow(assemble, f"conv_id {kind}, part long, input_ids array<int>, loss_mask array<tinyint>, text string")


def read_back(formatted: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Digests of each conversation, from the token ids, mask and text of ``formatted`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base = tokenizer(path)
        now, turns, whole, loss, loss_chars, chars = object(), 0, None, None, 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], kind), pa.array([turns], pa.int64()), pa.array([whole.hexdigest()]), pa.array([loss_chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([chars], pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for row in range(batch.num_rows):
                conv = batch.column(0)[row].as_py()
                if type(now) is object or conv != now:
                    if type(now) is not object:
                        yield out()
                    now, turns, whole, loss, loss_chars, chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                chars += len(batch.column(4)[row].as_py())
                ids, mask = (np.asarray(batch.column(c)[row].values) for c in (2, 3))
                reserved = np.flatnonzero(ids >= base)
                role, at = "", 0
                for k in reserved:
                    control, text = CONTROLS[ids[k] - base], unescape(model.decode(ids[at:k].tolist()))
                    if control == "<<TEXT>>":
                        role = text
                    elif control in ROLE_OF:
                        role = ROLE_OF[control]
                    elif control not in ("<s>", "<<ROLE>>"):
                        turns += 1
                        whole.update(f"{role}\n{text}\n".encode())
                        begin = at + int(np.argmax(mask[at:k])) if mask[at:k].any() else k
                        said = unescape(model.decode(ids[begin:k][mask[begin:k] > 0].tolist()))
                        loss.update(said.encode())
                        loss_chars += len(said)
                    at = k + 1
        if type(now) is not object:
            yield out()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_digests(turns: DataFrame, path: str = TOKENIZER) -> DataFrame:
    return read_back(written(format_chats(turns, path), "chats"), path)
