"""Chat formatting at token level (operator 5).

A conversation is one segment per turn: a reserved id that opens the role, the
ids of the text, a reserved id that ends the turn. Segments are encoded apart,
so no text merges with a control string, and reserved ids lie above the
tokenizer's own. The loss mask is the prefix sum of +1 where a trained text
begins and -1 behind it; the place of a segment in its conversation is the
prefix sum of the lengths before it.

In the formatted string the same controls stand as text, so control strings
inside a text are escaped: a control preceded by n backslashes gets 2n + 1,
and n backslashes at a text's end become 2n. Both are undone on reading.
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterator, List, Sequence, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, runs, slices, worker_state
from .tokenizing import BYTE_BPE, resolve

#: Fixed values of the template, in the order of their reserved ids.
CONTROLS = ("### System:", "### User:", "### Assistant:", "### Tool:", "### Role:", "</role>", "</turn>")
ROLES = {"system": 0, "user": 1, "assistant": 2, "tool": 3}
OTHER, ROLE_END, TURN_END = 4, 5, 6

_CONTROL = "|".join(map(re.escape, CONTROLS))
_ESCAPE = re.compile(rf"(\\*)({_CONTROL})")
_TAIL = re.compile(r"\\+\Z")


def escape(text: str) -> str:
    return _TAIL.sub(lambda m: m[0] * 2, _ESCAPE.sub(lambda m: m[1] * 2 + "\\" + m[2], text))


def unescape(text: str) -> str:
    body = _ESCAPE.sub(lambda m: m[1][: (len(m[1]) - 1) // 2] + m[2], text)
    return _TAIL.sub(lambda m: m[0][: len(m[0]) // 2], body)


def formatted(turns: Sequence[Tuple[str, str]]) -> str:
    """The string form of (role, text) turns."""
    out = []
    for role, text in turns:
        head = CONTROLS[ROLES[role]] if role in ROLES else CONTROLS[OTHER] + escape(role) + CONTROLS[ROLE_END]
        out.append(head + escape(text) + CONTROLS[TURN_END])
    return "".join(out)


def parse(string: str) -> List[Tuple[str, str]]:
    """The turns of a formatted string: controls after an even number of
    backslashes are the template's own."""
    turns, role, at = [], None, 0
    for m in _ESCAPE.finditer(string):
        if len(m[1]) % 2:
            continue
        control, text = CONTROLS.index(m[2]), string[at:m.start(2)]
        at = m.end()
        if control == TURN_END:
            turns.append((role, unescape(text)))
        elif control == ROLE_END:
            role = unescape(text)
        elif control != OTHER:
            role = next(r for r, c in ROLES.items() if c == control)
    return turns


class ChatTokenizer:
    """Lossless text ids, and reserved ids above them for the controls."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(resolve(tokenizer))
        self.tok.encode_special_tokens = True
        self.base = self.tok.get_vocab_size(with_added_tokens=True)

    def encode(self, some: List[str]) -> List[List[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]

    def decode(self, ids: Sequence[int]) -> str:
        return self.tok.decode(list(ids), skip_special_tokens=False)


def _tokenizer(tokenizer: str) -> ChatTokenizer:
    return worker_state(("chat", tokenizer), lambda: ChatTokenizer(tokenizer))


SEGMENT = "conv_id long, turn long, role string, text string, ids array<int>, loss_mask array<byte>, n_ids long, n_chars long"


def format_conversations(rows: DataFrame, tokenizer: str = BYTE_BPE, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """One segment per row of ``rows`` (conv_id, turn, role, text), to be read
    in the order of ``position``: conv_id, position, turn, role, ids,
    loss_mask, token_start, char_start, n_ids, n_chars.

    The mask covers the texts of ``trained`` roles, not the controls. A null
    text or role counts as empty; any other role is spelled out between two
    controls. Turns are ordered by turn, then role, text; a null turn comes
    first; repeated rows all stay. Rows without conv_id are one conversation.
    An empty table gives no rows; other columns are ignored. A conversation's
    rows are only sorted together, never held together.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for b in slices(batches, 512):
            roles, plain = b.column(2).to_pylist(), b.column(3).to_pylist()
            texts_, names = [escape(t) for t in plain], [r if r in ROLES else escape(r) for r in roles]
            odd = [i for i, r in enumerate(roles) if r not in ROLES]
            encoded = tok.encode(texts_ + [names[i] for i in odd])
            spelled = dict(zip(odd, encoded[len(texts_):]))
            ids, begins, ends, chars = [], [], [], []
            for i, role in enumerate(roles):
                if role in ROLES:
                    head, length = [tok.base + ROLES[role]], len(CONTROLS[ROLES[role]])
                else:
                    head = [tok.base + OTHER, *spelled[i], tok.base + ROLE_END]
                    length = len(CONTROLS[OTHER]) + len(names[i]) + len(CONTROLS[ROLE_END])
                ids.append(np.array([*head, *encoded[i], tok.base + TURN_END], dtype=np.int32))
                begins.append(len(head))
                ends.append(len(head) + len(encoded[i]))
                chars.append(length + len(texts_[i]) + len(CONTROLS[TURN_END]))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in ids])]).astype(np.int32)
            step = np.zeros(int(offsets[-1]) + 1, dtype=np.int8)
            on = np.array([r in trained for r in roles], dtype=bool)
            np.add.at(step, (offsets[:-1] + begins)[on], 1)
            np.add.at(step, (offsets[:-1] + ends)[on], -1)
            mask = np.cumsum(step, dtype=np.int8)[:-1]
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(mask, pa.int8())), pa.array(np.diff(offsets).astype(np.int64)),
                 pa.array(chars, pa.int64())],
                ["conv_id", "turn", "role", "text", "ids", "loss_mask", "n_ids", "n_chars"])

    source = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (arrow_map(source, segments, SEGMENT)
            .withColumn("position", F.count(F.lit(1)).over(order) - 1)
            .withColumn("token_start", F.sum("n_ids").over(order) - F.col("n_ids"))
            .withColumn("char_start", F.sum("n_chars").over(order) - F.col("n_chars")).drop("text"))


def read_conversations(segments: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """Digests of each conversation, decoded from the ids alone: conv_id,
    n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars,
    loss_sha256 (the text under the mask), formatted_chars. Segments stream
    by in order; a task holds the running digests of one conversation."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        roles = {c: r for r, c in ROLES.items()}
        done: List[tuple] = []
        at, state = None, None

        def row():
            n, turns, chars, loss, length = state
            return (at[0] if at[1] else None, n, turns.hexdigest(), chars, loss.hexdigest(), length)

        def batch(some):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], k) for i, k in enumerate(kinds)],
                                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for key, part in runs(batches, ["conv_key", "has_id"]):
            if key != at:
                if state:
                    done.append(row())
                at, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for ids, mask in zip(part["ids"], part["loss_mask"]):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                first = int(ids[0]) - tok.base
                head = 1 if first != OTHER else int(np.flatnonzero(ids == tok.base + ROLE_END)[0]) + 1
                spelled = "" if first != OTHER else tok.decode(ids[1:head - 1])
                role = roles[first] if first != OTHER else unescape(spelled)
                body = tok.decode(ids[head:-1])
                under = ids[mask == 1]
                trained = unescape(tok.decode(under)) if len(under) else ""
                state[0] += 1
                state[1].update(f"{role}\n{unescape(body)}\n".encode())
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += len(CONTROLS[first]) + (len(spelled) + len(CONTROLS[ROLE_END]) if first == OTHER else 0) + len(body) + len(CONTROLS[TURN_END])
            if len(done) >= 5000:
                yield batch(done)
                done = []
        if state:
            done.append(row())
        yield batch(done)

    keyed = (segments.select(F.coalesce("conv_id", F.lit(0)).alias("conv_key"), F.col("conv_id").isNotNull().cast("int").alias("has_id"),
                             "position", "ids", "loss_mask")
             .repartition("conv_key", "has_id").sortWithinPartitions("conv_key", "has_id", "position"))
    return arrow_map(keyed, digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
