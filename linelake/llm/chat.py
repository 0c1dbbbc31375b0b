"""Chat formatting: conversations as training text with a loss mask, assembled column by column.

A turn becomes `<s>` opening text closing `</s>`: for the system `<<SYS>>` text `<</SYS>>`, for a user `[INST]` text
`[/INST]`, for the assistant the bare text, and for any other role `[ROLE]` its name `[/ROLE]` text. In texts and names,
a backslash goes into each control string behind its first character (behind the ones that are there already), so no
text can end a turn, and taking one backslash out of each gives the text back. The loss mask has the places of the
assistant's texts.

Turns are dealt and sorted by conversation and turn. A task works on slices of whole conversations: lengths of all
headers and contents, their cumulative sums, and from these the place of every byte, by which headers and contents are
copied into one buffer that Arrow takes over. Contents are cut where a backslash goes in.

A conversation of up to RUN turns (by their numbers) stays in one range of the sort; longer ones may lie in several and are written
as chunks: rows of one conversation whose texts, in the order of `chunk`, are its text. Nothing holds more than a slice
of turns (SLICE_BYTES) or one turn.

Defined results: a null or empty text is empty; a null role is a role with an empty name; turns without a number come
first; rows of one turn go by role and text, repeated rows one after the other; rows without a conversation are one
conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import SLICE_BYTES, materialize, table

RUN = 4096

TAILS = ("s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "ROLE]", "/ROLE]")  # of control strings, behind < or [
_tail = "|".join(map(regex.escape, TAILS)).encode()
#: The first character of a control string with any number of backslashes; looked ahead, so matches may overlap.
_control = regex.compile(rb"[<\[](?=(\\*(?:" + _tail + rb")))")
_escaped = regex.compile(rb"([<\[])\\(?=\\*(?:" + _tail + rb"))")
_turn = regex.compile(rb"<s>(?:(<<SYS>>|\[INST\])|\[ROLE\](.*?)\[/ROLE\])?(.*?)(?:<</SYS>>|\[/INST\])?</s>", regex.DOTALL)

PLAIN = {"system": (b"<s><<SYS>>", b"<</SYS>></s>"), "user": (b"<s>[INST]", b"[/INST]</s>"), "assistant": (b"<s>", b"</s>")}
ROLES = {b"<<SYS>>": b"system", b"[INST]": b"user"}


def escape(text: bytes) -> bytes:
    return _control.sub(lambda m: m.group() + b"\\", text)


def unescape(text: bytes) -> bytes:
    return _escaped.sub(rb"\1", text)


def turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of each turn."""
    out = []
    for m in _turn.finditer(formatted):
        role = ROLES[m.group(1)] if m.group(1) else unescape(m.group(2)) if m.group(2) is not None else b"assistant"
        out.append((role, unescape(m.group(3))))
    return out


class Headers(dict):
    """Role to its number; the bytes of all openings and closings in a row, and where each begins."""

    def __init__(self):
        super().__init__()
        self.parts: list[bytes] = []

    def __missing__(self, role: str | None) -> int:
        opening, closing = PLAIN.get(role) or (b"<s>[ROLE]" + escape((role or "").encode()) + b"[/ROLE]", b"</s>")
        number = self[role] = len(self.parts) // 2
        self.parts += [opening, closing]
        return number


def copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy pieces of source (start, length) to their places in out."""
    each = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + each] = source[np.repeat(start, length) + each]


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns formatted, where each turn begins (and the last ends), and where its text does."""
    headers = Headers()
    own = np.fromiter((headers[r] for r in role.to_pylist()), np.int64, len(role))
    fixed = np.frombuffer(b"".join(headers.parts), np.uint8)
    size = np.array([len(p) for p in headers.parts], np.int64)
    begin = np.cumsum(size) - size
    text = pa.concat_arrays([pa.compute.fill_null(text, "").cast(pa.binary())])  # one array from offset 0
    ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1 + text.offset)[text.offset :].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    low, high = int(ends[0]), int(ends[-1])
    found = [(m.start() + 1, m.end(1)) for m in _control.finditer(data[low:high].tobytes())]
    cut = np.array(found, np.int64).reshape(-1, 2) + low
    row = np.searchsorted(ends, cut[:, 0], side="left") - 1  # the row of the character before the cut
    inside = cut[:, 1] <= ends[row + 1]  # what reaches into the next text is no control string
    cut, row = cut[inside, 0], row[inside]
    length = np.diff(ends) + np.bincount(row, minlength=len(text))
    # a turn is opening, text, closing
    whole = np.stack([size[2 * own], length, size[2 * own + 1]], 1)
    place = np.append(0, np.cumsum(whole.ravel()))
    total = int(place[-1])
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    opening, content, closing = place[:-1].reshape(-1, 3).T
    copy(out, opening, fixed, begin[2 * own], size[2 * own])
    copy(out, closing, fixed, begin[2 * own + 1], size[2 * own + 1])
    # texts in pieces: a piece behind a cut is moved on by the backslashes of its row so far
    at = np.concatenate([ends[:-1], cut])
    of = np.concatenate([np.arange(len(text)), row])
    order = np.lexsort((np.concatenate([np.zeros(len(text)), np.ones(len(cut))]), at, of))
    at, of, new = at[order], of[order], (order >= len(text)).astype(np.int64)
    many = np.cumsum(new)
    before = many[np.searchsorted(of, of, side="left")]  # a row's first piece is no cut
    stop = np.where(np.append(of[1:] == of[:-1], False), np.append(at[1:], 0), ends[of + 1])
    to = content[of] + at - ends[of] + many - before
    copy(out, to, data, at, stop - at)
    out[to[new == 1] - 1] = ord("\\")
    return buffer, np.append(opening, total), content, content + length


SCHEMA = "conv_id long, chunk long, edge boolean, n_turns long, text string, loss array<struct<start: long, end: long>>"


class Slices:
    """Slices of sorted turns, of whole conversations where they aren't larger than a slice."""

    def __init__(self, most: int):
        self.most, self.part, self.number = most, TaskContext.get().partitionId(), 0
        self.held: list[pa.RecordBatch] = []
        self.size, self.open = 0, True  # open: the first conversation may have begun elsewhere

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(3)), 0), np.int64) + 64
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, base + self.most - self.size, side="right")))
            self.held.append(batch.slice(at, to - at))
            self.size += int(ends[to - 1] - base)
            at = to
            if self.size >= self.most or at < batch.num_rows:
                yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        rows = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
        ids = rows.column(0)
        code = np.asarray(pa.compute.fill_null(ids, 0)) * 2 + np.asarray(ids.is_null())
        first = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
        self.held, self.size = [], 0
        cut = bool(not last and len(first) == 1)  # one conversation fills the slice: it goes on in the next chunk
        n = rows.num_rows if last or cut else int(first[-1])
        if n < rows.num_rows:
            self.held = [rows.slice(n)]
            self.size = int(sum(x or 0 for x in pa.compute.binary_length(self.held[0].column(3)).to_pylist())) + 64 * (rows.num_rows - n)
        yield self.chunks(rows.slice(0, n), first[first < n], last, cut)

    def chunks(self, rows: pa.RecordBatch, first: np.ndarray, last: bool, cut: bool) -> pa.RecordBatch:
        buffer, begin, content, stop = assemble(rows.column(2), rows.column(3))
        edge = np.zeros(len(first), bool)
        edge[0] = self.open
        edge[-1] |= last or cut
        self.open = cut
        ends = np.append(begin[first], begin[rows.num_rows])
        loss = np.flatnonzero(np.asarray(pa.compute.fill_null(pa.compute.equal(rows.column(2), "assistant"), False)))
        of = np.searchsorted(first, loss, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(content[loss] - ends[of]), pa.array(stop[loss] - ends[of])], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(first) + 1)), pa.int32()), spans)
        text = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), buffer])
        numbers = (self.part << 33) + self.number + np.arange(len(first))
        self.number += len(first)
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first)), pa.array(numbers), pa.array(edge), pa.array(np.diff(np.append(first, rows.num_rows))), text, lists], ["conv_id", "chunk", "edge", "n_turns", "text", "loss"])


def format_chat(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """conv_id, chunk, edge, n_turns, text, loss (byte ranges in the text). A row without `edge` is a whole conversation;
    one with it may be a part of one, whose parts are in the order of `chunk`."""
    turn = F.col(turn_col).cast("long")
    own = rows.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    run = F.expr(f"turn div {RUN}")
    dealt = own.withColumn("run", run).repartitionByRange("conv_id", "run").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text")

    def work(batches):
        state = Slices(most)
        for batch in batches:
            yield from state.rows(batch)
        yield from state.flush(True)

    return dealt.mapInArrow(work, SCHEMA)


def characters(text: bytes) -> int:
    data = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation of formatted rows in order, whose parts follow each other."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches):
        now, some = None, False
        n = loss_chars = chars = 0
        every = loss = None

        def row():
            return (now, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars)

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2)):
                if not some or conv != now:
                    if some:
                        rows.append(row())
                    now, some, n, loss_chars, chars = conv, True, 0, 0, 0
                    every, loss = hashlib.sha256(), hashlib.sha256()
                data = text.as_py()
                chars += characters(data)
                for role, own in turns(data):
                    n += 1
                    every.update(role + b"\n" + own + b"\n")
                for span in spans.as_py():
                    own = unescape(data[span["start"] : span["end"]])
                    loss_chars += characters(own)
                    loss.update(own)
            if rows:
                yield out(rows)
        if some:
            yield out([row()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "text", "loss").mapInArrow(work, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of a stored result of format_chat. Only
    edges are shuffled, of which there are two a task, and the chunks of long conversations."""
    edges = formatted.filter("edge").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return _digests(formatted.filter("not edge")).unionByName(_digests(edges))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(materialize(format_chat(rows.unionByName(more)), "formatted"))
