"""Chat formatting: a hidden Markov model over the lines of a transcript.

The hidden state of a line is a role together with whether the line begins a
turn. A line is observed as its speaker marker (the word before a colon, a
heading or a bracketed name, or none), its length class, its ending and whether
it follows an empty line. Start, transition and observation probabilities are
counted on labelled transcripts, by the tasks that hold them, so only the sums
(224 numbers) reach the driver; Viterbi recovers the roles, and turns are rendered
in one canonical form.

Conversations whose crc32(conv_id) mod 5 is 0 are held out: the model never counts
them, and ``n_right`` on them says how well it does on new ones.

A conversation is decoded as a whole, as a stream of its sorted turns, and is one
row. So it must fit a cell, and a task holds one at a time.

Defined results: null text is an empty turn; turns with a null number come
first; equal rows (same conversation, turn, role and text) count once; turns of
one number are ordered by role and text; null conv_ids are one conversation, which
is not held out; an unknown or null role counts as user; an empty table gives an
empty table; other columns are ignored. Texts are whole and come back to the byte,
white space included, if the turns are found. In the canonical form a marker within
a text is escaped by a backslash (``escape``, ``unescape``), so no text can open a
turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

ROLES = ("system", "user", "assistant", "tool")
FOLDS, HELD_OUT = 5, 0  # conversations whose crc32(id) mod FOLDS is HELD_OUT are never counted
MARKER = re.compile(r"^\s*(?:#{1,6}\s*|\*\*|\[|<\|?|>\s*)?([A-Za-z]{1,16})(?:\s+\d+)?(?:\*\*|\]|\|?>)?\s*?(:|(?<=[\]>])|$)", re.ASCII)
ROWS_BYTES = 1 << 20  # of rendered conversations handed on at once, unless one is longer
MARKED = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
# Speaker names in transcripts.
SPEAKERS = {
    "system": ("system", "context", "instructions", "sys"),
    "user": ("user", "human", "question", "customer", "me", "q", "you"),
    "assistant": ("assistant", "ai", "answer", "agent", "bot", "a", "model", "gpt"),
    "tool": ("tool", "function", "result", "observation"),
}
KNOWN = {name: role for role, names in SPEAKERS.items() for name in names}
#: Ways to mark a speaker; a transcript keeps to one.
STYLES = ("{n}: ", "### {n}:\n", "[{n}] ", "**{n}**: ", "<|{n}|>\n", "{n}:\n")


def marker(line: str) -> tuple[str | None, str, bool]:
    """(role that the line's marker names, rest of the line, whether the text begins on this line).

    One blank after the marker belongs to it.
    """
    m = MARKER.match(line)
    if m and (role := KNOWN.get(m[1].lower())) and (m[2] == ":" or re.match(r"^\s*(?:#|\*\*|\[|<)", line)):
        rest = line[m.end() :]
        return role, rest[1:] if rest[:1] in (" ", "\t") else rest, bool(rest)
    return None, line, True


def observe(lines: list[str]) -> np.ndarray:
    """Codes of each line: marker, length class, ending, after an empty line."""
    out = np.zeros((len(lines), 4), dtype=np.int64)
    for i, line in enumerate(lines):
        role, rest, _ = marker(line)
        out[i] = (
            ROLES.index(role) + 1 if role else 0,
            min(7, len(rest).bit_length()),
            3 if not rest.strip() else {"?": 1, ":": 2}.get(rest.rstrip()[-1], 0),
            i == 0 or not lines[i - 1].strip(),
        )
    return out


SIZES = (len(ROLES) + 1, 8, 4, 2)
STATES = 2 * len(ROLES)  # role * 2 + (0: begins a turn, 1: goes on)


class Hmm:
    """Log-probabilities by counting, with a little mass everywhere (``prior``) or none."""

    def __init__(self, prior: bool = True):
        if not prior:
            self.start, self.move, self.emit = np.zeros(STATES), np.zeros((STATES, STATES)), [np.zeros((STATES, n)) for n in SIZES]
            return
        self.start = np.full(STATES, 0.1)
        self.move = np.full((STATES, STATES), 0.1)
        self.emit = [np.full((STATES, n), 0.1) for n in SIZES]
        for r in range(len(ROLES)):
            self.start[2 * r + 1] = 1e-9  # a transcript begins with a turn
            for s in range(STATES):
                if s // 2 != r:
                    self.move[s, 2 * r + 1] = 1e-9  # only its own turn goes on
            for k in range(len(ROLES)):
                self.emit[0][2 * r + 1, k + 1] = 1e-3  # a marker begins a turn
                self.emit[0][2 * r, k + 1] += 5.0 if k == r else 0.0

    def count(self, codes: np.ndarray, states: list[int]) -> None:
        if not states:
            return
        self.start[states[0]] += 1
        for a, b in zip(states, states[1:], strict=False):
            self.move[a, b] += 1
        for k, e in enumerate(self.emit):
            np.add.at(e, (states, codes[:, k]), 1)

    def flat(self) -> np.ndarray:
        """All counts in one array."""
        return np.concatenate([self.start, self.move.ravel(), *[e.ravel() for e in self.emit]])

    def add(self, flat: np.ndarray) -> None:
        """Add counts as ``flat`` gives them."""
        cuts = np.cumsum([x.size for x in (self.start, self.move, *self.emit)])[:-1]
        for x, own in zip((self.start, self.move, *self.emit), np.split(flat, cuts), strict=True):
            x += own.reshape(x.shape)

    def done(self) -> Hmm:
        self.start = np.log(self.start / self.start.sum())
        self.move = np.log(self.move / self.move.sum(1, keepdims=True))
        self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in self.emit]
        return self

    def decode(self, codes: np.ndarray) -> list[int]:
        """The likeliest states (Viterbi)."""
        if not len(codes):
            return []
        p = sum(e[:, codes[:, k]] for k, e in enumerate(self.emit)).T
        best, back = self.start + p[0], []
        for q in p[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(0))
            best = step.max(0) + q
        s = int(best.argmax())
        out = [s]
        for b in reversed(back):
            s = int(b[s])
            out.append(s)
        return out[::-1]


def transcript(turns: list[tuple[str, str]], style: int) -> tuple[list[str], list[int]]:
    """Lines of a transcript and their states; ``style`` picks marks and names."""
    lines: list[str] = []
    states: list[int] = []
    shape = STYLES[style % len(STYLES)]
    for role, text in turns:
        role = role if role in ROLES else "user"
        names = SPEAKERS[role]
        name = names[(style // len(STYLES)) % min(4, len(names))]
        made = (shape.format(n=name.capitalize() if "<" not in shape else name) + (text or "")).split("\n")
        lines += made
        states += [2 * ROLES.index(role)] + [2 * ROLES.index(role) + 1] * (len(made) - 1)
    return lines, states


def parse(lines: list[str], model: Hmm) -> list[tuple[str, str]]:
    """(role, text) of the turns of a transcript."""
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, model.decode(observe(lines)), strict=True):
        if state % 2 == 0 or not turns:
            _, rest, here = marker(line)
            turns.append((ROLES[state // 2], [rest] if here else []))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(text)) for role, text in turns]


def escape(text: str) -> str:
    return MARKED.sub(r"<|\\\1\2|>", text)


def unescape(text: str) -> str:
    return re.sub(r"<\|\\(\\*)(im_start|im_end)\|>", r"<|\1\2|>", text)


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form of turns."""
    return "".join(f"<|im_start|>{role}\n{escape(text)}<|im_end|>\n" for role, text in turns)


def distinct_turns(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").distinct()


def _talks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
    """(conv_id, style, turns) of conversations whose turns arrive one after another; one at a time."""
    key, turns = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "style", "role", "text")]
        for conv, style, role, text in zip(*columns, strict=True):
            if (conv, style) != key:
                if key is not None:
                    yield *key, turns
                key, turns = (conv, style), []
            turns.append((role if role in ROLES else "user", text or ""))
    if key is not None:
        yield *key, turns


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's conversations, each in two styles."""
    model, any_ = Hmm(prior=False), False
    for _, style, turns in _talks(batches):
        any_ = True
        for own in (style, (style + 7) % 24):
            lines, states = transcript(turns, own)
            model.count(observe(lines), states)
    if any_:
        yield pa.RecordBatch.from_arrays([pa.array([model.flat()], pa.list_(pa.float64()))], names=["counts"])


def _sorted(conversations: DataFrame) -> DataFrame:
    """Turns with held_out and a style for each conversation, whole conversations in a task."""
    fold = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(FOLDS))
    t = distinct_turns(conversations).withColumn("style", F.pmod(F.xxhash64("conv_id"), F.lit(24)))
    t = t.withColumn("held_out", F.coalesce(fold == HELD_OUT, F.lit(False)))
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def train(conversations: DataFrame) -> Hmm:
    """A model counted on all labelled conversations that are not held out, in all styles."""
    rows = _sorted(conversations).where("NOT held_out").select("conv_id", "style", "role", "text")
    counts = map_arrow(rows, _count, "counts array<double>").select(F.posexplode("counts").alias("i", "n"))
    model, total = Hmm(), np.zeros(Hmm(prior=False).flat().size)
    for r in counts.groupBy("i").agg(F.sum("n").alias("n")).collect():  # one row a count
        total[r["i"]] = r["n"]
    model.add(total)
    if not total.any():
        talk = [("system", "Be brief."), ("user", "What is it?"), ("assistant", "A line.\nAnother line."), ("tool", "42")]
        for style in range(24):
            lines, states = transcript(talk, style)
            model.count(observe(lines), states)
    return model.done()


class _Parse:
    """Decodes whole conversations."""

    def __init__(self, model: Hmm):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "n_right", "roles", "text"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows, size = [], 0
        for conv, style, turns in _talks(batches):
            found = parse(transcript(turns, style)[0], self.model)
            right = sum(a[0] == b[0] for a, b in zip(turns, found, strict=True)) if len(found) == len(turns) else 0
            rows.append((conv, len(found), right, ",".join(r for r, _ in found), render(found)))
            size += len(rows[-1][-1])
            if size >= ROWS_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


def format_chats(conversations: DataFrame, model: Hmm | None = None) -> DataFrame:
    """conv_id, held_out, n_turns, n_right, roles and text of every conversation.

    The turns of the table are written as a transcript in a style chosen by the
    conversation's id, which hides their roles; the model recovers them.
    ``n_right`` counts the turns whose role was recovered.
    """
    model = model or train(conversations)
    rows = _sorted(conversations).select("conv_id", "style", "role", "text")
    fold = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(FOLDS))
    return map_arrow(rows, _Parse(model), "conv_id long, n_turns long, n_right long, roles string, text string").select(
        "conv_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "n_turns", "n_right", "roles", "text"
    )
