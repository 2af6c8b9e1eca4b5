"""What only a task that reads a file in order can tell about its lines.

Spark cuts a file into pieces and hands each to one task, in order. Within a piece, plain
counting gives every line its number, and a two-state scan tells where records start. A piece
that begins inside a quoted cell cannot know it, so both cases are kept until the pieces of a
file are put side by side.

Quotes are looked at as whole arrays: where each of them stands at the border of a cell or next to another one, a line
changes the state if it has an odd number of them, and separators are outside of quotes where an even number stands before
them. Only lines with a quote elsewhere go through patterns one by one.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The bytes that code page 1252 leaves undefined.
CP1252_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)

PIECE_SCHEMA = (
    "file_path string, block bigint, utf8 boolean, undefined_1252 boolean, opens boolean, "
    "ends_open_if_closed boolean, ends_open_if_open boolean, records_if_closed bigint, records_if_open bigint, "
    "stray_if_closed boolean, stray_if_open boolean, header_line bigint, header binary, fields bigint, data_lines bigint"
)
LINE_SCHEMA = (
    "file_path string, block bigint, line_no bigint, record_if_closed bigint, record_if_open bigint, value binary"
)


Patterns = tuple[re.Pattern[bytes], re.Pattern[bytes]]


def _patterns(separator: bytes) -> tuple[Patterns, Patterns]:
    """Lines that end outside quotes, and lines without text behind a closing quote; each having begun outside and inside."""
    other = b"[^" + separator + b"]*"
    quoted = b'(?:[^"]|"")*+"'
    plain = b'[^"' + separator + b"]" + other
    cell = b'(?:"' + quoted + other + b"|" + plain + b"|)"
    cells = cell + b"(?:" + separator + cell + b")*"
    rest = quoted + other + b"(?:" + separator + cell + b")*"
    bare = b'(?:"' + quoted + b"|" + plain + b"|)"
    left_open = b'"(?:[^"]|"")*+'
    clean = b"(?:" + bare + separator + b")*(?:" + left_open + b"|" + bare + b")"
    clean_rest = b'(?:[^"]|"")*+(?:"(?:' + separator + clean + b")?)?"
    ends = re.compile(cells, re.DOTALL), re.compile(rest, re.DOTALL)
    return ends, (re.compile(clean, re.DOTALL), re.compile(clean_rest, re.DOTALL))


_PATTERNS = {sep: _patterns(sep.encode()) for sep in (",", "\t")}
_QUOTE = ord('"')


def separator_of(path: str) -> str:
    return "," if path.lower().endswith(".csv") else "\t"


class _Quotes:
    """The quotes of some lines, as arrays. Index 0 is for lines that begin outside quotes, 1 for those that begin inside."""

    def __init__(self, lines: pa.Array, separator: str):
        self.lines, self.separator = lines, separator
        content, bounds = _content(lines)
        at = np.flatnonzero(content == _QUOTE)
        line = np.searchsorted(bounds, at, side="right") - 1
        self.count = np.bincount(line, minlength=len(lines))
        first = np.cumsum(self.count) - self.count
        odd_place = (np.arange(len(at)) - first[line]) % 2 == 1
        at_start, at_end = at == bounds[line], at + 1 == bounds[line + 1]
        before, after = content[at - 1], content[np.minimum(at + 1, max(len(content) - 1, 0))]
        sep = ord(separator)
        opens = at_start | (before == sep) | (before == _QUOTE)
        closes = at_end | (after == sep) | (after == _QUOTE)
        self.odd = self.count % 2 == 1
        self.regular, self.stray = [], []
        for opener in (~odd_place, odd_place):
            regular = np.bincount(line[opener & ~opens], minlength=len(lines)) == 0
            self.regular.append(regular)
            self.stray.append(regular & (np.bincount(line[~opener & ~closes], minlength=len(lines)) > 0))
        self._at, self._first, self._content, self._bounds = at, first, content, bounds
        #: Lines that may change the state, or that only the patterns can judge.
        self.events = [np.flatnonzero((self.count > 0) & (self.odd | ~regular)) for regular in self.regular]
        self._ends, self._clean = _PATTERNS[separator]

    def after(self, i: int, inside: bool) -> bool:
        """Whether line ``i`` ends inside quotes."""
        if self.regular[inside][i]:
            return bool(self.odd[i]) != inside
        return self._ends[inside].fullmatch(self.lines[int(i)].as_py()) is None

    def has_stray(self, begins_inside: np.ndarray) -> bool:
        """Whether text follows a closing quote in any line."""
        for inside in (0, 1):
            own = begins_inside == bool(inside)
            if (self.stray[inside] & own).any():
                return True
            for i in np.flatnonzero(own & ~self.regular[inside]):
                if self._clean[inside].fullmatch(self.lines[int(i)].as_py()) is None:
                    return True
        return False

    def fields(self) -> np.ndarray:
        """The number of cells of each line, begun outside quotes."""
        at = np.flatnonzero(self._content == ord(self.separator))
        line = np.searchsorted(self._bounds, at, side="right") - 1
        outside = (np.searchsorted(self._at, at) - self._first[line]) % 2 == 0
        cells = np.bincount(line[outside], minlength=len(self.lines)) + 1
        for i in np.flatnonzero(~self.regular[0]):
            cells[i] = len(next(csv.reader([self.lines[int(i)].as_py().decode("latin-1")], delimiter=self.separator), []))
        return cells


@dataclass
class _Walk:
    """Quote state and record count from one assumed state at the start of a piece."""

    open: bool
    records: int = 0
    stray: bool = False

    def step(self, quotes: _Quotes) -> np.ndarray:
        """Record number of each line. Only the lines that may change the state are visited."""
        n = len(quotes.lines)
        inside = np.empty(n, dtype=bool)
        low = 0
        while low < n:
            events = quotes.events[self.open]
            at = int(np.searchsorted(events, low))
            stop = int(events[at]) if at < len(events) else n
            inside[low : stop + 1] = self.open
            if stop < n:
                self.open = quotes.after(stop, self.open)
            low = stop + 1
        self.stray = self.stray or quotes.has_stray(inside)
        numbers = self.records + np.cumsum(~inside)
        if len(numbers):
            self.records = int(numbers[-1])
        return numbers


@dataclass
class _Piece:
    path: str
    block: int
    lines: int = 0
    closed: _Walk = field(default_factory=lambda: _Walk(open=False))
    opened: _Walk = field(default_factory=lambda: _Walk(open=True))
    opens: bool = False
    utf8: bool = True
    undefined_1252: bool = False
    header_line: int | None = None
    header: bytes | None = None
    fields: int = 0
    data_lines: int = 0


@dataclass
class _Chunk:
    piece: _Piece
    first: int
    values: pa.Array
    quotes: _Quotes
    if_closed: np.ndarray
    if_open: np.ndarray


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Batches cut where the file or the piece changes."""
    piece: _Piece | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        paths, blocks, values = (batch.column(i) for i in range(3))
        ids = pc.dictionary_encode(paths).indices.to_numpy(zero_copy_only=False)
        offsets = blocks.to_numpy(zero_copy_only=False)
        changed = np.flatnonzero((ids[1:] != ids[:-1]) | (offsets[1:] != offsets[:-1])) + 1
        for low, high in zip([0, *changed], [*changed, batch.num_rows]):
            path, block = paths[low].as_py(), int(offsets[low])
            if piece is None or (piece.path, piece.block) != (path, block):
                piece = _Piece(path, block)
            lines = values.slice(low, high - low)
            quotes = _Quotes(lines, separator_of(path))
            ahead = piece.opened.records - piece.closed.records
            same, stray = piece.opened.open == piece.closed.open, piece.opened.stray
            if_closed = piece.closed.step(quotes)
            if same:  # both cases have met: from here on they differ in the number alone
                if_open = if_closed + ahead
                piece.opened = _Walk(piece.closed.open, piece.closed.records + ahead, stray or piece.closed.stray)
            else:
                if_open = piece.opened.step(quotes)
            # Fewer records than lines: some line was left with an open quote.
            piece.opens |= piece.closed.open or piece.closed.records < piece.lines + len(lines)
            yield _Chunk(piece, piece.lines, lines, quotes, if_closed, if_open)
            piece.lines += len(lines)


def _content(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the lines as one array, without copying, and where in it each line begins and the last one ends."""
    width = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
    _, offsets, data = lines.buffers()
    if data is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(lines) + 1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=width)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


_LINE_END = re.compile(rb"\r\n|\n|\r")


def lines_of_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file_path, content`` to lines with their bytes, one piece per content; a line end at the end ends the last line."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            lines = _LINE_END.split(content.as_py() or b"")
            if not lines[-1]:
                lines.pop()
            n = len(lines)
            if n:
                columns = [pa.repeat(pa.scalar(path, pa.string()), n), pa.repeat(pa.scalar(0, pa.int64()), n), pa.array(lines, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["file_path", "block", "value"])


def _is_utf8(lines: pa.Array) -> bool:
    try:
        lines.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


def _observe(chunk: _Chunk, skip: int) -> None:
    piece, lines = chunk.piece, chunk.values
    content, _ = _content(lines)
    if (content >= 0x80).any():
        piece.utf8 = piece.utf8 and _is_utf8(lines)
        piece.undefined_1252 |= bool(np.isin(content, CP1252_UNDEFINED).any())

    separator = separator_of(piece.path)
    separators = pc.count_substring(lines, separator).to_numpy(zero_copy_only=False)
    text = pc.match_substring_regex(lines, r"[^\s]").to_numpy(zero_copy_only=False)
    # A line of separators only is a row of missing cells, not a blank line.
    rows = text | (separators > 0)
    if piece.block == 0:
        rows &= chunk.if_closed > skip
    at = np.flatnonzero(rows)
    if piece.block == 0 and piece.header is None and len(at):
        piece.header_line = chunk.first + int(at[0])
        piece.header = lines[int(at[0])].as_py()
        at = at[1:]
    if len(at):
        piece.data_lines += len(at)
        piece.fields = max(piece.fields, int(chunk.quotes.fields()[at].max()))


def describe_pieces(batches: Iterator[pa.RecordBatch], skip: int) -> Iterator[pa.RecordBatch]:
    """One row per piece of a file; ``skip`` records above the header do not count."""
    pieces: dict[tuple[str, int], _Piece] = {}
    for chunk in _chunks(batches):
        pieces[(chunk.piece.path, chunk.piece.block)] = chunk.piece
        _observe(chunk, skip)
    found = list(pieces.values())
    columns: list[tuple[str, pa.DataType, list]] = [
        ("file_path", pa.string(), [p.path for p in found]),
        ("block", pa.int64(), [p.block for p in found]),
        ("utf8", pa.bool_(), [p.utf8 for p in found]),
        ("undefined_1252", pa.bool_(), [p.undefined_1252 for p in found]),
        ("opens", pa.bool_(), [p.opens for p in found]),
        ("ends_open_if_closed", pa.bool_(), [p.closed.open for p in found]),
        ("ends_open_if_open", pa.bool_(), [p.opened.open for p in found]),
        ("records_if_closed", pa.int64(), [p.closed.records for p in found]),
        ("records_if_open", pa.int64(), [p.opened.records for p in found]),
        ("stray_if_closed", pa.bool_(), [p.closed.stray for p in found]),
        ("stray_if_open", pa.bool_(), [p.opened.stray for p in found]),
        ("header_line", pa.int64(), [p.header_line for p in found]),
        ("header", pa.binary(), [p.header for p in found]),
        ("fields", pa.int64(), [p.fields for p in found]),
        ("data_lines", pa.int64(), [p.data_lines for p in found]),
    ]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in columns], names=[n for n, _, _ in columns])


def number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number, and the record they belong to in either case, within the piece."""
    for chunk in _chunks(batches):
        n = len(chunk.values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.repeat(pa.scalar(chunk.piece.path, pa.string()), n),
                pa.repeat(pa.scalar(chunk.piece.block, pa.int64()), n),
                pa.array(np.arange(chunk.first, chunk.first + n)),
                pa.array(chunk.if_closed),
                pa.array(chunk.if_open),
                chunk.values,
            ],
            names=["file_path", "block", "line_no", "record_if_closed", "record_if_open", "value"],
        )
