"""Words of Arrow text columns as pointers into one byte buffer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Only A-Z are lower-cased; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: After lower-casing: bytes of letters and of code points from U+0080, and those or digits.
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[48:58] = True

#: MASK[k] keeps the first k of eight bytes.
MASK = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)


@dataclass
class Words:
    """Words of a column: where each starts, its bytes, and the row it is in."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    rows: np.ndarray
    first: np.ndarray  # number of words before each row, and of all rows

    def piece(self, which: np.ndarray, depth: int) -> np.ndarray:
        """The depth-th eight bytes of words as numbers in byte order; zero past the end."""
        left = np.clip(self.lengths[which] - 8 * depth, 0, 8)
        at = np.minimum(self.starts[which] + 8 * depth, len(self.data) - 8)
        eight = np.lib.stride_tricks.sliding_window_view(self.data, 8)[at]
        return eight.view(">u8").ravel().astype(np.uint64) & MASK[left]

    def text(self, which: np.ndarray) -> pa.Array:
        """Words as an Arrow string column."""
        lengths = self.lengths[which]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        from_here = np.repeat(self.starts[which] - offsets[:-1], lengths)
        held = self.data[from_here + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(
            len(which), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)
        ).cast(pa.string())


def words_of(column: pa.Array, letters: np.ndarray) -> Words:
    """The maximal runs of ``letters`` in lower-cased texts; null texts have none.

    Word bytes never split a code point, because every byte from 0x80 is a letter.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    held = column.buffers()[2]
    raw = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    size = int(offsets[-1] - offsets[0])
    data = np.zeros(size + 8, np.uint8)
    data[:size] = LOWER[raw[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = letters[data[:size]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # Texts stand next to each other in the buffer; words end with their text.
    edges = offsets[(offsets > 0) & (offsets < size)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    lengths = (np.flatnonzero(ends) + 1 - starts).astype(np.int32)
    first = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(first))
    return Words(data, starts, lengths, rows, first)
