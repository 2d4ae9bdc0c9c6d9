"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

A block of texts is cut, on its bytes, at places where the tokenizer's own pattern always cuts.
Pieces are looked up by their 64-bit hash in a table that lives as long as the Python worker;
only new ones go through the tokenizer. Anything unusual (an apostrophe, a letter outside ASCII
and Latin-1) keeps its white-space-delimited run whole, and a text with unusual white space is
one piece, so the ids equal those of encoding the text as a whole.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa

from furlong.llm.spans import Index, column_bytes, hash_spans, row_starts
from furlong.llm.storage import give_back

#: Ids kept in the table of a worker; beyond, the table starts again.
TABLE_IDS = 8_000_000
#: Bytes of text cut into pieces at a time.
STEP = 1 << 21

_LETTER, _DIGIT, _OTHER, _SPACE = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}


_WRITTEN = _byte_letters()


def _follows(buf: np.ndarray, lead: int) -> np.ndarray:
    """Marks positions right after the byte `lead`."""
    out = np.zeros(len(buf), bool)
    out[1:] = buf[:-1] == lead
    return out


def _odd_space(buf: np.ndarray) -> np.ndarray:
    """Positions in white space outside ASCII, or controls that libraries class differently."""
    found = (buf >= 0x1C) & (buf <= 0x1F)
    for lead, seconds in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        if (buf == lead).any():
            found |= _follows(buf, lead) & np.isin(buf, seconds)
    return found


class Encoder:
    """One tokenizer file with its table of known pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        kind = (plan.get("pre_tokenizer") or {}).get("type")
        steps = [x.get("type") for x in (plan.get("normalizer") or {}).get("normalizers", [])]
        if plan.get("normalizer") is None and kind == "ByteLevel" and plan["pre_tokenizer"].get("use_regex"):
            self.kind = "bytes"
        elif kind == "Sequence" and "Lowercase" in steps and plan["pre_tokenizer"]["pretokenizers"][0].get("invert"):
            self.kind = "words"
        else:
            self.kind = "whole"
        self._clear()

    def _clear(self) -> None:
        self.index, self.flat, self.used = Index(), np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and how many lie before each row (n + 1)."""
        if self.used > TABLE_IDS:
            self._clear()
        buf, starts, ends, plain = self._pieces(buf, offsets)
        keys = hash_spans(buf, starts, ends)
        number = self.index.find(keys)
        if (new := np.flatnonzero(number < 0)).size:
            fresh, at = np.unique(keys[new], return_index=True)
            self._learn(buf, fresh, new[at], starts, ends, plain)
            number[new] = self.index.find(keys[new])
        lengths = self.lengths[number]
        before = np.zeros(len(number) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        where = np.repeat(self.starts[number] - before[:-1], lengths)
        where += np.arange(len(where))
        return self.flat[where], before[np.searchsorted(starts, offsets)]

    def _learn(self, buf, fresh, which, starts, ends, plain) -> None:
        rows: list[list[int]] = [[]] * len(which)
        model, odd = self.tokenizer.model, []
        for k, i in enumerate(which.tolist()):
            piece = buf[starts[i] : ends[i]].tobytes()
            if plain[i]:
                rows[k] = [t.id for t in model.tokenize(piece.decode("latin-1").translate(_WRITTEN))]
            else:
                odd.append((k, piece.decode("utf-8", "replace")))
        for (k, _), e in zip(odd, self.tokenizer.encode_batch([t for _, t in odd], add_special_tokens=False), strict=True):
            rows[k] = e.ids
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        have, total = self.index.count, self.used + int(lengths.sum())
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        while have + len(rows) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.starts, self.lengths))
        self.flat[self.used : total] = np.fromiter((t for r in rows for t in r), np.uint32, int(lengths.sum()))
        self.lengths[have : have + len(rows)] = lengths
        self.starts[have : have + len(rows)] = self.used + np.cumsum(lengths) - lengths
        self.used = total
        self.index.add(fresh)

    def _pieces(self, buf: np.ndarray, offsets: np.ndarray):
        """The bytes to look up, start and end of each piece, and which need no normalising."""
        n, edge = len(buf), row_starts(len(buf), offsets)
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        if not n:
            return buf, filled, filled, np.zeros(0, bool)
        kinds = _CLASS[buf]
        space = kinds == _SPACE
        if self.kind == "whole":
            strange = np.ones(len(filled), bool)
        else:
            strange = np.logical_or.reduceat(_odd_space(buf), filled)
        # Bytes that a run must not be split around: apostrophes, and what is not a letter of Latin-1.
        after = _follows(buf, 0xC3)
        latin = after & (buf != 0x97) & (buf != 0xB7)
        odd = (buf == 0x27) | ((buf >= 0x80) & (buf != 0xC3) & ~latin)
        start = np.zeros(n, bool)
        start[1:] = kinds[1:] != kinds[:-1]
        start |= edge[:-1]
        run = start.copy()  # runs of space and of anything else
        run[1:] = (space[1:] != space[:-1]) | edge[1:-1]
        run_at = np.flatnonzero(run)
        run_odd = np.logical_or.reduceat(odd, run_at)
        of_run = np.cumsum(run) - 1
        if run_odd.any():
            start &= ~(run_odd[of_run] & ~run)
        if self.kind == "words":
            start |= (kinds == _DIGIT) & ~run_odd[of_run]
            capital = after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97) | (buf >= 65) & (buf <= 90)
            buf = buf + np.where(capital & ~run_odd[of_run], 32, 0).astype(np.uint8)
            plain_at, keep = start, ~space
        else:
            # In a run of white space before more text the last blank joins what follows.
            last = np.zeros(n, bool)
            last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
            blank = last & (buf == 32)
            joined = np.zeros(n, bool)
            joined[1:] = blank[:-1]
            plain_at = (start & ~joined) | last
            keep = None
        at = np.flatnonzero(plain_at)
        ends = np.append(at[1:], n)
        if keep is not None:
            chosen = keep[at]
            at, ends = at[chosen], ends[chosen]
        body = np.minimum(ends - 1, n - 1)
        plain = ~run_odd[of_run[body]]
        if strange.any():
            row = np.searchsorted(filled, at, side="right") - 1
            good = ~strange[row]
            whole = np.flatnonzero(strange)
            row_end = np.append(filled[1:], n)
            at = np.concatenate([at[good], filled[whole]])
            ends, plain = np.concatenate([ends[good], row_end[whole]]), np.concatenate([plain[good], np.zeros(len(whole), bool)])
            order = np.argsort(at, kind="stable")
            at, ends, plain = at[order], ends[order], plain[order]
        return buf, at, ends, plain


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    """Drop the tokenizers of this Python worker and their tables. Workers live on from stage to stage,
    so tasks that follow the encoding and need none call this first."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        give_back()


def encode_column(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text followed by end_id, end to end, and where each row starts (n + 1)."""
    buf, offsets = column_bytes(column)
    parts, counts, i = [], [np.zeros(1, np.int64)], 0
    while i < len(offsets) - 1:  # rows of STEP bytes together, or one longer row
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
        ids, starts = encoder(path).encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append(np.insert(ids, starts[1:], np.uint32(end_id)))
        counts.append(np.diff(starts) + 1)
        i = j
    return np.concatenate(parts or [np.zeros(0, np.uint32)]), np.cumsum(np.concatenate(counts))
