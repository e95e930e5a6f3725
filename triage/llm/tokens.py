"""Token ids of whole texts by a tokenizer file that cuts texts into runs of letters, runs of marks and digits.

The file lower-cases, drops white space, and never joins ids across the runs it cuts a text into. So
each distinct run is encoded once and remembered by its hash, and the ids of a text are put together
with numpy. That holds for texts of ASCII and Latin-1 letters, digits, marks and plain blanks; a text
with anything else (apostrophes, other scripts, odd blanks, special tokens) goes through the tokenizer whole.
"""

from __future__ import annotations

import numpy as np

from triage.llm import common as C

#: Runs remembered by a worker (about 40 bytes each); a memory that is full starts again.
KEPT = 500_000

_BLANK, _LETTER, _MARK, _DIGIT = 0, 1, 2, 3
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _BLANK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = _LETTER
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[0x80:0x9F] += 32  # the second bytes of the capital letters of Latin-1
#: Bytes that send a text through the tokenizer whole: controls, apostrophe, first bytes other than 0xC3, the signs × and ÷.
_OTHER = np.zeros(256, dtype=bool)
_OTHER[:0x20] = _OTHER[0x7F] = _OTHER[0x27] = _OTHER[0xC0:] = _OTHER[0x97] = _OTHER[0xB7] = True
_OTHER[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xC3]] = False


class RunTokenizer:
    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.end = end_id
        self.ends_word = np.zeros(self.model.get_vocab_size() + 1, dtype=bool)
        self.ends_word[[i for t, i in self.model.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes, sorted; for each where its ids are in flat
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, runs: list[str]) -> None:
        begins, lengths, flats, base = [], [], [self.flat], len(self.flat)
        for i in range(0, len(runs), 20_000):
            part = runs[i : i + 20_000]
            ids = np.array(self.model.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.uint32)
            cut = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cut) != len(part):
                raise ValueError("the tokenizer file doesn't end every run with a marked token")
            first = np.concatenate([[0], cut[:-1]])
            begins.append(first + base)
            lengths.append(cut - first)
            flats.append(ids)
            base += len(ids)
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.begin = np.concatenate([self.begin, *begins])[order]
        self.length = np.concatenate([self.length, *lengths])[order]
        self.flat = np.concatenate(flats)

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(hashes), dtype=bool)
        at = np.searchsorted(self.known, hashes)
        return self.known[np.minimum(at, len(self.known) - 1)] != hashes

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, each text's with the end id last; where each begins (n + 1 values)."""
        n = len(offsets) - 1
        other = _OTHER[raw]
        other[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        whole = np.unique(np.searchsorted(offsets, np.flatnonzero(other), side="right") - 1)
        kind = _CLASS[raw]
        first = (kind != _BLANK) & ((kind == _DIGIT) | (np.concatenate([[255], kind[:-1]]) != kind))
        at = offsets[:-1][np.diff(offsets) > 0]
        first[at] = kind[at] != _BLANK
        starts = np.flatnonzero(first)
        begin = np.searchsorted(starts, offsets)
        used = np.ones(len(starts), dtype=bool)
        for i in whole:
            used[begin[i] : begin[i + 1]] = False
        folded = _FOLD[raw]
        with np.errstate(over="ignore"):
            C._Powers.reach(len(raw))
            hashes = np.add.reduceat(np.where(kind == _BLANK, np.uint64(0), C._random_table(29)[folded]) * C._Powers.up[: len(raw)], starts) if len(starts) else np.zeros(0, np.uint64)
            hashes = C.mix(hashes * C._Powers.down[starts])
        distinct, where, back = np.unique(hashes[used], return_index=True, return_inverse=True)
        new = self._missing(distinct)
        if new.any():
            if len(self.known) + int(new.sum()) > KEPT:
                self._forget()
                new = np.ones(len(distinct), dtype=bool)
            text = folded.tobytes()
            a = starts[used][where[new]]
            following = np.concatenate([starts[1:], [len(raw)]])
            edge = following[used][where[new]]
            self._learn(distinct[new], [text[x:y].decode().rstrip() for x, y in zip(a.tolist(), edge.tolist())])
        slot = np.searchsorted(self.known, distinct)[back]
        size = np.zeros(len(starts) + 1, dtype=np.int64)
        size[:-1][used] = self.length[slot]
        total = np.concatenate([[0], np.cumsum(size[:-1])])
        span = self.length[slot]
        ids = self.flat[np.repeat(self.begin[slot] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))]
        per_text = total[begin[1:]] - total[begin[:-1]]
        slow = {int(i): np.array(e.ids, dtype=np.uint32) for i, e in zip(whole, self.model.encode_batch_fast([raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in whole], add_special_tokens=False))} if len(whole) else {}
        source = np.concatenate([[0], np.cumsum(per_text)])
        count = per_text + 1
        for i, got in slow.items():
            count[i] = len(got) + 1
        to = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(int(to[-1]), dtype=np.uint32)
        out[to[1:] - 1] = self.end
        if len(ids):
            out[np.repeat(to[:-1] - source[:-1], per_text) + np.arange(len(ids))] = ids
        for i, got in slow.items():
            out[to[i] : to[i] + len(got)] = got
        return out, to


_LOADED: dict[tuple, RunTokenizer] = {}


def worker_tokenizer(path: str, end_id: int) -> RunTokenizer:
    """One tokenizer for each Python worker, which Spark uses again for later tasks."""
    key = (path, end_id)
    if key not in _LOADED:
        _LOADED[key] = RunTokenizer(path, end_id)
    return _LOADED[key]
