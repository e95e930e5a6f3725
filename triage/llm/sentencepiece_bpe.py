"""Operator 11, SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

Merging the best pair first, again and again, has one result that can be told from its parts: a row of
tokens is the encoding of its text if and only if every two neighbours, merged anew from their characters
alone, come out as these two tokens again. So an encoder may walk from left to right: at each place it
takes the longest token there (all tokens that begin at a place come from an Aho-Corasick automaton over the
vocabulary) that is compatible with the token before, and goes back where none is. A place that was left that
way never has to be entered again, since the encoding of the text up to there was the only one: its bit is set
in a bitfield. Every place is left at most once, so the time is linear in the text.

Characters that no piece holds are tokens of their own and become the pieces of their UTF-8 bytes. Where the
vocabulary has no piece in which a blank mark follows another character, no token goes over the start of
a word. Then all new words of a batch are walked at once, a numpy step for each token, each with a 64-bit field of
failed places, and remembered (``KEPT`` at most); only words of more than ``WORD`` characters go one by one.
Memory follows the longest single text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C

MARK = "▁"
#: Words and pairs of tokens that a worker remembers, about; the oldest are forgotten. Longer words aren't remembered.
KEPT, PAIRS, WORD = 400_000, 1_000_000, 64
#: Characters that go through the automaton at a time.
WINDOW = 4096


def merged(text: str, score: dict[str, float]) -> list[str]:
    """Plain best-first merging of a short text: of all neighbours whose joint text is a piece, the pair of the highest score is joined, of equal ones the leftmost."""
    none = float("-inf")
    part = list(text)
    worth = [score.get(text[i : i + 2], none) for i in range(len(text) - 1)]
    while worth:
        best = max(worth)
        if best == none:
            break
        i = worth.index(best)
        part[i] += part.pop(i + 1)
        del worth[i]
        if i < len(worth):
            worth[i] = score.get(part[i] + part[i + 1], none)
        if i:
            worth[i - 1] = score.get(part[i - 1] + part[i], none)
    return part


class Encoder:
    """Ids of texts under a SentencePiece BPE model, as its library gives them."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        special = lambda i: m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        self.piece = {m.id_to_piece(i): i for i in ids if not special(i)}
        self.score = {p: m.get_score(i) for p, i in self.piece.items()}
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        held = {c for p in self.piece for c in p}
        #: Texts of tokens by number: the pieces, then the characters of pieces that are none themselves. Any other character has the number after these.
        self.text = [*self.piece, *sorted(held - self.piece.keys())]
        self.length = np.array([*map(len, self.text), 1], dtype=np.int64)
        self.id = np.array([*self.piece.values(), *[-1] * (len(self.text) + 1 - len(self.piece))], dtype=np.int64)
        self.longest = int(self.length.max())
        self.automaton = ahocorasick.Automaton()
        for n, p in enumerate(self.text):
            self.automaton.add_word(p, n)
        self.automaton.make_automaton()
        joined = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.piece)
        alone = "" if "\n" in held else "\n"
        #: A word is a run of blank marks with what follows; a line break that is in no piece stands alone.
        self.cut = None if joined else re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + ("|\n" if alone else ""))
        self.between = next(c for c in map(chr, (10, 0, *range(0xE000, 0xF8FF))) if c not in held)
        self.fits: dict[int, bool] = {}
        self.fit_keys, self.fit_values = np.zeros(0, np.int64), np.zeros(0, bool)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.begin, self.end = (np.array([i], dtype="<u4").tobytes() for i in (m.bos_id(), m.eos_id()))

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their text is merged from its characters; ``left`` is -1 at the start of a word."""
        key = (left + 1) * (len(self.text) + 2) + right
        got = self.fits.get(key)
        if got is None:
            if max(left, right) == len(self.text):
                got = True  # nothing merges with a character that is in no piece
            else:
                own = [self.text[t] for t in (left, right) if t >= 0]
                got = merged("".join(own), self.score) == own
            self.fits[key] = got
        return got

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left + 1) * (len(self.text) + 2) + right
        at = np.minimum(np.searchsorted(self.fit_keys, keys), max(0, len(self.fit_keys) - 1))
        known = self.fit_keys[at] == keys if len(self.fit_keys) else np.zeros(len(keys), bool)
        out = self.fit_values[at] if len(self.fit_keys) else np.zeros(len(keys), bool)
        if not known.all():
            new, back = np.unique(keys[~known], return_inverse=True)
            out[~known] = np.array([self.compatible(int(k // (len(self.text) + 2)) - 1, int(k % (len(self.text) + 2))) for k in new.tolist()], dtype=bool)[back]
            if len(self.fits) > max(5_000, len(self.fit_keys) // 10):
                self._settle()
        return out

    def _settle(self) -> None:
        """Known pairs become one sorted array; if they are too many, the newer ones alone."""
        keys, values = np.fromiter(self.fits.keys(), np.int64, len(self.fits)), np.fromiter(self.fits.values(), bool, len(self.fits))
        if len(self.fit_keys) + len(keys) <= PAIRS:
            keys, values = np.concatenate([self.fit_keys, keys]), np.concatenate([self.fit_values, values])
        self.fit_keys, first = np.unique(keys, return_index=True)
        self.fit_values = values[first]
        self.fits = {}

    def _matches(self, text: str, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, first): the tokens that begin at each place of [begin, stop), shorter ones first, and where each place's begin among them."""
        found = np.fromiter(self.automaton.iter(text, begin, min(len(text), stop + self.longest)), dtype=[("last", np.int64), ("token", np.int64)])
        token, size = found["token"], self.length[found["token"]]
        place = found["last"] + 1 - size - begin
        here = place < stop - begin
        token, size, place = token[here], size[here], place[here]
        odd = np.ones(stop - begin, dtype=bool)
        odd[place[size == 1]] = False
        odd = np.flatnonzero(odd)
        token, place = np.concatenate([np.full(len(odd), len(self.text)), token]), np.concatenate([odd, place])
        order = np.argsort(place, kind="stable")  # matches come by their ends, so those of a place are in order
        return token[order], np.concatenate([[0], np.cumsum(np.bincount(place, minlength=stop - begin))])

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words of ``WORD`` characters at most, by backtracking in all of them at once."""
        text = self.between.join(words) + self.between
        size = np.array([len(w) for w in words], dtype=np.int64)
        begin = np.cumsum(size + 1) - size - 1
        token, first = self._matches(text, 0, len(text))
        place, end, depth = begin.copy(), begin + size, np.zeros(len(words), np.int64)
        before, failed = np.full(len(words), -1), np.zeros(len(words), np.uint64)
        taken = np.zeros((len(words), int(size.max())), dtype=np.int64)
        at = first[place + 1] - 1  # the token to try next, from the longest down
        live = np.arange(len(words))
        while len(live):
            here, try_at = place[live], at[live]
            left = try_at >= first[here]
            w, t = live[left], token[try_at[left]]
            to = place[w] + self.length[t]
            open_ = (failed[w] >> (to - begin[w] - 1).astype(np.uint64) & np.uint64(1)) == 0
            good = open_.copy()
            good[open_] = self._compatible(before[w[open_]], t[open_])
            go, stay = w[good], w[~good]
            taken[go, depth[go]] = try_at[left][good]
            depth[go] += 1
            before[go], place[go] = t[good], to[good]
            at[go] = first[place[go] + 1] - 1
            at[stay] -= 1
            back = live[~left]
            if len(back):
                if (depth[back] == 0).any():
                    raise ValueError("the vocabulary has no encoding for a text")
                failed[back] |= np.uint64(1) << (place[back] - begin[back] - 1).astype(np.uint64)
                depth[back] -= 1
                last = taken[back, depth[back]]
                place[back] -= self.length[token[last]]
                at[back] = last - 1
                before[back] = np.where(depth[back] > 0, token[taken[back, np.maximum(depth[back] - 1, 0)]], -1)
            live = live[place[live] < end[live]]
        used = np.arange(taken.shape[1])[None, :] < depth[:, None]
        ids = self.id[token[taken[used]]]
        stop = np.cumsum(depth)
        blob, edges = ids.astype("<u4").tobytes(), [0, *(4 * stop).tolist()]
        out = [blob[a:b] for a, b in zip(edges[:-1], edges[1:])]
        for i in np.unique(np.searchsorted(stop, np.flatnonzero(ids < 0), side="right")).tolist():
            out[i] = self._spelt(words[i], token[taken[i, : depth[i]]].tolist())
        return out

    def _spelt(self, text: str, tokens: list[int]) -> bytes:
        """The ids of tokens of a text; a token without an id becomes the pieces of its bytes."""
        out, place = [], 0
        for t in tokens:
            n = int(self.length[t])
            own = int(self.id[t])
            out.extend([own] if own >= 0 else [self.byte[b] for b in text[place : place + n].encode()] if self.byte else [self.model.unk_id()])
            place += n
        return np.array(out, dtype="<u4").tobytes()

    def _alone(self, text: str) -> bytes:
        """The ids of a text of any length, by backtracking; matches are looked up a window at a time."""
        failed = bytearray(len(text) // 8 + 1)  # a bit for each place
        taken: list[tuple[int, int]] = []  # each token and its rank among those of its place
        windows: dict[int, tuple[list[int], list[int]]] = {}
        place, rank = 0, None
        while place < len(text):
            number = place // WINDOW
            if number not in windows:
                if len(windows) > 2:
                    windows.pop(max(windows, key=lambda w: abs(w - number)))
                windows[number] = tuple(x.tolist() for x in self._matches(text, number * WINDOW, min(len(text), (number + 1) * WINDOW)))
            token, first = windows[number]
            low, high = first[place - number * WINDOW], first[place - number * WINDOW + 1]
            rank = high - low - 1 if rank is None else rank
            before = taken[-1][0] if taken else -1
            while rank >= 0:
                t = token[low + rank]
                to = place + int(self.length[t])
                if not failed[to >> 3] >> (to & 7) & 1 and self.compatible(before, t):
                    break
                rank -= 1
            if rank >= 0:
                taken.append((t, rank))
                place, rank = to, None
            else:
                failed[place >> 3] |= 1 << (place & 7)
                if not taken:
                    raise ValueError("the vocabulary has no encoding for a text")
                t, rank = taken.pop()
                place, rank = place - int(self.length[t]), rank - 1
        if len(self.fits) > PAIRS:
            self._settle()
        return self._spelt(text, [t for t, _ in taken])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with those of its begin and end, as little-endian 32-bit values."""
        normal = [self.model.normalize(t) for t in texts]
        if self.cut is None:
            return [self.begin + self._alone(t) + self.end for t in normal]
        cut = [self.cut.findall(t) for t in normal]
        new = set().union(*cut) - self.words.keys()
        if len(self.words) + len(new) > KEPT // 2:
            self.older, self.words = self.words, {}
            new = set().union(*cut)
        self.words.update((w, self.older[w]) for w in new & self.older.keys())
        short = sorted(w for w in new - self.words.keys() if len(w) <= WORD)
        if short:
            self.words.update(zip(short, self._together(short)))
        long = {w: self._alone(w) for w in new if len(w) > WORD}
        self.words.update(long)
        out = [b"".join([self.begin, *map(self.words.__getitem__, words), self.end]) for words in cut]
        for w in long:
            del self.words[w]
        return out


_LOADED: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """One encoder for each Python worker, which Spark uses again for later tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded``: the ids of every whole text, begin and end included, and what the library decodes them to.

    One row per row of ``docs``, repeated rows and ids too. A null text is an empty one: its ids are the begin and
    the end, it decodes to an empty text. A null id stays null. Extra columns are ignored; an empty table gives no
    rows. ``model``: a BPE model file, at the same place on every machine.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model)
        for batch in batches:
            for part in C.slices(batch, "t"):
                got = encoder.encode([t or "" for t in part.column("t").to_pylist()])
                lists = [np.frombuffer(b, dtype="<u4") for b in got]
                back = [encoder.model.decode(ids.tolist()) for ids in lists]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = pa.array(np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ``encode`` with the ids (little-endian unsigned 32-bit) and the decoded
    text (UTF-8) as digests, which are made where the ids are, so that no list of ids leaves its task. Edges: as in ``encode``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model)
        for batch in batches:
            for part in C.slices(batch, "t"):
                n, own, decoded = [], [], []
                for ids in encoder.encode([t or "" for t in part.column("t").to_pylist()]):
                    n.append(len(ids) // 4)
                    own.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(encoder.model.decode(np.frombuffer(ids, dtype="<u4").tolist()).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
