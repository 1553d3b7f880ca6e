"""Exact token counts by a compiled finite-state tokenizer.

The splitting of text into words for byte-level BPE is a regular pattern with one character of lookahead. Here it is a
deterministic transducer over character classes. A batch of texts is one long string of classes, cut into chunks of
equal length. For every chunk the map from entry state to leaving state is computed for all states at once; maps compose
associatively, so a parallel prefix scan over the chunks gives each chunk's entry state; a second pass emits the word
boundaries.

Inside a word a second deterministic transducer reads bytes. Its transitions are compiled from the merges of the vocabulary file:
a state holds the longest suffix read that can still become part of a token, with the last token of the encoding at each
place in it, and a transition carries by how much the number of emitted tokens changes. As a word begins in the start state, the boundaries
of the first pass are where its chunk maps meet, and all words of a batch are read side by side. Words of several thousand bytes are read in chunks
side by side too, with maps from entry state to leaving state and emitted tokens for the entries that occur.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.llm.common import give_back, held

# Character classes.
S, W, A, N, T, R, V, L, E, X, O, END = range(12)
# States: what the last character was part of. SP/SPN end in a blank, WS/WSN in other white space (first of its run or
# not); APO.. are the beginnings of a contraction; CON is a finished one.
START, LET, NUM, PUN, SP, SPN, WS, WSN, APO, APR, APV, APL, CON = range(13)
BEFORE, BACK = 1, 2  # a boundary before this character; one before the previous character
# Unicode White_Space without the blank.
WHITE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK = 512
GROUP_BYTES = 1_000_000  # read at once
STATES_KEPT = 300_000
PAIRS_KEPT = 1_200_000  # of tokens, known to stay apart or not
SMALL = 250_000, 200_000, 100_000  # the three for a small machine
LONG_BYTES = 4096  # words of more are read by chunks
WARM_BYTES = 64  # read before a chunk to guess its entry state
BLOCK_BYTES = 1 << 18
_SAFE_CUT = re.compile(rb"[A-Za-z0-9](?=[ \n])")  # a word ends here whatever surrounds it


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables [state, class] of the word splitter."""
    to, out = np.zeros((13, 12), np.uint8), np.zeros((13, 12), np.uint8)
    letters = (T, R, V, L, E, X)
    fresh = {S: SP, W: WS, A: APO, N: NUM, O: PUN, END: START} | dict.fromkeys(letters, LET)
    for state in range(13):
        for c in range(12):
            # By default every character begins a word.
            to[state, c], out[state, c] = fresh[c], BEFORE

    def put(state: int, classes: tuple[int, ...], target: int, bounds: int) -> None:
        for c in classes:
            to[state, c], out[state, c] = target, bounds

    put(LET, letters, LET, 0)
    put(NUM, (N,), NUM, 0)
    put(PUN, (A, O), PUN, 0)
    # A blank joins the word after it; of a longer run of white space, only the last character is left for it.
    for state, bounds in ((SP, 0), (SPN, BACK)):
        put(state, letters, LET, bounds)
        put(state, (N,), NUM, bounds)
        put(state, (A, O), PUN, bounds)
    for state in (SP, SPN, WS, WSN):
        put(state, (S,), SPN, 0)
        put(state, (W,), WSN, 0)
    for c in (*letters, N, A, O):
        out[WSN, c] = BEFORE | BACK
    put(APO, (A, O), PUN, 0)
    put(APO, (T,), CON, 0)
    put(APO, (R,), APR, 0)
    put(APO, (V,), APV, 0)
    put(APO, (L,), APL, 0)
    for state, last in ((APR, E), (APV, E), (APL, L)):
        for c in range(12):  # not a contraction: the letter has begun a word
            to[state, c], out[state, c] = to[LET, c], out[LET, c] | BACK
        put(state, (last,), CON, 0)
    return to, out


def character_classes() -> np.ndarray:
    """The class of each code point."""
    classes = np.full(0x110000, O, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            classes[cp] = X
        elif kind == "N":
            classes[cp] = N
    for c, chars in ((T, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (A, "'"), (S, " ")):
        for ch in chars:
            classes[ord(ch)] = c
    classes[WHITE] = W
    return classes


class Splitter:
    """Finds the word boundaries of many texts at once."""

    def __init__(self, chunk: int = CHUNK) -> None:
        self.to, self.out = compile_splitter()
        self.classes, self.chunk = character_classes(), chunk

    def marks(self, codes: np.ndarray) -> np.ndarray:
        """Bounds for each class code in a sequence that begins in START."""
        n = len(codes)
        rows = -(-n // self.chunk)
        grid = np.full(rows * self.chunk, END, np.uint8)
        grid[:n] = codes
        grid = np.ascontiguousarray(grid.reshape(rows, self.chunk).T)  # a row for each position within the chunks
        flat_to, flat_out = self.to.ravel().astype(np.intp), self.out.ravel()
        maps = np.broadcast_to(np.arange(13), (rows, 13)).astype(np.intp)
        at = 0
        while at < self.chunk and not (maps == maps[:, :1]).all():
            maps = flat_to[maps * 12 + grid[at][:, None]]
            at += 1
        if at < self.chunk:  # from here on no chunk's state depends on its entry state
            state = maps[:, 0]
            for position in grid[at:]:
                state = flat_to[state * 12 + position]
            maps = np.repeat(state[:, None], 13, axis=1)
        step = 1
        while step < rows:  # prefix scan: maps[i] becomes the composition of the maps up to i
            later = np.take_along_axis(maps[step:], maps[:-step], axis=1)
            maps = np.concatenate([maps[:step], later])
            step *= 2
        state = np.concatenate([[START], maps[:-1, START]]).astype(np.intp)
        marks = np.empty((self.chunk, rows), np.uint8)
        for i, p in enumerate(grid):
            at = state * 12 + p
            marks[i], state = flat_out[at], flat_to[at]
        return np.ascontiguousarray(marks.T).ravel()[:n]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and lengths in bytes of the words of the texts that `offsets` cut out of UTF-8 data."""
        texts = len(offsets) - 1
        begin = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each character
        chars = np.searchsorted(begin, offsets)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        # An END follows each text, which takes the splitter back to START.
        codes = np.full(len(points) + texts, END, np.uint8)
        ends = chars[1:] + np.arange(texts)
        is_char = np.ones(len(codes), bool)
        is_char[ends] = False
        codes[is_char] = self.classes[points]
        marks = self.marks(codes)
        begins = (marks & BEFORE).astype(bool)
        begins[:-1] |= (marks[1:] & BACK).astype(bool)
        begins[ends] = True
        begins[chars[:-1] + np.arange(texts)] = True
        at = np.flatnonzero(begins)
        start = begin[at - np.searchsorted(ends, at)]
        size = np.diff(np.append(start, len(data)))
        return start[size > 0], size[size > 0]


def _byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pairs_kept: int) -> None:
        self.pairs_kept = pairs_kept
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        names, symbols = file["model"]["vocab"], _byte_symbols()
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.ids = {bytes(symbols[c] for c in t): i for t, i in names.items() if t not in self.special and all(c in symbols for c in t)}
        self.merges: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # a token's two parts and the rank of their merge
        for rank, m in enumerate(file["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, k = names[a], names[b], names[a + b]
            if k in self.made or (i, j) in self.merges:
                raise ValueError("a token with two merges: the vocabulary has no deterministic pairs")
            self.merges[i, j], self.made[k] = rank, (i, j, rank)
        if any(bytes((b,)) not in self.ids for b in range(256)):
            raise ValueError("not a byte-level vocabulary")
        self.texts = sorted({b"", *(t[:n] for t in self.ids for n in range(1, len(t)))})
        self.beginnings = {t: i for i, t in enumerate(self.texts)}  # of tokens, the empty one too; states hold their numbers
        self.sizes = np.zeros(max([*self.ids.values(), *self.special.values()]) + 1, np.int64)
        for t, i in self.ids.items():
            self.sizes[i] = len(t)
        self._known: dict[int, bool] = {}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' text is the two tokens: no earlier merge would have crossed the cut.

        Their merges are undone from the latest to the earliest, the right one first among equals, as merging goes from the left.
        """
        pair = left << 32 | right
        found = self._known.get(pair)
        if found is not None:
            return found
        if len(self._known) >= self.pairs_kept:
            self._known.clear()
        a, b, before = left, right, len(self.merges)
        while True:
            across = self.merges.get((a, b))
            if across is not None and across < before:
                found = False
                break
            rank_a = self.made[a][2] if a in self.made else -1
            rank_b = self.made[b][2] if b in self.made else -1
            if rank_a == rank_b == -1:
                found = True
                break
            if rank_a > rank_b:
                a, before = self.made[a][1], rank_a
            else:
                b, before = self.made[b][0], rank_b + 1
        self._known[pair] = found
        return found


_HASH = np.uint64(0x9E3779B97F4A7C15)
_BIAS = 1 << 19


class Transducer:
    """Reads words byte by byte. Transitions are compiled when first taken and kept in an open hash table.

    A state is a suffix and, for each place in it from which a token may still begin, the last token of the encoding up to there and the
    number of tokens there less that at the end. The next token is the longest one that ends at the next byte and stays apart
    from the last token before it; there is exactly one such token. A worker has many states, so each is one string of bytes: the number of
    its suffix and for each place the number of that pair, or 0.
    """

    def __init__(self, vocabulary: Vocabulary, states_kept: int) -> None:
        self.vocabulary, self.states_kept = vocabulary, states_kept
        self.clear()

    def clear(self) -> None:
        self.places, self.place_numbers = [None, (-1, 0)], {(-1, 0): 1}
        start = array("I", (0, 1)).tobytes()
        self.states, self.tokens = [b"", start], np.full(1024, -1, np.int64)
        self.numbers = {start: 1}
        self.bits, self.n = 16, 0
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)

    def _compile(self, key: int) -> int:
        """The transition of a state and a byte: target, and emitted tokens plus _BIAS in the lower 20 bits."""
        v, (suffix, *places) = self.vocabulary, array("I", self.states[key >> 8])
        x, places = v.texts[suffix] + bytes((key & 255,)), [self.places[p] for p in places]
        for at in range(len(x)):
            token = v.ids.get(x[at:])
            if token is not None and places[at] is not None and (places[at][0] < 0 or v.stay_apart(places[at][0], token)):
                break
        emitted = places[at][1] + 1
        cut = 0
        while x[cut:] not in v.beginnings:
            cut += 1
        kept = [(p[0], p[1] - emitted) if p is not None and x[cut + i :] in v.beginnings else None for i, p in enumerate(places[cut:])]
        state = array("I", (v.beginnings[x[cut:]], *map(self._place, kept), self._place((token, 0)))).tobytes()
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
            if number >= len(self.tokens):
                self.tokens = np.concatenate([self.tokens, np.full_like(self.tokens, -1)])
            self.tokens[number] = token
        return number << 20 | emitted + _BIAS

    def _place(self, place: tuple[int, int] | None) -> int:
        """The number of a place's token and count."""
        if place is None:
            return 0
        number = self.place_numbers.setdefault(place, len(self.places))
        if number == len(self.places):
            self.places.append(place)
        return number

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _HASH) >> np.uint64(64 - self.bits)).view(np.int64)

    def _add(self, keys: np.ndarray) -> None:
        """Compile new transitions and put them into the table, which is kept at most half full."""
        self._put(keys, np.fromiter(map(self._compile, keys.tolist()), np.int64, len(keys)))

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while 2 * len(keys) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.n = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
        self.n += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several keys at one slot the last stays
            done = self.keys[slot] == keys
            self.values[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)

    def _take(self, key: np.ndarray) -> np.ndarray:
        """The transitions of the keys."""
        slot = self._slots(key)
        found = self.keys[slot]
        out = self.values[slot]
        open_ = np.flatnonzero(found != key)
        while len(open_):
            missing = found[open_] < 0
            if missing.any():
                self._add(np.unique(key[open_[missing]]))
                slot[open_] = self._slots(key[open_])  # the table may have grown
            else:
                slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found[open_], out[open_] = self.keys[slot[open_]], self.values[slot[open_]]
            open_ = open_[found[open_] != key[open_]]
        return out

    def _run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after, and tokens emitted in, some pieces of the data that begin in the given states, all pieces at once."""
        out, counts = entry.copy(), np.zeros(len(start), np.int64)
        if not len(start):
            return out, counts
        order = np.argsort(-size, kind="stable")
        at, longest = start[order], int(size[order[0]])
        longer = len(size) - np.cumsum(np.bincount(size, minlength=longest + 1))  # pieces of more than so many bytes
        state, emitted = entry[order], np.zeros(len(at), np.int64)
        for i in range(longest):
            n = int(longer[i])
            where = at[:n] + i
            got = self._take(state[:n] << 8 | data[where])
            state[:n] = got >> 20
            emitted[:n] += (got & ((1 << 20) - 1)) - _BIAS
            if last is not None:
                last[where] = self.tokens[state[:n]]
        out[order], counts[order] = state, emitted
        return out, counts

    def _long(self, data: np.ndarray, start: int, size: int, last: np.ndarray | None) -> int:
        """The number of tokens of a long word, by chunks.

        A chunk's map takes the state at its beginning to the state at its end and the tokens emitted. Maps hold the entry that reading the bytes before from scratch
        gives, mostly the true one, for all chunks at once; they compose from the left, and an entry that a map lacks is read when it is met. Chunks of equal
        bytes share a map, so that a word of one repeated letter needs few entries. A word is taken in blocks, between which old states are given up.
        """
        state, total = 1, 0
        for block in range(start, start + size, BLOCK_BYTES):
            state = self._trimmed(state)
            begin = np.arange(block, min(block + BLOCK_BYTES, start + size), CHUNK)
            length = np.minimum(CHUNK, min(block + BLOCK_BYTES, start + size) - begin)
            warm = np.minimum(WARM_BYTES, begin - start)
            guess, _ = self._run(data, begin - warm, warm, np.ones(len(begin), np.int64))
            guess[0] = state
            out, n = self._run(data, begin, length, guess)
            names = [data[x : x + y].tobytes() for x, y in zip(begin.tolist(), length.tolist())]
            maps = {(name, g): found for name, g, found in zip(names, guess.tolist(), zip(out.tolist(), n.tolist()))}
            entry = np.zeros(len(begin), np.int64)
            for i, name in enumerate(names):
                entry[i] = state
                if (name, state) not in maps:
                    one_out, one_n = self._run(data, begin[i : i + 1], length[i : i + 1], entry[i : i + 1])
                    maps[name, state] = int(one_out[0]), int(one_n[0])
                state, emitted = maps[name, state]
                total += emitted
            if last is not None:
                self._run(data, begin, length, entry, last)
        return total

    def _trimmed(self, state: int) -> int:
        """The state's number after old states have been given up, if there are many."""
        if len(self.states) <= self.states_kept:
            return state
        (suffix, *places), token = array("I", self.states[state]), self.tokens[state]
        places = [self.places[p] for p in places]
        self.clear()
        kept = array("I", (suffix, *(self._place(p) for p in places))).tobytes()
        if kept in self.numbers:
            return self.numbers[kept]
        self.numbers[kept] = len(self.states)
        self.states.append(kept)
        self.tokens[self.numbers[kept]] = token
        return self.numbers[kept]

    def read(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """The number of tokens of each word; with `last`, the last token of the encoding up to each byte is written to it."""
        self._trimmed(1)
        counts = np.zeros(len(start), np.int64)
        short = size <= LONG_BYTES
        counts[short] = self._run(data, start[short], size[short], np.ones(int(short.sum()), np.int64), last)[1]
        for i in np.flatnonzero(~short).tolist():
            counts[i] = self._long(data, int(start[i]), int(size[i]), last)
        return counts


class Machine:
    """Splitter and transducer of one vocabulary. A small one takes less memory and up to twice the time; its results are the same."""

    def __init__(self, path: str, small: bool = False) -> None:
        self.group_bytes, states, pairs = SMALL if small else (GROUP_BYTES, STATES_KEPT, PAIRS_KEPT)
        self.vocabulary = Vocabulary(path, pairs)
        self.splitter, self.transducer = Splitter(), Transducer(self.vocabulary, states)
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in names)) if names else None

    def _segments(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where to cut: at the texts' ends, around special strings, and in long texts where a word ends; and the special ids by segment."""
        cuts, specials = [offsets], {}
        at = 0
        while self.special and (m := self.special.search(data, at)):
            text = int(np.searchsorted(offsets, m.start(), "right")) - 1
            inside = m.end() <= offsets[text + 1]
            if inside:
                cuts.append(np.array(m.span()))
                specials[m.start()] = self.vocabulary.special[m[0].decode()]
            at = m.end() if inside else m.start() + 1
        for text in np.flatnonzero(np.diff(offsets) > self.group_bytes):
            at, end = int(offsets[text]) + self.group_bytes, int(offsets[text + 1])
            while at < end and (m := _SAFE_CUT.search(data, at, end)):
                cuts.append(np.array([m.end()]))
                at = m.end() + self.group_bytes
        where = np.unique(np.concatenate(cuts))
        ids = np.full(len(where), -1, np.int64)
        for start, i in specials.items():
            ids[np.searchsorted(where, start)] = i
        return where, ids[:-1]

    def encode(self, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each text and, if wanted, all their ids in a row."""
        data, offsets = utf8(texts)
        where, special = self._segments(data.tobytes(), offsets)
        counts, ids = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        first = 0
        while first < len(where) - 1:
            past = max(first + 1, int(np.searchsorted(where, where[first] + self.group_bytes, "right")) - 1)
            cut, own = where[first : past + 1], special[first:past]
            part = data[cut[0] : cut[-1]]
            start, size = self.splitter.words(part, cut - cut[0])
            segment = np.searchsorted(cut - cut[0], start, "right") - 1
            plain = own[segment] < 0
            start, size, segment = start[plain], size[plain], segment[plain]
            last = np.full(len(part), -1, np.int64) if want_ids else None
            n = np.bincount(segment, self.transducer.read(part, start, size, last), past - first).astype(np.int64) + (own >= 0)
            counts += np.bincount(np.searchsorted(offsets, cut[:-1], "right") - 1, n, len(texts)).astype(np.int64)
            if last is not None:
                ends = np.zeros(len(part), bool)  # of tokens, found from the words' ends back
                at, low = start + size - 1, start
                while len(at):
                    ends[at] = True
                    at = at - self.vocabulary.sizes[last[at]]
                    at, low = at[at >= low], low[at >= low]
                single = np.flatnonzero(own >= 0)
                last[cut[single] - cut[0]], ends[cut[single] - cut[0]] = own[single], True
                ids.append(last[ends].astype(np.int32))
            first = past
        return counts, np.concatenate(ids) if want_ids else ids[0]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where its texts begin and end in them."""
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at is not None and at.size else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def machine(path: str, small: bool = False) -> Machine:
    """The worker's machine for a vocabulary file; the workers of an executor keep it between batches."""
    return held(("machine", path, small), lambda: Machine(path, small))


def count_batch(texts: list[str], vocabulary: str) -> list[int]:
    """Token counts of some texts."""
    return machine(vocabulary).encode(pa.array(texts, pa.string()), want_ids=False)[0].tolist()


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, n_bytes, n_tokens, over_limit) for every row, from whole texts, without a shuffle.

    `vocabulary` is a byte-level BPE file of the tokenizers library; counts equal that library's, without added begin or end
    tokens; its special strings are one token each. Null text counts as empty (0 tokens); repeated rows and null ids give a row each; an
    empty table gives none. Texts of any length are read in parts that end where a word does.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(vocabulary)
        for batch in batches:
            n, _ = m.encode(batch.column(1), want_ids=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])
            give_back()

    x = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema[id_col].dataType.simpleString()
    got = x.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
