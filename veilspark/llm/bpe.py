"""Operator 2: byte-level BPE as a lazily determinised finite-state transducer.

Two facts about byte-pair encoding carry the construction. The encoding of a prefix ends in exactly one
token, and dropping that token leaves the encoding of a shorter prefix; and tokens a, b may stand side by
side exactly if the encoding of their joined bytes is [a, b]. So the encodings of all prefixes form a tree
over byte positions. Reading on, only positions from which some token can still be completed matter; as
soon as all of these share a stretch of the tree, its tokens are final and are emitted. What is pending is
never longer than the vocabulary's lookahead.

``Merges`` compiles the vocabulary once into arrays: a trie of tokens, the two halves of each token, the pairs that
merge, and the step that each token makes in the UTF-8 state machine. A state of the ``Transducer`` is the tree of
the positions that matter, with the trie node that each has reached. States and arcs are made when first met, all
those that a batch lacks at once, and kept up to a bound. Decoding gathers the tokens' bytes; the state machine over
tokens tells well-formed text, and the one over bytes turns chunks into text.

Nulls and empty texts have no tokens and decode to no bytes. Each row is on its own: ties, repeated rows and
further columns have no effect.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import python_task, small_batches


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64(token) rank`` of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Arcs:
    """key -> value, both whole numbers, keys not negative, by open addressing in arrays, so that many are looked up at once."""

    def __init__(self, bits: int = 12):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New and distinct keys."""
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            old = self.keys >= 0
            kept, bits = (self.keys[old], self.values[old]), self.bits
            while 2 * (self.used + len(keys)) > 1 << bits:
                bits += 1
            self.__init__(bits)
            self.put(*kept)
        self.used += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several, one stays
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & (1 << self.bits) - 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slots = self._slots(keys)
        found = self.keys[slots]
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            slots[on] = (slots[on] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots[on]]
            on = on[(there != keys[on]) & (there >= 0)]
        return np.where(self.keys[slots] == keys, self.values[slots], -1)

    def one(self, key: int) -> int:
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - self.bits
        while (there := self.keys.item(slot)) != key:
            if there < 0:
                return -1
            slot = slot + 1 & (1 << self.bits) - 1
        return self.values.item(slot)


class Pile:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.size = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.empty(max(end, 2 * len(self.data)) - self.size, self.data.dtype)])
        self.data[self.size : end] = more
        self.size = end


def places(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of each stretch, one stretch after the other."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


#: UTF-8 as a state machine over byte classes: state -> (first byte, last byte, next state) of each range.
#: 0 accepts; 1 to 3 wait for so many plain continuation bytes; 4 to 7 wait for a restricted second byte; 8 is ill-formed.
UTF8 = {
    0: ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)),
    1: ((0x80, 0xBF, 0),),
    2: ((0x80, 0xBF, 1),),
    3: ((0x80, 0xBF, 2),),
    4: ((0xA0, 0xBF, 1),),
    5: ((0x80, 0x9F, 1),),
    6: ((0x90, 0xBF, 2),),
    7: ((0x80, 0x8F, 2),),
}
BAD, N_STATES = 8, 9
UTF8_NEXT = np.full((N_STATES, 256), BAD, np.uint8)
for _state, _ranges in UTF8.items():
    for _low, _high, _to in _ranges:
        UTF8_NEXT[_state, _low : _high + 1] = _to
UTF8_ROWS = [row.tobytes() for row in UTF8_NEXT]


class Merges:
    """A vocabulary as arrays; token ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values(), default=-1) + 1
        tokens = [b""] * self.n
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = np.fromiter(map(len, tokens), np.int64, self.n)
        self.at, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)
        decimals = [b"%d " % i for i in range(self.n)]
        self.decimal_size = np.fromiter(map(len, decimals), np.int64, self.n)
        self.decimal_at, self.decimal_data = np.cumsum(self.decimal_size) - self.decimal_size, np.frombuffer(b"".join(decimals), np.uint8)

        edges, node_token, inner = {}, [-1], [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                inner[node] = True
                onward = edges.get(node << 8 | byte)
                if onward is None:
                    onward = edges[node << 8 | byte] = len(node_token)
                    node_token.append(-1)
                    inner.append(False)
                node = onward
            node_token[node] = rank
        self.edges = self._table(edges)
        self.node_token, self.inner = np.array(node_token, np.int32), np.array(inner, bool)

        joined = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    joined[left * self.n + right] = rank
        self.joined = self._table(joined)

        halves = np.full((self.n, 2), -1, np.int32)
        for token, rank in ranks.items():
            halves[rank] = self._halves(token, rank, ranks)
        self.left, self.right = halves[:, 0].copy(), halves[:, 1].copy()
        #: Tokens that merging never leads to; a piece that equals one is that token all the same.
        self.only_whole = {t: r for t, r in ranks.items() if self.left[r] < 0}

        self.after = np.tile(np.arange(N_STATES, dtype=np.uint8), (self.n, 1))
        for j in range(int(self.size.max(initial=0))):
            longer = np.flatnonzero(self.size > j)
            self.after[longer] = UTF8_NEXT[self.after[longer], self.data[self.at[longer] + j][:, None]]
        self.after_start, self.steps = self.after[:, 0].copy(), self.after.tobytes()

    @staticmethod
    def _table(entries: dict[int, int]) -> Arcs:
        table = Arcs()
        table.put(np.fromiter(entries, np.int64, len(entries)), np.fromiter(entries.values(), np.int64, len(entries)))
        return table

    @staticmethod
    def _halves(data: bytes, token: int, ranks: dict[bytes, int]) -> tuple[int, int]:
        """The two tokens whose merge made this one, by merging the lowest-ranked neighbours of its bytes; itself twice
        for a byte; -1 if merging never leads to it."""
        if len(data) == 1:
            return token, token
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            ranked = [(rank, i) for i in range(len(parts) - 1) if (rank := ranks.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                return -1, -1
            at = min(ranked)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 and all(p in ranks for p in parts) else (-1, -1)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May token b follow token a? Undoes, latest first, the merges that make a and b. The tokens that face each other
        meanwhile must not merge before the merge that was undone last takes one of them away."""
        fine, left, right = np.ones(len(a), bool), a.astype(np.int64), b.astype(np.int64)
        before, row = np.full(len(a), self.n + 1), np.arange(len(a))
        while len(row):
            rank = self.joined.get(left * self.n + right)
            merge = (rank >= 0) & (rank < before)
            fine[row[merge]] = False
            inner, outer = self.right[left], self.left[right]
            first = (inner != left) & ((left > right) | (outer == right))
            before = np.where(first, left, right + 1)
            more = ~merge & (first | (outer != right))
            left, right = np.where(first, inner, left), np.where(first, right, outer)
            left, right, before, row = left[more], right[more], before[more], row[more]
        return fine

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        return self.data[places(self.at[ids], self.size[ids])]

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        """The ids in decimal, a space after each."""
        return self.decimal_data[places(self.decimal_at[ids], self.decimal_size[ids])]

    def well_formed(self, ids: np.ndarray) -> bool:
        """Do the tokens' bytes make UTF-8? The state machine steps from token to token, and need only look at those that
        do not lead from its first state back there."""
        open_at = np.flatnonzero(self.after_start[ids]).tolist()
        if not open_at:
            return True
        read, end = ids.item, 0
        for at in open_at:
            if at < end:
                continue
            state, end = 0, at
            while end == at or state:
                if end == len(ids):
                    return False
                state = self.steps[read(end) * N_STATES + state]
                if state == BAD:
                    return False
                end += 1
        return True


_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class Transducer:
    """Bytes of pre-split pieces in, token ids out.

    The positions of a state are numbered from the one that all others hang on. Of each are known: the trie node that
    reading from it has reached (-1: no token can be completed from it), the last token before it, and the position
    where that token begins. The first position's token is -1 at the start of a piece, and -2 where it does not matter.
    """

    def __init__(self, merges: Merges, max_states: int = 150_000, max_pairs: int = 400_000):
        self.merges, self.max_states, self.max_pairs = merges, max_states, max_pairs
        self.seed = np.random.default_rng().integers(1, 1 << 62, 2, dtype=np.uint64) | np.uint64(1)
        self.pairs = Arcs()
        self._reset()

    def _reset(self) -> None:
        self.arcs, self.states = Arcs(), Arcs()
        self.node, self.token, self.before = Pile(np.int32), Pile(np.int32), Pile(np.int32)  # of all states' positions
        self.at, self.count, self.check = Pile(np.int64), Pile(np.int64), Pile(np.uint64)  # of each state
        self.target, self.out_at, self.out_count, self.out = Pile(np.int64), Pile(np.int64), Pile(np.int64), Pile(np.int32)  # of each arc
        one = np.ones((1, 1), bool)
        self._numbered(np.array([[0]]), np.array([[-1]]), np.array([[-1]]), one)

    def _numbered(self, node: np.ndarray, token: np.ndarray, before: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Numbers of the states with these positions (rows; those kept), old or new. ``before`` counts kept ones."""
        place = np.cumsum(keep, 1)
        packed = ((node + 2).astype(np.uint64) * _ODD[0] ^ (token + 3).astype(np.uint64) * _ODD[1]) + (before + 2).astype(np.uint64) * _ODD[2] + place.astype(np.uint64) * _ODD[3]
        key, check = (np.where(keep, _mixed(packed * s), np.uint64(0)).sum(1, dtype=np.uint64) for s in self.seed)
        key = (key >> np.uint64(2)).astype(np.int64)
        distinct, row, back = np.unique(key, return_index=True, return_inverse=True)
        number = self.states.get(distinct)
        new = np.flatnonzero(number < 0)
        if len(new):
            row = row[new]
            number[new] = self.at.size + np.arange(len(new))
            kept, count = keep[row], keep[row].sum(1)
            self.at.add(self.node.size + np.cumsum(count) - count)
            self.count.add(count)
            self.check.add(check[row])
            for pile, values in ((self.node, node), (self.token, token), (self.before, before)):
                pile.add(values[row][kept])
            self.states.put(distinct[new], number[new])
        number = number[back]
        if (self.check.data[number] != check).any():
            raise RuntimeError("two states have one hash; another attempt draws another")
        return number

    def _adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May token b follow token a? -1 is the start. Merging must lead to b."""
        key = (a + 1).astype(np.int64) * self.merges.n + b
        found = self.pairs.get(key)
        lacking = found < 0
        if lacking.any():
            if self.pairs.used >= self.max_pairs:
                self.pairs, lacking = Arcs(), np.ones(len(key), bool)
            new = np.unique(key[lacking])
            left, right = new // self.merges.n - 1, new % self.merges.n
            fine = self.merges.left[right] >= 0
            check = np.flatnonzero(fine & (left >= 0))
            fine[check] = self.merges.stay_apart(left[check], right[check])
            self.pairs.put(new, fine.astype(np.int64))
            found[lacking] = self.pairs.get(key[lacking])
        return found == 1

    def _make(self, keys: np.ndarray) -> None:
        """Makes the arcs of these distinct keys (state and byte)."""
        m = self.merges
        state, byte = keys >> 8, keys & 255
        count, rows = self.count.data[state], np.arange(len(keys))
        width = int(count.max())
        column = np.arange(width)
        inside = column < count[:, None]
        at = np.where(inside, self.at.data[state][:, None] + column, 0)
        node, token = np.where(inside, self.node.data[at], -1), self.token.data[at]
        before = np.where(inside, self.before.data[at], 0)
        row, col = np.nonzero(node >= 0)
        child = m.edges.get(node[row, col].astype(np.int64) << 8 | byte[row])
        on = child >= 0
        row, col, child = row[on], col[on], child[on]
        node = np.full((len(keys), width + 1), -1)
        node[:, width] = 0  # the new end, in the last column
        going = m.inner[child]
        node[row[going], col[going]] = child[going]
        done = m.node_token[child]
        whole = np.flatnonzero(done >= 0)
        fits = whole[self._adjacent(token[row[whole], col[whole]], done[whole])]
        last, begins = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        last[row[fits]], begins[row[fits]] = done[fits], col[fits]
        if (last < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        token, before = np.column_stack([token, last]), np.column_stack([before, begins])
        alive = node >= 0
        below = alive.astype(np.int64)  # live positions that hang on each
        for k in range(width, 0, -1):
            below[rows, before[:, k]] += below[:, k]
        every = below == below[:, :1]
        shared = width - np.argmax(every[:, ::-1], 1)  # the last position that all hang on
        emitted, cursor = [], shared
        while (cursor > 0).any():
            emitted.append(np.where(cursor > 0, token[rows, cursor], -1))
            cursor = np.where(cursor > 0, before[rows, cursor], 0)
        keep = (below > 0) & (np.arange(width + 1) >= shared[:, None])
        token[rows, shared] = np.where(alive[rows, shared], token[rows, shared], -2)
        before = np.take_along_axis(np.cumsum(keep, 1) - 1, np.maximum(before, 0), 1)
        before[rows, shared] = -1
        target = self._numbered(node, token, before, keep)
        out = np.column_stack(emitted[::-1]) if emitted else np.empty((len(keys), 0), np.int64)
        size = (out >= 0).sum(1)
        self.out_at.add(self.out.size + np.cumsum(size) - size)
        self.out_count.add(size)
        self.out.add(out[out >= 0])
        self.arcs.put(keys, self.target.size + np.arange(len(keys)))
        self.target.add(target)

    def _last(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, their number for each state) that end a piece in these states."""
        at, cursor = self.at.data[state], self.count.data[state] - 1
        emitted = []
        while (cursor > 0).any():
            here = at + np.maximum(cursor, 0)
            emitted.append(np.where(cursor > 0, self.token.data[here], -1))
            cursor = np.where(cursor > 0, self.before.data[here], 0)
        out = np.column_stack(emitted[::-1]) if emitted else np.empty((len(state), 0), np.int32)
        return out[out >= 0], (out >= 0).sum(1)

    def encode(self, piece: bytes) -> list[int]:
        return self.encode_all([piece])[0].tolist()

    def encode_all(self, pieces: list[bytes], group: int = 4096, step_bound: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces, number of each piece's). ``group`` pieces of like length move through the states
        together, a byte at a time; those of more than ``step_bound`` bytes go one by one."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts, tokens = np.zeros(len(pieces), np.int64), []
        order = np.argsort(-sizes, kind="stable")
        whole = {i: t for i in order.tolist() if (t := self.merges.only_whole.get(pieces[i])) is not None} if self.merges.only_whole else {}
        long = int((sizes > step_bound).sum())
        chunks = [order[i : i + 1] for i in range(long)] + [order[i : i + group] for i in range(long, len(order), group)]
        for n, chunk in enumerate(chunks):
            if self.at.size >= self.max_states:
                self._reset()
            if n < long:
                out = np.array(self._walk(pieces[chunk[0]]), np.int32)
                size = np.array([len(out)])
            else:
                out, size = self._together(b"".join([pieces[i] for i in chunk.tolist()]), sizes[chunk])
            counts[chunk] = size
            tokens.append(out)
        tokens = np.concatenate([*tokens, np.empty(0, np.int32)])
        begin = np.empty(len(pieces), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        for i, token in whole.items():
            tokens[begin[i]], counts[i] = token, 1
        return tokens[places(begin, counts)], counts

    def _together(self, data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest pieces first."""
        data, begin = np.frombuffer(data, np.uint8), np.cumsum(size) - size
        state = np.zeros(len(size), np.int64)
        who, what = [], []
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, "left"))  # pieces of more than t bytes come first
            key = state[:n] << 8 | data[begin[:n] + t]
            arc = self.arcs.get(key)
            lacking = arc < 0
            if lacking.any():
                self._make(np.unique(key[lacking]))
                arc[lacking] = self.arcs.get(key[lacking])
            some = np.flatnonzero(self.out_count.data[arc])
            who.append(some)
            what.append(arc[some])
            state[:n] = self.target.data[arc]
        last, n_last = self._last(state)
        what = np.concatenate([*what, np.empty(0, np.int64)])
        at = np.concatenate([self.out_at.data[what], self.out.size + np.cumsum(n_last) - n_last])
        count = np.concatenate([self.out_count.data[what], n_last])
        who = np.concatenate([*who, np.arange(len(size))])
        turn = np.argsort(who, kind="stable")
        tokens = np.concatenate([self.out.data[: self.out.size], last])[places(at[turn], count[turn])]
        return tokens, np.bincount(who, weights=count, minlength=len(size)).astype(np.int64)

    def _walk(self, piece: bytes) -> list[int]:
        state, out = 0, []
        for byte in piece:
            arc = self.arcs.one(state << 8 | byte)
            if arc < 0:
                if self.at.size >= 2 * self.max_states:
                    state = self._forget(state)
                self._make(np.array([state << 8 | byte]))
                arc = self.arcs.one(state << 8 | byte)
            if count := self.out_count.data.item(arc):
                at = self.out_at.data.item(arc)
                out += self.out.data[at : at + count].tolist()
            state = self.target.data.item(arc)
        return out + self._last(np.array([state]))[0].tolist()

    def _forget(self, state: int) -> int:
        """Drops all states but the present one; its new number."""
        at, count = self.at.data[state], self.count.data[state]
        kept = [p.data[at : at + count].astype(np.int64)[None] for p in (self.node, self.token, self.before)]
        self._reset()
        return int(self._numbered(*kept, np.ones((1, int(count)), bool))[0])


NOT_ASCII = re.compile(rb"[\x80-\xff]")


class Utf8Stream:
    """Text from bytes that arrive in chunks, by the state machine. An unfinished character waits for the next chunk;
    each ill-formed stretch becomes U+FFFD."""

    def __init__(self) -> None:
        self.state, self.kept = 0, b""

    def feed(self, data: bytes) -> str:
        out, clean, at = [], 0, 0  # everything before ``clean`` is out
        begin, data, state = 0, self.kept + data, self.state
        at = len(self.kept)
        while at < len(data):
            if not state:
                odd = NOT_ASCII.search(data, at)  # the first state accepts ASCII and stays
                if odd is None:
                    begin = at = len(data)
                    break
                begin = at = odd.start()
            state = UTF8_ROWS[state][data[at]]
            if state == BAD:
                out += [data[clean:begin].decode("utf-8"), "\ufffd"]
                at = clean = max(at, begin + 1)  # a byte that breaks a character may begin the next
                begin, state = at, 0
                continue
            at += 1
            if not state:
                begin = at
        out.append(data[clean:begin].decode("utf-8"))
        self.state, self.kept = state, data[begin:]
        return "".join(out)

    def finish(self) -> str:
        rest = "\ufffd" if self.kept else ""
        self.state, self.kept = 0, b""
        return rest


#: The pattern of which it is known that a match holds a space only as its first character or in a run of
#: white space; and the characters that it, or any common definition, counts as white space.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t-\r\x1c- \x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A space beside which no other white space stands: a text can be cut before it.
SINGLE_SPACE = re.compile(f"(?<![{WHITE}]) (?![{WHITE}])")
#: A space beside other white space.
RUN = f"[{WHITE}] | [{WHITE}]"


#: Letters of Latin alphabets, then at most one full stop or comma.
LETTERS = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,]?)").fullmatch


class Codec:
    """Texts to ids and back: the pattern's matches go through the transducer one by one.

    With ``CUT_PATTERN``, cutting a text before each space that stands alone cuts between matches. The stretches
    between cuts repeat, and their ids are remembered (up to ``memo`` stretches, then forgotten). With any other
    pattern a whole text is one stretch and is not remembered.
    """

    at_once = 16_384  # new stretches

    def __init__(self, merges: Merges, pattern: str, memo: int = 300_000, max_states: int = 150_000):
        self.merges, self.transducer = merges, Transducer(merges, max_states)
        self.find, self.cuts, self.memo = regex.compile(pattern).findall, pattern == CUT_PATTERN, memo
        self._forget()

    def _forget(self) -> None:
        self.after_space: dict[str, int] = {}  # stretches that follow a space, without it
        self.first: dict[str, int] = {}
        self.ids, self.at, self.count = Pile(np.int32), Pile(np.int64), Pile(np.int64)

    def _learn(self, stretches: list[str]) -> np.ndarray:
        """Numbers for new stretches."""
        pieces, sizes = [], []
        for s in stretches:
            if self.cuts and (m := LETTERS(s)) is not None:  # the usual stretch, with evident matches
                if m[2]:
                    pieces += m.groups()
                    sizes.append(2)
                else:
                    pieces.append(s)
                    sizes.append(1)
            else:
                found = self.find(s)
                pieces += found
                sizes.append(len(found))
        tokens, counts = self.transducer.encode_all([p.encode("utf-8") for p in pieces])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
        count = np.diff(np.concatenate([[0], ends]))
        self.at.add(self.ids.size + ends - count)
        self.count.add(count)
        self.ids.add(tokens)
        return np.arange(self.at.size - len(stretches), self.at.size)

    def _numbers(self, known: dict[str, int], stretches: list[str], space: str) -> np.ndarray:
        """Numbers of distinct stretches."""
        found = np.fromiter(map(known.get, stretches, repeat(-1)), np.int64, len(stretches))
        lacking = np.flatnonzero(found < 0).tolist()
        for i in range(0, len(lacking), self.at_once):
            some = lacking[i : i + self.at_once]
            new = [stretches[i] for i in some]
            found[some] = self._learn([space + s for s in new])
            known.update(zip(new, found[some].tolist()))
        return found

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's)."""
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if len(self.after_space) + len(self.first) > self.memo or not self.cuts:
            self._forget()
        texts = texts.cast(pa.string()).fill_null("")
        if not self.cuts:
            numbers, bounds = self._learn(texts.to_pylist()), np.arange(len(texts))
            return self._gathered(numbers, bounds)
        runs = pc.match_substring_regex(texts, RUN)
        odd = np.flatnonzero(runs.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(pc.if_else(runs, "", texts) if len(odd) else texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.dictionary_encode()
        index, words = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        begins = np.zeros(len(index), bool)
        begins[bounds[:-1]] = True
        used = np.zeros(len(words), bool)
        used[index[~begins]] = True
        at = np.flatnonzero(used)
        of_word = np.zeros(len(words), np.int64)
        of_word[at] = self._numbers(self.after_space, words.take(pa.array(at)).to_pylist(), " ")
        numbers = of_word[index]
        firsts = words.take(pa.array(index[bounds[:-1]])).to_pylist()
        distinct = list(dict.fromkeys(firsts))
        of_first = dict(zip(distinct, self._numbers(self.first, distinct, "").tolist()))
        numbers[bounds[:-1]] = [of_first[f] for f in firsts]
        bounds = bounds[:-1]
        if len(odd):
            numbers, bounds = self._with_runs(texts, odd, numbers, bounds)
        return self._gathered(numbers, bounds)

    def _with_runs(self, texts: pa.Array, odd: np.ndarray, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the stretches of the texts ``odd``, each of which stands as one empty stretch so far."""
        parts, last, size = [], 0, np.diff(np.concatenate([bounds, [len(numbers)]]))
        for n, text in zip(odd.tolist(), texts.take(pa.array(odd)).to_pylist()):
            first, *rest = SINGLE_SPACE.split(text)
            distinct = list(dict.fromkeys(rest))
            of_word = dict(zip(distinct, self._numbers(self.after_space, distinct, " ").tolist()))
            own = np.concatenate([self._numbers(self.first, [first], ""), np.fromiter(map(of_word.__getitem__, rest), np.int64, len(rest))])
            parts += [numbers[last : bounds[n]], own]
            last, size[n] = bounds[n] + 1, len(own)
        return np.concatenate([*parts, numbers[last:]]), np.cumsum(size) - size

    def _gathered(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count.data[numbers]
        return self.ids.data[places(self.at.data[numbers], count)], np.add.reduceat(count, bounds)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode_stream(self, ids: Iterable[int], chunk: int = 8192) -> Iterator[str]:
        ids, stream = np.fromiter(ids, np.int64), Utf8Stream()
        for i in range(0, len(ids), chunk):
            yield stream.feed(self.merges.decoded(ids[i : i + chunk]).tobytes())
        yield stream.finish()

    def digests(self, ids: np.ndarray, chunk: int = 100_000) -> tuple[str, str]:
        """SHA-256 of the ids in decimal, joined by spaces, and of the bytes that they decode to."""
        of_ids, of_bytes = hashlib.sha256(), hashlib.sha256()
        whole = self.merges.well_formed(ids)
        for i in range(0, len(ids), chunk):
            part = ids[i : i + chunk]
            decimals = self.merges.decimals(part)
            of_ids.update(decimals[: len(decimals) - (i + chunk >= len(ids))].data)
            if whole:
                of_bytes.update(self.merges.decoded(part).data)
        if not whole:
            for part in self.decode_stream(ids):
                of_bytes.update(part.encode("utf-8"))
        return of_ids.hexdigest(), of_bytes.hexdigest()


_compiled: dict[str, Merges] = {}


def _vocabulary(docs: DataFrame, rank_path: str):
    """The compiled vocabulary, shipped; its size is that of one vocabulary file. The driver keeps the last one."""
    with open(rank_path, "rb") as f:
        data = f.read()
    key = hashlib.sha256(data).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Merges(read_ranks(data))
    return docs.sparkSession.sparkContext.broadcast(_compiled[key])


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = 300_000, max_states: int = 150_000, rows: int = 500) -> DataFrame:
    """A row for each document: id, n_tokens, ids_sha256, decoded_sha256 (see the module for empty cases).

    No shuffle; a task holds the ids of ``rows`` texts at once, and the codec's tables, which ``memo`` (remembered
    stretches) and ``max_states`` bound and which go at its end.
    """
    small_batches(docs.sparkSession)
    shipped = _vocabulary(docs, rank_path)

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(shipped.value, pattern, memo, max_states)
        for batch in (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows)):
            ids, count = c.encode_all(batch.column(1))
            ends = np.cumsum(count)
            digests = [c.digests(ids[end - n : end]) for n, end in zip(count.tolist(), ends.tolist())]
            ids_sha, text_sha = zip(*digests)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids; ``out_col`` replaces a column of that name."""
    small_batches(docs.sparkSession)
    shipped = _vocabulary(docs, rank_path)
    kept = docs.drop(out_col)
    at = kept.columns.index(text_col)

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(shipped.value, pattern)
        for batch in batches:
            ids, count = c.encode_all(batch.column(at))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def token_counts(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` without the text, with the number of its tokens; ``out_col`` replaces a column of that name."""
    small_batches(docs.sparkSession)
    shipped = _vocabulary(docs, rank_path)
    read = docs.drop(out_col) if out_col != text_col else docs
    at = read.columns.index(text_col)
    fields = [f for f in read.schema.fields if f.name != text_col]

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(shipped.value, pattern)
        for batch in batches:
            columns = [x for i, x in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(c.encode_all(batch.column(at))[1], pa.int64())], [*(f.name for f in fields), out_col])

    return read.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.LongType())]))


def decode_ids(rows: DataFrame, rank_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their token ids; null ids give an empty text."""
    small_batches(rows.sparkSession)
    shipped = _vocabulary(rows, rank_path)
    kept = rows.drop(out_col)
    at = kept.columns.index(ids_col)

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(shipped.value, pattern)
        for batch in batches:
            texts = pa.array(["".join(c.decode_stream(ids or [])) for ids in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())]))
