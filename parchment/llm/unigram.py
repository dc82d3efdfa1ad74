"""A unigram vocabulary and its Viterbi segmentation, with the tie rules of unigram tokenizers.

The best segmentation has the largest sum of scores. Positions are settled from left to right, and a candidate replaces
another only if its sum is strictly larger, so of equal sums the piece that begins earliest stays. A character that no piece
of one character covers may also be taken as unknown, at the least score less 10; unknown characters become bytes where the
vocabulary has byte pieces, else one unknown piece for a run of them. Text gets a leading blank and blanks become U+2581.

No piece holds U+2581 after another character (checked when the vocabulary is read), so every segmentation has a boundary
before each word and a word can be segmented by itself. Scores are added in double precision.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of a public vocabulary; the path is a parameter of every operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character scores below the least score.
PENALTY = 10.0
WORDS = re.compile(" +[^ ]*|[^ ]+")
#: Words that a worker remembers.
REMEMBERED = 200_000
#: Words that are segmented together, and the characters from which a word is segmented by itself.
TOGETHER, LONG = 8192, 64
#: Marks a place where no piece begins.
EMPTY = -2
NEVER = float("-inf")


def _fields(data: bytes):
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield key >> 3, data[at : at + size]
            at += size


def pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, from a model file."""
    found = []
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                piece = dict(_fields(value))
                found.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
    return found


@dataclass
class Vocabulary:
    table: list[tuple[str, float, int]]
    key: str = field(default="", repr=False)

    def __post_init__(self) -> None:
        self.key = hashlib.md5(repr(self.table).encode()).hexdigest()

    def __getstate__(self) -> dict:
        return {"table": self.table, "key": self.key}

    def prepare(self) -> Vocabulary:
        """This vocabulary with automaton and lookups, made once by each worker process."""
        if self.key in _PREPARED:
            return _PREPARED[self.key]
        if len(_PREPARED) > 2:
            _PREPARED.clear()
        _PREPARED[self.key] = self
        self.automaton, self.single, self.byte, self.unknown, self.longest = ahocorasick.Automaton(), set(), {}, None, 1
        least = 0.0
        for i, (piece, score, kind) in enumerate(self.table):
            if kind in (NORMAL, USER) and piece:
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError(f"piece {i} goes across words: {piece!r}")
                self.automaton.add_word(piece, (len(piece), score, i))
                least = min(least, score)
                self.longest = max(self.longest, len(piece))
                if len(piece) == 1:
                    self.single.add(piece)
            elif kind == BYTE:
                self.byte[int(piece[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
        self.penalty = least - PENALTY
        self.bytewise = len(self.byte) == 256
        self.automaton.make_automaton()
        self.counts, self.ids, self.scores = {}, {}, {}
        return self

    def forward(self, word: str, entry: list[float] | None = None, stop: int | None = None) -> tuple[list[float], list[int], list[int]]:
        """Best score of each position, where its piece begins (-1: at none here) and the piece's id (-1: unknown).

        entry: scores of the first positions, which a piece from before the word has reached; such a piece begins earlier than
        any here, so it stays where sums are equal. stop: pieces begin before this position only.
        """
        n = len(word)
        stop = n if stop is None else stop
        best, back, piece = [NEVER] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        if entry is None:
            best[0] = 0.0
        else:
            best[: len(entry)] = entry[: n + 1]
        odd = [i for i, c in enumerate(word) if c not in self.single]
        if not odd:
            for end, (size, score, i) in self.automaton.iter(word):
                total = best[end + 1 - size] + score
                if total > best[end + 1] and end + 1 - size < stop:
                    best[end + 1], back[end + 1], piece[end + 1] = total, end + 1 - size, i
            return best, back, piece
        # matches by end; an unknown character is tried after the longer pieces that end with it, as it begins last
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        odd = set(odd)
        for end in range(n):
            for size, score, i in ends[end]:
                total = best[end + 1 - size] + score
                if total > best[end + 1] and end + 1 - size < stop:
                    best[end + 1], back[end + 1], piece[end + 1] = total, end + 1 - size, i
            if end in odd and end < stop and best[end] + self.penalty > best[end + 1]:
                best[end + 1], back[end + 1], piece[end + 1] = best[end] + self.penalty, end, -1
        return best, back, piece

    def emitted(self, word: str, steps: list[tuple[int, int]]) -> list[int]:
        """Ids of a segmentation, given as (start, id) from left to right: unknown characters become bytes or one piece for a run."""
        out: list[int] = []
        was = False
        for k, (start, i) in enumerate(steps):
            if i >= 0:
                out.append(i)
            elif self.bytewise:
                out.extend(self.byte[b] for b in word[start : start + 1].encode())
            elif not was:
                out.append(self.unknown)
            was = i < 0
        return out

    def trace(self, back: list[int], piece: list[int], at: int) -> tuple[int, list[tuple[int, int]]]:
        """Steps that lead to a position, and the position that they begin from."""
        steps = []
        while back[at] >= 0:
            steps.append((back[at], piece[at]))
            at = back[at]
        return at, steps[::-1]

    def path(self, word: str) -> list[tuple[int, int]]:
        _, back, piece = self.forward(word)
        return self.trace(back, piece, len(word))[1]

    def score_word(self, word: str) -> float:
        found = self.scores.get(word)
        if found is None:
            if len(self.scores) >= REMEMBERED:
                self.scores.clear()
            found = self.forward(word.replace(" ", BLANK))[0][-1]
            if len(word) < 64:
                self.scores[word] = found
        return found

    def encode_word(self, word: str) -> bytes:
        """Ids of a word as 32-bit integers."""
        found = self.ids.get(word)
        if found is None:
            if len(self.ids) >= REMEMBERED:
                self.ids.clear()
            marked = word.replace(" ", BLANK)
            found = np.array(self.emitted(marked, self.path(marked)), np.int32).tobytes()
            if len(word) < 64:
                self.ids[word] = found
        return found

    def count_word(self, word: str) -> int:
        """Number of pieces, carried through the dynamic programme beside the score: nothing is traced back."""
        found = self.counts.get(word)
        if found is None:
            if len(self.counts) >= REMEMBERED:
                self.counts.clear()
            found = self._count(word.replace(" ", BLANK))
            if len(word) < 64:
                self.counts[word] = found
        return found

    def _count(self, word: str) -> int:
        n, single = len(word), self.single
        best, count = [NEVER] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if all(c in single for c in word):
            for end, (size, score, _) in self.automaton.iter(word):
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1], count[end + 1] = total, count[end + 1 - size] + 1
            return count[n]
        run = [False] * (n + 1)  # whether a position is reached by an unknown character
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        for end, c in enumerate(word):
            for size, score, _ in ends[end]:
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1], count[end + 1], run[end + 1] = total, count[end + 1 - size] + 1, False
            if c not in single and best[end] + self.penalty > best[end + 1]:
                more = len(c.encode()) if self.bytewise else int(not run[end])
                best[end + 1], count[end + 1], run[end + 1] = best[end] + self.penalty, count[end] + more, True
        return count[n]

    def count(self, text: str | None) -> int:
        """Pieces of a text; a null or empty one has none. A run of unknown characters never spans words, as words begin with a blank."""
        return sum(map(self.count_word, words(text))) if text else 0

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Pieces of each text. Every distinct word is segmented once; its occurrences are added up by number."""
        word, ends, distinct = numbered(texts)
        order, (made,), slow = self.segmented(distinct, traced=False)
        counts = np.empty(len(distinct), np.int64)
        counts[order], counts[list(slow)] = made, [self.count_word(" " + w) for w in slow.values()]
        return np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(counts[word])])[ends]]))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers."""
        return b"".join(map(self.encode_word, words(text))) if text else b""

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text. Every distinct word is segmented once; its occurrences are filled in by number."""
        word, ends, distinct = numbered(texts)
        order, (made, sizes), slow = self.segmented(distinct, traced=True)
        other = [np.frombuffer(self.encode_word(" " + w), np.int32) for w in slow.values()]
        place = np.empty(len(distinct), np.int64)
        place[np.concatenate([order, np.array(list(slow), np.int64)])] = np.arange(len(distinct))
        flat, upto = gathered(np.concatenate([made, *other]), np.concatenate([sizes, np.array([len(x) for x in other], np.int64)]), place[word])
        edges = np.concatenate([[0], np.concatenate([[0], upto])[ends]])
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat))

    def segmented(self, distinct: pa.StringArray, traced: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...], dict[int, str]]:
        """Best segmentations of words, many at a time: which words, in order of length, and either their numbers of pieces
        or, if traced, their ids and how many ids each has. Very long words, and without byte pieces those with unknown
        characters, are left to the plain programme; they come back by number."""
        if not hasattr(self, "steps"):
            self.steps = _Steps(self)
        lengths = np.asarray(pc.utf8_length(distinct), np.int64)
        points = np.frombuffer(_bytes(distinct)[0].tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == 32] = ord(BLANK)
        begin = np.cumsum(lengths) - lengths
        fast = lengths < LONG
        owner = np.repeat(np.arange(len(lengths)), lengths)
        if not self.bytewise or BLANK not in self.single:
            fast[owner[~self.steps.single[points]]] = False
            fast &= BLANK in self.single
        order = np.flatnonzero(fast)
        order = order[np.argsort(-lengths[order], kind="stable")]
        made = [self.steps.run(points, begin[part], lengths[part], traced) for k in range(0, len(order), TOGETHER) for part in [order[k : k + TOGETHER]]]
        other = np.flatnonzero(~fast)
        slow = dict(zip(other.tolist(), distinct.take(pa.array(other)).to_pylist(), strict=True))
        none = np.zeros(0, np.int32)
        if not traced:
            return order, (np.concatenate([none, *made]),), slow
        return order, (np.concatenate([none, *[m[0] for m in made]]), np.concatenate([none.astype(np.int64), *[m[1] for m in made]])), slow

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, bytes decoded, the leading blank taken off."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")[1:]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of all pieces, the leading blank included."""
        return self.spelt(ids)[0].tobytes()

    def spelt(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces, and where each piece ends among them."""
        if not hasattr(self, "spelled"):
            own = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(BLANK, " ").encode() for p, _, k in self.table]
            self.spelled = np.frombuffer(b"".join(own), np.uint8), np.array([len(x) for x in own], np.int64)
        return gathered(*self.spelled, ids)

    def come_back(self, texts: pa.Array, coded: pa.ListArray) -> np.ndarray:
        """Whether each text equals the decoded ids, less the leading blank. All ids are decoded, and all bytes compared."""
        made, upto = self.spelt(np.asarray(coded.values)[coded.offsets[0].as_py() : coded.offsets[-1].as_py()])
        ids = np.asarray(coded.offsets, np.int64) - coded.offsets[0].as_py()
        texts = pc.fill_null(texts, "")
        full = np.asarray(pc.binary_length(texts), np.int64)
        begin = np.concatenate([[0], upto])[ids]
        size = np.diff(begin)
        right = size == full + (full > 0)
        data, edges = _bytes(texts)
        long = np.flatnonzero(right & (full > 0))
        if not len(long):
            return right
        right[long] &= made[begin[long]] == 32
        at = np.repeat(begin[long] + 1 - np.cumsum(full[long]) + full[long], full[long]) + np.arange(full[long].sum())
        own = data if len(long) == np.count_nonzero(full) else data[np.repeat(edges[long] - np.cumsum(full[long]) + full[long], full[long]) + np.arange(full[long].sum())]
        starts = np.cumsum(full[long]) - full[long]
        right[long] &= np.logical_and.reduceat(made[at] == own, starts)
        return right


class _Steps:
    """The Aho-Corasick automaton as arrays, and Viterbi's programme over many words at a time, a character of each at a step.

    Edges of the trie lie in an open hash table by node and character. Where a node has no edge, its failure link is followed.
    The matches that end at a step are the node, if it ends a piece, and those its links lead to, from the longest to the
    shortest; a shorter one replaces a longer one only if its sum is larger.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        below: dict[int, int] = {}
        up, depth, ends = [0], [0], [-1]
        for i, (piece, _, kind) in enumerate(vocab.table):
            if kind not in (NORMAL, USER) or not piece:
                continue
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                if key not in below:
                    below[key] = len(up)
                    up.append(key)
                    depth.append(depth[node] + 1)
                    ends.append(-1)
                node = below[key]
            ends[node] = i
        fail, link = [0] * len(up), [0] * len(up)
        for node in sorted(range(1, len(up)), key=depth.__getitem__):
            parent, c = up[node] >> 21, up[node] & 0x1FFFFF
            at = fail[parent]
            while at and at << 21 | c not in below:
                at = fail[at]
            fail[node] = below.get(at << 21 | c, 0) if parent else 0
            link[node] = fail[node] if ends[fail[node]] >= 0 else link[fail[node]]
        self.fail, self.link, self.depth, self.ends = np.array(fail), np.array(link), np.array(depth), np.array(ends, np.int32)
        self.first = np.where(self.ends >= 0, np.arange(len(up)), self.link)
        self.score = np.array([score for _, score, _ in vocab.table] or [0.0])
        self.size = np.array([*(len(piece) for piece, _, _ in vocab.table), 1])  # the last is an unknown character, -1
        self.penalty, self.bytes = vocab.penalty, np.array([vocab.byte.get(b, 0) for b in range(256)], np.int32)
        keys = np.fromiter(below, np.int64, len(below))
        nodes = np.fromiter(below.values(), np.int64, len(below))
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at = self._hash(keys)
        while len(keys):  # each free place takes one key, the others go on to the next place
            free = self.keys[at] < 0
            self.keys[at[free]], self.nodes[at[free]] = keys[free], nodes[free]
            rest = self.keys[at] != keys
            keys, nodes, at = keys[rest], nodes[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        single = np.array(sorted(map(ord, vocab.single)), np.int64)
        self.single = np.zeros(0x110000, bool)
        self.single[single] = True

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _edge(self, keys: np.ndarray) -> np.ndarray:
        """The node below, or 0."""
        at = self._hash(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.nodes[at], 0)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[todo]
            found[todo[hit]] = self.nodes[at[hit]]
            go = ~hit & (held >= 0)
            todo, at = todo[go], at[go]
        return found

    def _next(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        out = self._edge(node << 21 | point)
        todo = np.flatnonzero((out == 0) & (node > 0))
        node = node[todo]
        while len(todo):
            node = self.fail[node]
            found = self._edge(node << 21 | point[todo])
            out[todo] = found
            go = (found == 0) & (node > 0)
            todo, node = todo[go], node[go]
        return out

    def run(self, points: np.ndarray, begin: np.ndarray, lengths: np.ndarray, traced: bool):
        """Numbers of pieces of words, longest first, each with a blank before it; or their ids, and how many each has."""
        n, most = len(begin), int(lengths[0]) + 1
        best, held = np.full((most + 1, n), NEVER), np.zeros((most + 1, n), np.int32)
        best[0] = 0.0
        node = self._next(np.zeros(n, np.int64), np.full(n, ord(BLANK), np.int64))
        for p in range(most):
            if p:
                k = int(np.searchsorted(-lengths, -p, "right"))  # words that have a character here
                node = self._next(node[:k], points[begin[:k] + p - 1])
            at = self.first[node]
            w = np.flatnonzero(at)
            at = at[w]
            while len(w):
                i, start = self.ends[at], p + 1 - self.depth[at]
                total = best[start, w] + self.score[i]
                more = total > best[p + 1, w]
                best[p + 1, w[more]] = total[more]
                held[p + 1, w[more]] = i[more] if traced else held[start[more], w[more]] + 1
                at = self.link[at]
                go = at > 0
                w, at = w[go], at[go]
            if p:  # last, as it begins last
                point = points[begin[:k] + p - 1]
                w = np.flatnonzero(~self.single[point])
                w = w[best[p, w] + self.penalty > best[p + 1, w]]
                best[p + 1, w] = best[p, w] + self.penalty
                held[p + 1, w] = -1 if traced else held[p, w] + _width(point[w])
        if not traced:
            return held[lengths + 1, np.arange(n)]
        path = np.full((n, most), EMPTY, np.int32)
        w, at = np.arange(n), lengths + 1
        while len(w):
            i = held[at, w]
            at = at - self.size[i]
            path[w, at] = i
            go = at > 0
            w, at = w[go], at[go]
        row, column = np.nonzero(path != EMPTY)
        ids = path[row, column]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, np.bincount(row, minlength=n)
        point = points[begin[row[odd]] + column[odd] - 1]  # unknown characters become bytes
        times = np.ones(len(ids), np.int64)
        times[odd] = _width(point)
        out = np.repeat(ids, times)
        out[out < 0] = self.bytes[np.frombuffer(point.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)]
        return out, np.bincount(row, times, minlength=n).astype(np.int64)


def _width(point: np.ndarray) -> np.ndarray:
    """Bytes of a character."""
    return 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, none of which is null, and where each begins and ends among them."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, count=len(texts) + 1, offset=texts.offset * (8 if wide else 4)).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def gathered(data: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts that lie one after another in data, those that index names; and where each ends among them."""
    start = (np.cumsum(sizes) - sizes).astype(np.int64)
    size = sizes[index]
    ends = np.cumsum(size)
    at = np.repeat(start[index] - ends + size, size)
    at += np.arange(len(at))
    return data[at], ends


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """All words of all texts as numbers, where each text ends among them, and the distinct words, without the blank before them.

    A text without blanks at its ends or side by side is cut at its blanks by Arrow; the others go through words().
    """
    texts = pc.fill_null(texts, "").cast(pa.string())
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
    odd = np.asarray(pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))))
    plain = np.flatnonzero(~odd & ~empty)
    cut = pc.split_pattern(texts.take(pa.array(plain)) if len(plain) < len(texts) else texts, " ")
    other = [[w[1:] for w in words(t)] for t in texts.take(pa.array(np.flatnonzero(odd))).to_pylist()]
    flat = pa.chunked_array([cut.flatten().cast(pa.string()), pa.array([w for row in other for w in row], pa.string())]).combine_chunks()
    coded = flat.dictionary_encode()
    count = np.zeros(len(texts), np.int64)
    count[plain], count[odd] = np.asarray(pc.list_value_length(cut)), [len(row) for row in other]
    word = np.asarray(coded.indices, np.int64)
    if other:  # back into the order of the texts
        order, rank = np.concatenate([plain, np.flatnonzero(odd)]), np.empty(len(texts), np.int64)
        rank[order] = np.arange(len(order))
        word = gathered(word, count[order], rank[~empty])[0]
    return word, np.cumsum(count), coded.dictionary


def words(text: str) -> list[str]:
    """Words of a text, each with the blanks before it; the first has the leading blank that every text gets."""
    if "  " in text or text[0] == " " or text[-1] == " ":
        return WORDS.findall(" " + text)
    return (" " + text.replace(" ", "\x00 ")).split("\x00") if "\x00" not in text else WORDS.findall(" " + text)


#: Vocabularies that this process has prepared: tasks that share a worker share what it remembers.
_PREPARED: dict[str, Vocabulary] = {}


def vocabulary(path: str = MODEL) -> Vocabulary:
    """Read where the query is planned, and sent to the executors with the function: they need not see the file."""
    return Vocabulary(pieces(path))
