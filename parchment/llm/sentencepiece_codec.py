"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

A document of up to CHUNK characters is encoded as it is. A longer one is cut into chunks at fixed positions, whatever
stands there, and each chunk also sees the few characters after it that a piece can reach into. The state at a boundary is
how many characters of the next chunk the piece across it takes. Then, for all chunks of all documents at once:

1. each chunk gives a transfer matrix, best score from every entry state to every exit state;
2. the matrices of a document are combined in the max-plus semiring, which gives each chunk the scores of its entry states;
3. with these each chunk gives the entry state that every exit state goes back to; composed from the end of the document
   they tell each chunk its exit state;
4. each chunk is traced back by itself.

A matrix is needed up to a constant only, as one number for all entries and exits changes no choice: so the words between
the first and the last blank of a chunk, which every way goes through alike, are segmented in step 4 alone. Scores of a scan
are kept relative to the best entry, so their size does not grow with the document. Ties follow the same rule as in one
pass: a piece that begins in an earlier chunk begins earlier. Steps 1 to 3 read no text but what stands before a chunk's first
blank and after its last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import materialise, read, small_batches, spread
from parchment.llm.hashing import slices
from parchment.llm.unigram import BLANK, MODEL, NEVER, Vocabulary, vocabulary

#: Characters of a chunk.
CHUNK = 32_768


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: associative, so chunks combine in any grouping."""
    with np.errstate(invalid="ignore"):
        return (a[..., :, None] + b).max(axis=-2)


#: A place that no piece goes across: a blank after anything else.
CUT = re.compile("[^ ] ")


def _cuts(part: str, size: int) -> tuple[int, int] | tuple[None, None]:
    """First and last place inside that no piece goes across, if there is any."""
    first = CUT.search(part, 0, size)
    if first is None:
        return None, None
    last = part.rfind(" ", 0, size)
    while part[last - 1] == " ":
        last = part.rfind(" ", 0, last)
    return first.start() + 1, last


class Chunk:
    """One chunk: own characters, then those that a piece may reach into. Blanks are written as in the vocabulary."""

    def __init__(self, vocab: Vocabulary, part: str, size: int) -> None:
        self.vocab, self.size, (self.first, self.last) = vocab, size, _cuts(part, size)
        #: What stands before the first cut (everything if there is none), between the cuts, and after the last one.
        self.head = part[: self.first].replace(" ", BLANK)
        self.middle = part[self.first : self.last] if self.first is not None else ""
        self.tail = part[self.last :].replace(" ", BLANK) if self.first is not None else ""

    def matrix(self, states: int) -> np.ndarray:
        """Best score from every entry to every exit state; where there are cuts, less that of the words between them."""
        v, full = self.vocab, np.full((states, states), NEVER)
        if self.first is None:
            for s in range(min(states, self.size + 1)):
                best = v.forward(self.head, [NEVER] * s + [0.0], self.size)[0]
                out = best[self.size : self.size + states]
                full[s, : len(out)] = out
            return full
        head = np.full(states, NEVER)
        for s in range(min(states, self.first + 1)):
            head[s] = v.forward(self.head, [NEVER] * s + [0.0])[0][-1]
        end = self.size - self.last
        tail = v.forward(self.tail, None, end)[0][end:][:states]
        full[:, : len(tail)] = head[:, None] + np.array(tail)[None, :]
        return full

    def entry_of(self, entry: list[float], states: int) -> list[int]:
        """The entry state that each exit state goes back to; -1 where there is no way."""
        return entry_of(self.vocab, self.head, self.first is not None, self.size, entry, states)

    def ends(self, entry: list[float], leaving: int) -> tuple[list[int], list[int], int]:
        """Ids before and after the words between the cuts, and how many characters of this chunk the piece into it takes."""
        v = self.vocab
        if self.first is None:
            _, back, piece = v.forward(self.head, entry, self.size)
            state, steps = v.trace(back, piece, self.size + leaving)
            return v.emitted(self.head, steps), [], state
        _, back, piece = v.forward(self.head, entry)
        state, steps = v.trace(back, piece, self.first)
        end = self.size - self.last
        _, back, piece = v.forward(self.tail, None, end)
        return v.emitted(self.head, steps), v.emitted(self.tail, v.trace(back, piece, end + leaving)[1]), state

    def ids(self, entry: list[float], leaving: int) -> list[int]:
        before, after, _ = self.ends(entry, leaving)
        return before + np.frombuffer(self.vocab.encode(self.middle[1:]) if self.middle else b"", np.int32).tolist() + after


def entry_of(v: Vocabulary, head: str, cut: bool, size: int, entry: list[float], states: int) -> list[int]:
    if cut:
        _, back, piece = v.forward(head, entry)
        return [v.trace(back, piece, len(head))[0]] * states
    best, back, piece = v.forward(head, entry, size)
    return [v.trace(back, piece, size + t)[0] if size + t < len(best) and best[size + t] > NEVER else -1 for t in range(states)]


def entries(matrices: list[np.ndarray], states: int) -> list[np.ndarray]:
    """Scores of each chunk's entry states: a prefix scan, relative to the best."""
    at = np.full(states, NEVER)
    at[0], found = 0.0, []
    for m in matrices:
        found.append(at)
        at = compose(at, m)
        at = at - at.max()
    return found


def leavings(maps: list[list[int]]) -> list[int]:
    """Exit state of each chunk, from the end of the document back."""
    state, found = 0, []
    for m in reversed(maps):
        found.append(state)
        state = m[state]
    return found[::-1]


def joined(parts: list[list[int]], vocab: Vocabulary) -> list[int]:
    out: list[int] = []
    for ids in parts:
        run = bool(out and ids) and not vocab.bytewise and out[-1] == ids[0] == vocab.unknown  # a run of unknown characters is one piece
        out += ids[1:] if run else ids
    return out


def _ints(coded: list[bytes]) -> pa.Array:
    """Lists of ids from their bytes."""
    sizes = np.cumsum([0, *map(len, coded)]) // 4
    return pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _split(vocab: Vocabulary, chunk: int, states: int):
    """Chunks of giants with their matrices, a megabyte of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocab.prepare()
        for batch in batches:
            for uid, doc_id, text in zip(batch["uid"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text, rows = " " + text.as_py(), []
                for i in range(0, len(text), chunk):
                    part, size = text[i : i + chunk + states - 1], min(chunk, len(text) - i)
                    made = Chunk(own, part, size)
                    rows.append({"uid": uid, "doc_id": doc_id, "at": i // chunk, "part": part, "size": size, "head": made.head, "cut": made.first is not None, "matrix": made.matrix(states).tobytes()})
                    if len(rows) * chunk >= 1 << 20 or i + chunk >= len(text):
                        yield pa.RecordBatch.from_pylist(rows, _CHUNKS)
                        rows = []

    return run


_CHUNKS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("part", pa.string()), ("size", pa.int32()), ("head", pa.string()), ("cut", pa.bool_()), ("matrix", pa.binary())])


def _scan(giants: DataFrame, vocab: Vocabulary, chunk: int, check: bool) -> DataFrame:
    """(doc_id, ids[, n_pieces, round_trip]) of giants (uid, doc_id, text)."""
    states = max(len(p) for p, _, kind in vocab.table)
    chunks = materialise(giants.mapInArrow(_split(vocab, chunk, states), "uid long, doc_id long, at int, part string, size int, head string, cut boolean, matrix binary"))

    def prefix(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        found = entries([np.frombuffer(m).reshape(states, states) for m in table["matrix"].to_pylist()], states)
        return pa.table({"uid": table["uid"], "at": table["at"], "entry": [e.tolist() for e in found]})

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocab.prepare()
        for b in batches:
            m = [entry_of(own, r["head"], r["cut"], r["size"], r["entry"], states) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b["uid"], b["at"], b["entry"], pa.array(m, pa.list_(pa.int32()))], ["uid", "at", "entry", "map"])

    def suffix(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        return table.drop_columns(["map"]).append_column("leaving", pa.array(leavings(table["map"].to_pylist()), pa.int32()))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocab.prepare()
        for b in batches:
            for part in slices(b["part"]):
                rows = b.slice(part.offset - b["part"].offset, len(part)).drop_columns(["part"])
                cut = [Chunk(own, p, n) for p, n in zip(part.to_pylist(), rows["size"].to_pylist(), strict=True)]
                inner = own.encode_all(pa.array([c.middle[1:] for c in cut], pa.string()))
                flat, edges = np.asarray(inner.values), np.asarray(inner.offsets)
                ids, spans = [], []
                for k, (c, entry, leaving) in enumerate(zip(cut, rows["entry"].to_pylist(), rows["leaving"].to_pylist(), strict=True)):
                    before, after, state = c.ends(entry, leaving)
                    ids.append(_packed(before) + (flat[edges[k] : edges[k + 1]].tobytes() if c.middle else b"") + _packed(after))
                    spans.append(part[k].as_py()[state : c.size + leaving])
                # of a chunk: its own characters but those that the piece into it takes, and what its last piece reaches into
                same = [own.decode_bytes(np.frombuffer(i, np.int32)) == x.encode() for i, x in zip(ids, spans, strict=True)] if check else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([rows["uid"], rows["doc_id"], rows["at"], _ints(ids), pa.array(same, pa.bool_())], ["uid", "doc_id", "at", "ids", "same"])

    def together(table: pa.Table) -> pa.Table:
        own = vocab.prepare()
        table = table.sort_by("at")
        ids = _ints([_packed(joined(table["ids"].to_pylist(), own))]) if not own.bytewise else _ints([b"".join(np.asarray(x.values, np.int32).tobytes() for x in table["ids"])])
        done = {"doc_id": table["doc_id"][:1], "ids": ids}
        return pa.table(done | ({"n_pieces": pa.array([len(ids.values)], pa.int32()), "round_trip": [all(table["same"].to_pylist())]} if check else {}))

    # matrices, heads and states are light; the text of a chunk moves once, to where it is traced
    entry = chunks.select("uid", "at", "matrix").groupBy("uid").applyInArrow(prefix, "uid long, at int, entry array<double>")
    light = chunks.select("uid", "at", "head", "cut", "size").join(entry, ["uid", "at"])
    leaving = light.mapInArrow(maps, "uid long, at int, entry array<double>, map array<int>").groupBy("uid").applyInArrow(suffix, "uid long, at int, entry array<double>, leaving int")
    ids = chunks.select("uid", "doc_id", "at", "part", "size").join(leaving, ["uid", "at"]).mapInArrow(traced, "uid long, doc_id long, at int, ids array<int>, same boolean")
    extra = ", n_pieces int, round_trip boolean" if check else ""
    return ids.groupBy("uid").applyInArrow(together, f"doc_id long, ids array<int>{extra}")


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """doc_id and ids for each row of docs; with check also n_pieces and round_trip, whether decoding gives the text back.

    A null or empty text has no ids, and decodes to the empty text. Repeated rows and rows of null id each get their ids; an
    empty table gives an empty result; other columns play no part.
    """
    small_batches(docs.sparkSession)
    vocab = vocabulary(model)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    extra = ", n_pieces int, round_trip boolean" if check else ""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocab.prepare()
        for b in batches:
            done = 0
            for texts in slices(b["text"]):
                ids, coded = b["doc_id"].slice(done, len(texts)), own.encode_all(texts)
                done += len(texts)
                if check:
                    sizes = pa.array(np.diff(np.asarray(coded.offsets)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([ids, coded, sizes, pa.array(own.come_back(texts, coded))], ["doc_id", "ids", "n_pieces", "round_trip"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, coded], ["doc_id", "ids"])

    short = spread(base.where(~giant)).mapInArrow(whole, f"doc_id long, ids array<int>{extra}")
    giants = spread(base.where(giant)).withColumn("uid", F.monotonically_increasing_id())
    return short.unionByName(_scan(giants.select("uid", "doc_id", "text"), vocab, chunk, check))


def decode(coded: DataFrame, model: str = MODEL, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text for each row of coded; null ids decode to null. A null inside ids, or an id outside the vocabulary, counts for nothing."""
    small_batches(coded.sparkSession)
    vocab = vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own = len(vocab.table), vocab.prepare()
        for b in batches:
            texts = [None if row is None else own.decode([i for i in row if i is not None and 0 <= i < n]) for row in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents", "doc_id", "text"), check=True)
