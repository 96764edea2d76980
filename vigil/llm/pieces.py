"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The pieces of a vocabulary file form one automaton over UTF-8 bytes (a piece's
word mark is a blank in it). A single pass over a text follows the automaton;
at the end of every character the output links list all pieces that end there,
longest first, and each relaxes the best score of that position. A character
without a piece of its own gets the unknown score and is written as byte
pieces. Walking the best pieces back gives the segmentation of highest total
score; on equal scores the longer last piece wins.

No piece has a blank after another character, so a text falls into chunks (a
run of blanks and what follows up to the next blank) that are segmented
independently, and equal chunks of a batch once. The pass runs over all distinct
chunks of a batch at a time, a column of bytes per step.

Encoding puts one blank before a text that is not empty, as the vocabulary
expects; decoding removes it. Decoding an encoding gives the text back, byte
for byte, for every text (blanks in runs, controls, literal word marks too).

Defined cases: null and empty texts have no ids, score 0 and decode to an empty
text; texts of any length are segmented whole; repeated rows get equal results;
an empty table gives an empty result; further columns are carried along.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches

#: Bytes of text that are segmented together, and longest chunk of the column
#: pass (longer chunks go byte by byte through the same automaton).
TOGETHER = 4_000_000
LONGEST = 64
ROWS = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def default_vocabulary() -> str:
    return os.environ.get("VIGIL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


class Pieces:
    """Pieces, scores and their automaton. ``pieces`` are bytes with the word
    mark as a blank; ``byte_ids`` are the ids of the 256 byte pieces, if any."""

    def __init__(self, pieces: list[bytes], ids: list[int], scores: list[float],
                 byte_ids: list[int] | None, unknown: int = 0, penalty: float = 10.0,
                 shown: dict[int, bytes] | None = None):
        self.ids = np.array(ids, np.int32)
        self.length = np.array([len(p) for p in pieces], np.int32)
        self.score = np.array(scores, np.float64)
        self.byte_ids = None if byte_ids is None else np.array(byte_ids, np.int32)
        self.unknown = unknown
        self.unknown_score = float(min(scores, default=0.0)) - penalty
        # Text of every id for decoding: special pieces show nothing.
        text = dict(shown or {}) | dict(zip(ids, pieces))
        for b, i in enumerate(byte_ids or []):
            text[i] = bytes([b])
        top = max(text, default=0) + 1
        each = [text.get(i, b"") for i in range(top)]
        self.shown_length = np.array([len(x) for x in each], np.int64)
        self.shown = np.frombuffer(b"".join(each) or b"\0", np.uint8)
        self.shown_at = np.concatenate(([0], np.cumsum(self.shown_length)[:-1]))
        # Trie as parallel lists: parent node, byte, piece ending here.
        child: dict[tuple[int, int], int] = {}
        end: list[int] = [-1]
        for k, piece in enumerate(pieces):
            at = 0
            for b in piece:
                nxt = child.get((at, b))
                if nxt is None:
                    nxt = child[at, b] = len(end)
                    end.append(-1)
                at = nxt
            if at and (end[at] < 0 or scores[k] > scores[end[at]]):
                end[at] = k
        self.edges = np.array([(p, b, c) for (p, b), c in child.items()], np.int32).reshape(-1, 3)
        self.end = np.array(end, np.int32)
        self._made = None

    @classmethod
    def from_model(cls, model: bytes) -> Pieces:
        """From the bytes of a vocabulary file."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        byte_ids = [i for i in range(n) if m.is_byte(i)]
        return cls([m.id_to_piece(i).replace("▁", " ").encode() for i in plain], plain,
                   [m.get_score(i) for i in plain], byte_ids if len(byte_ids) == 256 else None,
                   max(0, m.unk_id()))

    def automaton(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Transitions with failure links resolved (state * 256 + byte), first
        node with a piece on a state's suffix chain, and the next such node."""
        if self._made is None:
            n = len(self.end)
            step = np.zeros((n, 256), np.int32)
            by_parent: dict[int, list[tuple[int, int]]] = {}
            for p, b, c in self.edges.tolist():
                by_parent.setdefault(p, []).append((b, c))
            fail, link = np.zeros(n, np.int32), np.zeros(n, np.int32)
            level = [0]
            while level:
                below = []
                for s in level:
                    if s:
                        step[s] = step[fail[s]]
                    for b, c in by_parent.get(s, ()):
                        fail[c] = step[s, b] if s else 0
                        step[s, b] = c
                        below.append(c)
                for c in below:
                    f = fail[c]
                    link[c] = f if self.end[f] >= 0 else link[f]
                level = below
            first = np.where(self.end >= 0, np.arange(n, dtype=np.int32), link)
            self._made = step.ravel(), first, link
        return self._made

    # One chunk, byte by byte: the plain form of the pass.
    def best_path(self, raw: bytes) -> tuple[list[int], float]:
        step, first, link = self.automaton()
        n, state, start = len(raw), 0, 0
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for t, b in enumerate(raw):
            state = int(step[state * 256 + b])
            if not b & 0x40 or b < 0x80:
                pass
            if b & 0xC0 != 0x80:
                start = t
            if t + 1 < n and raw[t + 1] & 0xC0 == 0x80:
                continue
            single, node = False, int(first[state])
            while node:
                k = int(self.end[node])
                size = int(self.length[k])
                got = best[t + 1 - size] + self.score[k]
                if got > best[t + 1]:
                    best[t + 1], back[t + 1] = got, k
                single |= size == t + 1 - start
                node = int(link[node])
            if not single and best[start] + self.unknown_score > best[t + 1]:
                best[t + 1], back[t + 1] = best[start] + self.unknown_score, start - t - 1
        out: list[int] = []
        while n:
            k = back[n]
            if k >= 0:
                out.append(int(self.ids[k]))
                n -= int(self.length[k])
            else:
                out += self._bytes_of(raw[n + k:n])[::-1]
                n += k
        return out[::-1], float(best[len(raw)])

    def _bytes_of(self, raw: bytes) -> list[int]:
        return [self.unknown] if self.byte_ids is None else self.byte_ids[list(raw)].tolist()

    def _columns(self, chunks: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments ``chunks`` (rows of padded bytes, longest first): flat ids,
        number of ids and score per row."""
        step, first, link = self.automaton()
        rows, width = chunks.shape
        best = np.full((rows, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((rows, width + 1), np.int32)
        state, start = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for t in range(width):
            live = int(np.searchsorted(-size, -t, side="left"))  # rows longer than t
            if not live:
                break
            b = chunks[:live, t]
            state[:live] = step[state[:live] * 256 + b]
            lead = (b & 0xC0) != 0x80
            start[:live][lead] = t
            last = np.ones(live, bool) if t + 1 == width else (
                ((chunks[:live, t + 1] & 0xC0) != 0x80) | (size[:live] == t + 1))
            at = np.flatnonzero(last)
            node = first[state[at]]
            shortest = np.zeros(len(at), np.int64)
            top, arg = np.full(len(at), -np.inf), np.zeros(len(at), np.int32)
            on = np.flatnonzero(node)
            while len(on):
                k = self.end[node[on]]
                long = self.length[k]
                got = best[at[on], t + 1 - long] + self.score[k]
                more = got > top[on]
                top[on[more]], arg[on[more]] = got[more], k[more]
                shortest[on] = long
                node[on] = link[node[on]]
                on = on[node[on] > 0]
            own = t + 1 - start[at]
            odd = np.flatnonzero(shortest != own)
            if len(odd):
                got = best[at[odd], start[at[odd]]] + self.unknown_score
                more = got > top[odd]
                top[odd[more]], arg[odd[more]] = got[more], -own[odd[more]]
            best[at, t + 1], back[at, t + 1] = top, arg
        # Back from every row's end; steps are kept and then laid out.
        place, taken = size.astype(np.int64).copy(), np.zeros(rows, np.int64)
        steps, on = [], np.flatnonzero(place)
        while len(on):
            k = back[on, place[on]]
            plain = k >= 0
            r, p = on[plain], k[plain]
            steps.append((r, taken[r].copy(), self.ids[p]))
            taken[r] += 1
            place[r] -= self.length[p]
            if not plain.all():
                r, n = on[~plain], -k[~plain].astype(np.int64)
                if self.byte_ids is None:
                    steps.append((r, taken[r].copy(), np.full(len(r), self.unknown, np.int32)))
                    taken[r] += 1
                else:
                    for j in range(int(n.max())):
                        q = r[n > j]
                        steps.append((q, taken[q].copy(), self.byte_ids[chunks[q, place[q] - 1 - j]]))
                        taken[q] += 1
                place[r] -= n
            on = on[place[on] > 0]
        ends = np.cumsum(taken)
        flat = np.zeros(int(ends[-1]) if rows else 0, np.int32)
        for r, j, i in steps:
            flat[ends[r] - 1 - j] = i
        return flat, taken, best[np.arange(rows), size]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, their number and score per text."""
        ids, counts, scores = [np.zeros(0, np.int32)], [], []
        group, held = [], 0
        for i, t in enumerate(texts):
            group.append(b" " + t if t else b"")
            held += len(t) + 1
            if held >= TOGETHER or i + 1 == len(texts):
                a, b, c = self._together(group)
                ids.append(a)
                counts.append(b)
                scores.append(c)
                group, held = [], 0
        none = [np.zeros(0, np.int64)]
        return np.concatenate(ids), np.concatenate(counts or none), np.concatenate(scores or none)

    def _together(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = b"".join(raws)
        sizes = np.array([len(r) for r in raws], np.int64)
        zero = np.zeros(len(raws), np.int64)
        if not data:
            return np.zeros(0, np.int32), zero, zero.astype(np.float64)
        b = np.frombuffer(data, np.uint8)
        blank = b == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        text_at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        opens[text_at[sizes > 0]] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, len(b)))
        kind, which = _distinct(b, start, size)
        order = np.argsort(-size[kind], kind="stable")
        kind = kind[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which = rank[which]
        flat, taken, score = [], np.zeros(len(kind), np.int64), np.zeros(len(kind))
        at = 0
        while at < len(kind) and size[kind[at]] > LONGEST:
            s = start[kind[at]]
            got, score[at] = self.best_path(data[s:s + size[kind[at]]])
            taken[at] = len(got)
            flat.append(np.array(got, np.int32))
            at += 1
        while at < len(kind):
            own = kind[at:at + ROWS]
            width = int(size[own[0]])
            padded = np.concatenate((b, np.zeros(width, np.uint8))) if start[own].max() + width > len(b) else b
            cells = padded[start[own][:, None] + np.arange(width)]
            got, taken[at:at + len(own)], score[at:at + len(own)] = self._columns(cells, size[own])
            flat.append(got)
            at += len(own)
        pool, offset = np.concatenate(flat), np.concatenate(([0], np.cumsum(taken)[:-1]))
        n = taken[which]
        ids = pool[_runs(offset[which], n)]
        owner = np.searchsorted(text_at[sizes > 0], start, side="right") - 1
        real = np.flatnonzero(sizes > 0)
        counts, total = zero.copy(), zero.astype(np.float64)
        counts[real] = np.bincount(owner, n, len(real)).astype(np.int64)
        total[real] = np.bincount(owner, score[which], len(real))
        return ids, counts, total

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of consecutive runs of ids, without the blank put before."""
        long = self.shown_length[ids]
        data = self.shown[_runs(self.shown_at[ids], long)].tobytes()
        ends = np.concatenate(([0], np.cumsum(long)))[np.cumsum(counts)] if len(counts) else []
        out, at = [], 0
        for e in ends:
            piece = data[at:e]
            out.append(piece[1:] if piece[:1] == b" " else piece)
            at = int(e)
        return out


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] values), start[1], ... as one array."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - n), n)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _distinct(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first place of every distinct chunk, and which of them each chunk is.
    Chunks are told apart by hash and compared byte for byte afterwards."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(len(b), _BASE), out=sums[1:])
        h = (sums[start + size] - sums[start]) * _powers(len(b), _INVERSE)[start]
        h ^= h >> np.uint64(32)
        h = h * np.uint64(_BASE) + size.astype(np.uint64)
    _, kind, which = np.unique(h, return_index=True, return_inverse=True)
    other = start[kind][which]
    place = _runs(start, size)
    if (size[kind][which] != size).any() or (b[place] != b[_runs(other, size)]).any():
        at: dict[bytes, int] = {}  # equal hashes of different chunks: by their bytes
        which = np.array([at.setdefault(b[s:s + n].tobytes(), len(at)) for s, n in zip(start, size)])
        kind = np.unique(which, return_index=True)[1]
    return kind, which


def encode_texts(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text",
                 carry: list[str] | None = None, check: bool = True) -> DataFrame:
    """``carry`` columns (all by default) with n_pieces, piece_ids, score and
    round_trip (decoding gives the text back)."""
    small_batches(docs.sparkSession, 2000)
    carry = docs.columns if carry is None else carry
    with open(vocabulary or default_vocabulary(), "rb") as f:
        made = Pieces.from_model(f.read())
    # Bounded by the vocabulary file; each worker expands the automaton once.
    shared = docs.sparkSession.sparkContext.broadcast(made)
    taken = list(carry)
    new = [free_name(taken, c) for c in ("n_pieces", "piece_ids", "score", "round_trip")]
    kinds = [T.LongType(), T.ArrayType(T.IntegerType()), T.DoubleType(), T.BooleanType()]
    inner = [T.StructField(f"c{i}_", docs.schema[c].dataType) for i, c in enumerate(carry)]
    schema = T.StructType(inner + [T.StructField(f"x{i}_", k) for i, k in enumerate(kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            at = 0
            while at < len(texts):  # few texts at a time: bounded memory
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= TOGETHER):
                    held += len(texts[to])
                    to += 1
                part = texts[at:to]
                ids, counts, scores = pieces.encode(part)
                same = [a == b for a, b in zip(pieces.decode(ids, counts), part)] if check else None
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(at, to - at) for i in range(batch.num_columns - 1)] + [
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())),
                        pa.array(scores, pa.float64()),
                        pa.array(same if check else [None] * len(part), pa.bool_())],
                    names=schema.names)
                at = to

    out = docs.select(*[F.col(c).alias(f.name) for c, f in zip(carry, inner)],
                      F.col(text_col).cast("binary").alias("x_text")).mapInArrow(run, schema)
    return out.toDF(*carry, *new)


def decode_ids(rows: DataFrame, ids_col: str = "piece_ids", vocabulary: str | None = None,
               out_col: str = "text") -> DataFrame:
    """Texts of the ids in ``ids_col`` (null: null) as ``out_col``."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(Pieces.from_model(f.read()))
    name = free_name(rows.columns, out_col)
    inner = [T.StructField(f"c{i}_", f.dataType) for i, f in enumerate(rows.schema.fields)]
    schema = T.StructType(inner + [T.StructField("x_text", T.BinaryType())])
    where = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            lists = batch.column(where)
            counts = np.array([0 if x is None else len(x) for x in lists], np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pieces.decode(ids, counts)
            texts = [t if v else None for t, v in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())],
                                             names=schema.names)

    out = rows.toDF(*[f.name for f in inner]).mapInArrow(run, schema)
    return out.withColumn("x_text", F.col("x_text").cast("string")).toDF(*rows.columns, name)
