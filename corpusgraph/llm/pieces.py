"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces of a public SentencePiece vocabulary span a lattice over a text's UTF-8 bytes (the
space mark stands for a space byte; characters that aren't pieces fall back to byte pieces).
A piece weighs ``-theta log(rank)``. The forward pass sums the weights of all ways to reach
each node; the backward pass walks from the end and draws each incoming piece with its exact
share of that sum, so a segmentation comes out with its probability under the model. A draw
depends on the row's key and the node's byte offset alone, hence on neither batches, tasks nor
retries. Decoding joins the pieces' bytes and gives back every text exactly.

No piece crosses from a non-space to a space or holds a line end, so the lattice falls apart
into units (a run of spaces with the word behind it); sampling each unit on its own is sampling
the whole lattice. A batch's distinct units are laid out column by column and filtered together
in numpy; draws for all occurrences are made in step.

A long unit (a blob without spaces) is first cut at nodes that no piece crosses, which all paths
share. What stays longer than ``GIANT`` bytes is filtered in windows: the forward pass keeps the
sums at the windows' edges only, and the backward pass makes each window's sums again before it
samples through it. So memory is bounded by a window and draws have the same distribution.

Defined cases: a null text has null ids and no pieces and decodes to null; an empty text has
no pieces; a null key is a key like any other; rows of equal text and key are segmented alike;
very long texts are encoded whole, in time linear in their length, ``CHUNK`` bytes at a time;
other columns pass through, but one with the name of a result gives way to it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import col, map_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_WEIGHT = -12.0
MULT = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 17
#: Bytes of text encoded together; a batch takes about a hundred times that in memory.
BATCH = 3 << 19
CHUNK = 1 << 20
LONG, GIANT, WINDOW = 512, 8192, 1 << 15


class Vocabulary:
    """Pieces as bytes with weights, and a two-choice hash table of all their prefixes."""

    def __init__(self, pieces: list[tuple[int, bytes]], byte_ids: list[int], theta: float = 1.0):
        self.bytes_of: dict[int, bytes] = {i: b for i, b in pieces}
        self.bytes_of.update({i: bytes([b]) for b, i in enumerate(byte_ids)})
        for _, b in pieces:
            if b" " in b.lstrip(b" ") or b"\n" in b:
                raise ValueError("pieces with inner spaces or line ends aren't supported")
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        self.weight = np.full(max(self.bytes_of) + 1, BYTE_WEIGHT)
        for rank, (i, _) in enumerate(sorted(pieces), 1):
            self.weight[i] = -theta * np.log(rank + 1)
        ids = {b: i for i, b in pieces}
        prefixes = {b[:n] for b in ids for n in range(1, len(b) + 1)}
        self.longest = max(map(len, ids))
        self._fill({self.hash(p): ids.get(p, -1) for p in prefixes}, len(prefixes))

    @staticmethod
    def hash(b: bytes) -> int:
        h = 0
        for x in b:
            h = ((h ^ x) * int(MULT) + 0x7F4A7C15) & (2**64 - 1)
        return h

    def _fill(self, entries: dict[int, int], n: int) -> None:
        if len(entries) != n:
            raise ValueError("two prefixes share a hash")
        size = 1 << SLOT_BITS
        keys, values = np.zeros(2 * size, dtype=np.uint64), np.full(2 * size, -2, dtype=np.int32)
        for h, v in entries.items():
            for _ in range(500):
                at = self._slots(h)[0]
                if values[at] == -2:
                    keys[at], values[at] = h, v
                    break
                (h, v), keys[at], values[at] = (int(keys[at]), int(values[at])), h, v
                other = self._slots(h)[1] if self._slots(h)[0] == at else self._slots(h)[0]
                if values[other] == -2:
                    keys[other], values[other] = h, v
                    break
                (h, v), keys[other], values[other] = (int(keys[other]), int(values[other])), h, v
            else:
                raise ValueError("the table is too full")
        self.keys, self.values = keys, values

    @staticmethod
    def _slots(h: int) -> tuple[int, int]:
        size = 1 << SLOT_BITS
        return h >> (64 - SLOT_BITS), size + ((h >> 8) & (size - 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a mere prefix, -2 for neither."""
        a = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.where(self.keys[a] == h, self.values[a], np.int32(-2))
        miss = np.flatnonzero(out == -2)
        if len(miss):
            b = (1 << SLOT_BITS) + ((h[miss] >> np.uint64(8)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            out[miss] = np.where(self.keys[b] == h[miss], self.values[b], np.int32(-2))
        return out


def load(path: str = MODEL, theta: float = 1.0) -> Vocabulary:
    """Vocabulary of a SentencePiece model file; read on the driver, then broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces.append((i, piece.replace("▁", " ").encode("utf-8")))
    return Vocabulary(pieces, byte_ids, theta)


UNIT = re.compile(rb" *[^ \n]+|\n| +")
BETWEEN = re.compile(rb"\n|[^ \n](?= )")
CHAR_BYTES = np.array([1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], dtype=np.int64)


class Lattice:
    """Forward-filtered lattices of distinct units, longest first.

    Node (unit u, offset j) has index ``first[j] + u``; the units that reach offset j are a
    prefix of all, so every column is contiguous and edges sort by their end node.
    """

    def __init__(self, units: list[bytes], v: Vocabulary):
        lengths = np.array([len(x) for x in units], dtype=np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.rank = np.empty(len(units), dtype=np.int64)
        self.rank[self.order] = np.arange(len(units))
        n, longest = len(units), int(lengths.max(initial=0))
        reach = np.searchsorted(-self.lengths, -np.arange(longest + 1), side="right")
        reach[0] = n
        self.first = np.concatenate([[0], np.cumsum(reach)])
        flat = np.frombuffer(b"".join(units[i] for i in self.order), dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int32)
        n_pos = int(self.first[longest + 1]) - n
        first = self.first.astype(np.int32)
        offset = np.repeat(np.arange(longest, dtype=np.int32), reach[1:])
        unit = np.arange(n_pos, dtype=np.int32) - (first[1 : longest + 1] - n)[offset]
        source = first[offset] + unit
        place = begins[unit] + offset
        rest = self.lengths.astype(np.int32)[unit] - offset
        codes = flat[place]
        starts, ends, ids, spans = [], [], [], []
        has_char = np.zeros(n_pos, dtype=bool)
        need = CHAR_BYTES[codes]
        at, ahead = np.arange(n_pos, dtype=np.int32), place
        h = np.zeros(n_pos, dtype=np.uint64)
        for length in range(1, v.longest + 1):
            if length > 1:
                inside = np.flatnonzero(rest[at] >= length)
                at, ahead, h = at[inside], ahead[inside], h[inside]
            if not len(at):
                break
            h = (h ^ flat[ahead + (length - 1)].astype(np.uint64)) * MULT + np.uint64(0x7F4A7C15)
            got = v.find(h)
            hit = np.flatnonzero(got >= 0)
            p = at[hit]
            starts.append(source[p])
            ends.append(first[offset[p] + length] + unit[p])
            ids.append(got[hit])
            spans.append(np.full(len(p), length, dtype=np.int8))
            has_char[p[need[p] == length]] = True
            alive = np.flatnonzero(got != -2)
            at, ahead, h = at[alive], ahead[alive], h[alive]
        # Bytes of characters that aren't pieces; a continuation byte never begins a character.
        lone = np.flatnonzero(~has_char & ((codes < 0x80) | (codes >= 0xC0)))
        for k in range(4):
            p = lone[(need[lone] > k) & (rest[lone] > k)]
            starts.append(first[offset[p] + k] + unit[p])
            ends.append(first[offset[p] + k + 1] + unit[p])
            ids.append(v.byte_ids[flat[place[p] + k]])
            spans.append(np.ones(len(p), dtype=np.int8))
        end = np.concatenate(ends)
        by_end = np.argsort(end, kind="stable")
        end, self.start, self.ids, self.span = end[by_end], np.concatenate(starts)[by_end], np.concatenate(ids)[by_end], np.concatenate(spans)[by_end]
        n_nodes = int(self.first[-1])
        self.group = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, dtype=np.int64)
        self.group_end = np.concatenate([self.group[1:], [len(end)]])
        nodes = end[self.group]
        self.edge_of = np.full(n_nodes, -1, dtype=np.int32)
        self.edge_of[nodes] = self.group
        self._filter(nodes, v.weight[self.ids], n_nodes, n, longest)

    def _filter(self, nodes, weight, n_nodes: int, n: int, longest: int) -> None:
        alpha = np.full(n_nodes, -np.inf)
        alpha[:n] = 0.0
        share = np.zeros(len(weight))
        cuts = np.searchsorted(nodes, self.first[1 : longest + 2])
        for j in range(longest):
            g0, g1 = cuts[j], cuts[j + 1]
            if g0 == g1:
                continue
            e0, e1 = self.group[g0], self.group_end[g1 - 1]
            c = alpha[self.start[e0:e1]] + weight[e0:e1]
            local, sizes = self.group[g0:g1] - e0, self.group_end[g0:g1] - self.group[g0:g1]
            top = np.maximum.reduceat(c, local)
            safe = np.where(np.isfinite(top), top, 0.0)
            x = np.exp(c - np.repeat(safe, sizes))
            total = np.add.reduceat(x, local)
            with np.errstate(divide="ignore"):
                alpha[nodes[g0:g1]] = safe + np.log(total)
            share[e0:e1] = x / np.repeat(np.where(total > 0, total, 1.0), sizes)
        # Running shares within each node's edges, summed edge by edge, so that they don't
        # depend on what else the lattice holds; the last takes whatever rounding leaves.
        self.upto = share
        sizes = self.group_end - self.group
        on, k = self.group[sizes > 1], 1
        sizes = sizes[sizes > 1]
        while len(on):
            share[on + k] += share[on + k - 1]
            k += 1
            more = sizes > k
            on, sizes = on[more], sizes[more]
        self.upto[self.group_end - 1] = 2.0

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An incoming edge of each node, drawn with its share of the forward sum."""
        e = self.edge_of[node]
        on = np.flatnonzero(u >= self.upto[e])
        while len(on):
            e[on] += 1
            on = on[u[on] >= self.upto[e[on]]]
        return e


def uniform(seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counter-based uniforms in [0, 1) by splitmix64."""
    z = seed.astype(np.uint64) + (at.astype(np.uint64) + np.uint64(1)) * MULT
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def matches(v: Vocabulary, flat: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, id) of all edges that start in [lo, hi); ``flat`` holds a unit's bytes."""
    codes, n = flat[lo:hi], len(flat)
    starts, spans, ids = [], [], []
    at, h = np.arange(lo, hi), np.zeros(hi - lo, dtype=np.uint64)
    has_char, need = np.zeros(hi - lo, dtype=bool), CHAR_BYTES[codes]
    for length in range(1, v.longest + 1):
        inside = at + length <= n
        at, h = at[inside], h[inside]
        if not len(at):
            break
        h = (h ^ flat[at + (length - 1)].astype(np.uint64)) * MULT + np.uint64(0x7F4A7C15)
        got = v.find(h)
        hit = got >= 0
        starts.append(at[hit])
        spans.append(np.full(int(hit.sum()), length, dtype=np.int64))
        ids.append(got[hit])
        has_char[at[hit][need[at[hit] - lo] == length] - lo] = True
        alive = got != -2
        at, h = at[alive], h[alive]
    lone = lo + np.flatnonzero(~has_char & ((codes < 0x80) | (codes >= 0xC0)))
    for k in range(4):
        p = lone[(need[lone - lo] > k) & (lone + k < n)] + k
        starts.append(p)
        spans.append(np.ones(len(p), dtype=np.int64))
        ids.append(v.byte_ids[flat[p]])
    return np.concatenate(starts), np.concatenate(spans), np.concatenate(ids)


def cut_up(unit: bytes, v: Vocabulary) -> list[bytes]:
    """The unit in parts at the nodes that no edge crosses."""
    flat = np.frombuffer(unit, dtype=np.uint8)
    reach = np.zeros(len(flat) + 1, dtype=np.int64)
    for lo in range(0, len(flat), WINDOW):
        start, span, _ = matches(v, flat, lo, min(len(flat), lo + WINDOW))
        np.maximum.at(reach, start, start + span)
    far = np.maximum.accumulate(reach[:-1])
    # Byte pieces of a character stay together.
    begins = np.append((flat[1:] & 0xC0) != 0x80, True)
    ends = (np.flatnonzero((far <= np.arange(1, len(flat) + 1)) & begins) + 1).tolist()
    return [unit[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Giant:
    """A unit whose lattice is too large to hold: sums at the edges of windows, made once."""

    def __init__(self, unit: bytes, v: Vocabulary):
        self.v, self.flat, self.n = v, np.frombuffer(unit, dtype=np.uint8), len(unit)
        self.held = {0: {0: 0.0}}
        for lo in range(0, self.n, WINDOW):
            sums = self._sums(lo)[0]
            edge = min(self.n, lo + WINDOW)
            self.held[edge] = {j: sums[j] for j in range(max(0, edge - v.longest), edge + 1) if j in sums}

    def _sums(self, lo: int) -> tuple[dict[int, float], dict[int, list]]:
        """Log sums of the nodes of the window behind ``lo``, and the edges into each."""
        hi = min(self.n, lo + WINDOW)
        start, span, ids = matches(self.v, self.flat, max(0, lo - self.v.longest), hi)
        end = start + span
        some = (end > lo) & (end <= hi)
        start, end, ids = start[some], end[some], ids[some]
        order = np.argsort(end, kind="stable")
        into: dict[int, list] = {}
        for s, e, i, w in zip(start[order].tolist(), end[order].tolist(), ids[order].tolist(), self.v.weight[ids[order]].tolist(), strict=True):
            into.setdefault(e, []).append((s, w, i))
        sums = dict(self.held[lo])
        for e, edges in into.items():
            ways = [sums[s] + w for s, w, _ in edges if s in sums]
            if ways:
                top = max(ways)
                sums[e] = top + math.log(sum(math.exp(x - top) for x in ways))
        return sums, into

    def sample(self, seed: np.uint64, stop: int, out: np.ndarray) -> None:
        """Draw a path from the end; ``stop`` is the unit's end in ``out``."""
        node, begin = self.n, stop - self.n
        for lo in range((self.n - 1) // WINDOW * WINDOW, -1, -WINDOW):
            sums, into = self._sums(lo)
            inside = np.arange(begin + lo, begin + min(self.n, lo + WINDOW) + 1)
            draws = uniform(np.full(len(inside), seed, dtype=np.uint64), inside)
            while node > lo:
                u, edges = draws[node - lo], [x for x in into[node] if x[0] in sums]
                for s, w, i in edges:
                    u -= math.exp(sums[s] + w - sums[node])
                    if u < 0:
                        break
                out[begin + s] = i + 1
                node = s


class Encoder:
    """Encodes batches; keeps the lattice of the first batch's units for the later ones.

    What is kept never changes a result: a unit's draws depend on the unit alone.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.kept, self.index = v, None, {}

    def __call__(self, texts: list[bytes], seeds: np.ndarray) -> list[np.ndarray]:
        """Sampled piece ids of each text; long texts go in chunks that end between units."""
        if max(map(len, texts), default=0) <= CHUNK:
            return self._batch(texts, seeds)
        out = []
        for text, seed in zip(texts, seeds, strict=True):
            at, got = 0, []
            while at < len(text) or not got:
                stop = min(len(text), at + CHUNK)
                # A unit ends before a space that follows a sign, or behind a line end.
                if stop < len(text):
                    m = BETWEEN.search(text, stop)
                    stop = m.end() if m else len(text)
                with np.errstate(over="ignore"):
                    got += self._batch([text[at:stop]], np.array([np.uint64(seed) + np.uint64(at) * MULT], dtype=np.uint64))
                at = stop
            out.append(np.concatenate(got))
        return out

    def _parts(self, text: bytes) -> list[bytes]:
        units = UNIT.findall(text)
        if max(map(len, units), default=0) <= LONG:
            return units
        return [p for x in units for p in (cut_up(x, self.v) if len(x) > LONG else (x,))]

    def _batch(self, texts: list[bytes], seeds: np.ndarray) -> list[np.ndarray]:
        found = [self._parts(text) for text in texts]
        per_doc = [len(units) for units in found]
        units = [x for some in found for x in some]
        known = dict.fromkeys(x for x in units if len(x) <= GIANT)
        fresh = [x for x in known if x not in self.index]
        if self.kept is None and fresh:
            self.kept, self.index = Lattice(fresh, self.v), dict(zip(fresh, range(len(fresh)), strict=True))
            fresh = []
        n_kept = len(self.index)
        number = dict(zip(fresh, range(n_kept, n_kept + len(fresh)), strict=True))
        number.update((x, self.index[x]) for x in known if x in self.index)
        unit = np.fromiter((number.get(x, -1) for x in units), dtype=np.int64, count=len(units))
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        stop = np.cumsum(size)  # units tile the texts, so these are ends in the joined batch
        # Draws count from each text's start, wherever the text is in the batch.
        seed = np.repeat(seeds.astype(np.uint64) - bounds[:-1].astype(np.uint64) * MULT, per_doc)
        out = np.zeros(bounds[-1], dtype=np.int32)
        for i in np.flatnonzero(unit < 0).tolist():
            Giant(units[i], self.v).sample(seed[i], int(stop[i]), out)
        old = np.flatnonzero((unit >= 0) & (unit < n_kept))
        if len(old):
            self._walk(self.kept, unit[old], seed[old], stop[old], size[old], out)
        if fresh:
            new = np.flatnonzero(unit >= n_kept)
            self._walk(Lattice(fresh, self.v), unit[new] - n_kept, seed[new], stop[new], size[new], out)
        return [(row := out[a:b])[row > 0] - 1 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    @staticmethod
    def _walk(lattice: Lattice, unit, seed, stop, left, out) -> None:
        node = lattice.first[left] + lattice.rank[unit]
        near = np.argsort(node)  # neighbours in the lattice are drawn together
        node, seed, stop, left = node[near], seed[near], stop[near], left[near]
        while len(node):
            e = lattice.draw(node, uniform(seed, stop))
            span = lattice.span[e]
            stop = stop - span
            left = left - span
            out[stop] = lattice.ids[e] + 1
            on = np.flatnonzero(left)
            node, seed, stop, left = lattice.start[e[on]], seed[on], stop[on], left[on]


def encode_batch(texts: list[bytes], seeds: np.ndarray, v: Vocabulary) -> list[np.ndarray]:
    return Encoder(v)(texts, seeds)


def decode_ids(ids, v: Vocabulary) -> bytes:
    return b"".join(map(v.bytes_of.__getitem__, ids))


def lossless(text: bytes | None, ids: np.ndarray, v: Vocabulary, step: int = 1 << 16) -> bool:
    """Whether the ids decode to exactly the text; some of them at a time."""
    at = 0
    for k in range(0, len(ids), step):
        some = decode_ids(ids[k : k + step].tolist(), v)
        if text is None or text[at : at + len(some)] != some:
            return False
        at += len(some)
    return text is None or at == len(text)


def id_lists(texts: list, ids: list[np.ndarray]) -> pa.Array:
    """Lists of piece ids; null for a null text."""
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    none = np.array([t is None for t in texts] + [False])
    return pa.ListArray.from_arrays(pa.array(ends, mask=none) if none.any() else pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)))


def encode(docs: DataFrame, *, model: str = MODEL, theta: float = 1.0, seed: int = 0, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (columns ``keep``) with ``piece_ids``, a sampled segmentation of each text."""
    return _run(docs, [("piece_ids", "array<int>")], lambda v, texts, ids: [id_lists(texts, ids)], model, theta, seed, keep, id_col, text_col)


def round_trip(docs: DataFrame, *, model: str = MODEL, theta: float = 1.0, seed: int = 0, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode`, with ``lossless``: whether decoding the ids gives the exact text."""

    def made(v, texts, ids):
        return [id_lists(texts, ids), [lossless(t, i, v) for t, i in zip(texts, ids, strict=True)]]

    return _run(docs, [("piece_ids", "array<int>"), ("lossless", "boolean")], made, model, theta, seed, keep, id_col, text_col)


def digest(docs: DataFrame, *, model: str = MODEL, theta: float = 1.0, seed: int = 0, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode`, but with the ids' number and checksum and whether decoding is exact."""
    import zlib

    def made(v, texts, ids):
        crc = [zlib.crc32(np.ascontiguousarray(i, dtype="<i4").tobytes()) for i in ids]
        same = [lossless(t, i, v) for t, i in zip(texts, ids, strict=True)]
        return [[len(i) for i in ids], crc, same]

    return _run(docs, [("n_pieces", "long"), ("ids_crc32", "long"), ("lossless", "boolean")], made, model, theta, seed, keep, id_col, text_col)


def _run(docs, fields, made, model, theta, seed, keep, id_col, text_col) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(load(model, theta))
    seed_col = "seed" + "_" * (1 + max(map(len, docs.columns)))  # no column of the documents has this name
    keyed = docs.select(*[col(c) for c in docs.columns], F.xxhash64(col(id_col), F.lit(seed)).alias(seed_col))

    def make():
        v = held.value
        run = Encoder(v)  # one a task, so that nothing stays behind in a reused worker

        def f(texts, seeds):
            rows = [None if s is None else s.encode("utf-8", "surrogatepass") for s in texts.to_pylist()]
            ids = run([r or b"" for r in rows], seeds.to_numpy().view(np.uint64))
            return made(v, rows, ids)

        return f

    kept = list(docs.columns) if keep is None else keep
    return map_text(keyed, make, fields, text=text_col, keep=kept, args=[seed_col], batch_bytes=BATCH)


def decode(tokens: DataFrame, *, model: str = MODEL, keep: list[str] | None = None, ids_col: str = "piece_ids") -> DataFrame:
    """``tokens`` (columns ``keep``) with ``decoded``, the exact text of the piece ids."""
    from pyspark.sql import types as T

    held = tokens.sparkSession.sparkContext.broadcast(load(model))
    kept = [c for c in (tokens.columns if keep is None else keep) if c not in {"decoded", ids_col}]
    flat = tokens.select(*[col(c).alias(f"k{i}") for i, c in enumerate(kept)], col(ids_col).alias("t"))
    schema = T.StructType([*[T.StructField(f"k{i}", tokens.schema[c].dataType) for i, c in enumerate(kept)], T.StructField("decoded", T.StringType())])

    def run(batches):
        v = held.value
        for b in batches:
            texts = [None if r is None else decode_ids(r, v).decode("utf-8", "surrogatepass") for r in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(f"k{i}") for i in range(len(kept))], pa.array(texts, pa.string())], names=schema.names)

    return flat.mapInArrow(run, schema).toDF(*kept, "decoded")
