"""SentencePiece encoding and decoding with a BPE model, by suffix-array matching.

The distinct units of a batch (runs that no piece can cross) are concatenated, and the suffixes of that text are sorted
by their first ``DEPTH`` bytes. Every piece is searched for by bisection: its occurrences are a range of the suffix
array. The occurrences are edges from position to position; sorted by position, they are relaxed from left to right. An
edge reaches its end if its start is reached and the piece may follow the one that ends there, which for BPE means that
merging the two pieces' characters alone gives back just these two. One edge at most reaches an end so, and the last
position's way back is the encoding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SLICE_BYTES = 5 << 17
DEPTH = 64
_END = 0xFF  # stands in no UTF-8 text


#: The tables of the vocabulary used last: a worker process has many tasks, each of which gets a Pieces of its own.
_KEPT: dict = {}


@dataclass
class Pieces:
    """A BPE vocabulary: text and score of each id, and the ids that stand for single bytes."""

    texts: list[str]
    scores: list[float]
    byte_ids: list[int]
    special: list[int]
    _tables: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        """From a SentencePiece model file of the kind BPE with byte fallback."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        bytes_ = {model.id_to_piece(i): i for i in every if model.is_byte(i)}
        special = [i for i in every if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        return Pieces([model.id_to_piece(i) for i in every], [model.get_score(i) for i in every], [bytes_[f"<0x{b:02X}>"] for b in range(256)], special)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: join the adjacent pair with the best score, the leftmost of equal ones, until none is left."""
        known = self.tables()["score"]
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        alive, heap = list(symbols), []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := known.get(alive[i] + alive[j])) is not None:
                heappush(heap, (-s, i, j, alive[i] + alive[j]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heappop(heap)
            if alive[i] is None or alive[j] is None or right[i] != j or alive[i] + alive[j] != whole:
                continue
            alive[i], alive[j] = whole, None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for x in alive if x is not None]

    def tables(self) -> dict:
        """What encoding needs, made once in each process."""
        t = self._tables
        if t:
            return t
        if _KEPT and _KEPT["of"] == self._named():
            self._tables = _KEPT["tables"]
            return self._tables
        skip = {*self.byte_ids, *self.special}
        t["id"] = {p: i for i, p in enumerate(self.texts) if i not in skip}
        t["score"] = {p: self.scores[i] for p, i in t["id"].items()}
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in t["id"]):
            raise ValueError("a piece crosses the border of a word")
        # Ranks: characters first, then merged pieces by falling score. Runs of several spaces are handled apart.
        usable = [p for p in t["id"] if not p.startswith(SPACE * 2)]
        chars = sorted(p for p in usable if len(p) == 1)
        merged = sorted((p for p in usable if len(p) > 1 and self.merge(list(p)) == [p]), key=lambda p: -t["score"][p])
        ranked = [*chars, *merged]
        rank = {p: k for k, p in enumerate(ranked)}
        t["chars"], t["ids"] = len(chars), np.array([t["id"][p] for p in ranked], np.int32)
        first, second = np.arange(len(ranked)), np.arange(len(ranked))
        pairs = {}
        for p in merged:
            for cut in range(1, len(p)):
                if p[:cut] in rank and p[cut:] in rank:
                    pairs[rank[p[:cut]] << 16 | rank[p[cut:]]] = rank[p]
            # The last merge that makes p.
            a, b = self._halves(p, rank)
            first[rank[p]], second[rank[p]] = a, b
        t["first"], t["second"] = first, second
        keys = np.array(sorted(pairs), np.int64)
        t["slots"], t["slot_key"], t["slot_value"] = _hash_table(keys, np.array([pairs[k] for k in keys.tolist()], np.int64))
        raw = [p.replace(SPACE, " ").encode() for p in ranked]
        if max(map(len, raw)) > DEPTH or len(ranked) >= 1 << 16:
            raise ValueError(f"pieces may have up to {DEPTH} bytes, and there may be up to 65,535 of them")
        t["len"] = np.array([len(r) for r in raw] + [1, 2, 3, 4], np.int64)  # then characters that go to 1 to 4 bytes
        t["raw"] = raw
        t["words"] = [np.array([int.from_bytes(r[8 * k : 8 * k + 8].ljust(8, b"\0"), "big") for r in raw], np.uint64) for k in range(DEPTH // 8)]
        decoded = [p.replace(SPACE, " ").encode() for p in self.texts]
        for b, i in enumerate(self.byte_ids):
            decoded[i] = bytes([b])
        for i in self.special:
            decoded[i] = b""
        t["out_start"] = np.append(0, np.cumsum([len(d) for d in decoded]))
        t["out"] = np.frombuffer(b"".join(decoded), np.uint8)
        used = {c for p in usable if len(p) > 1 for c in p.encode()}
        t["alone"] = np.array([b not in used and b < 128 for b in range(256)])
        t["byte_ids"] = np.array(self.byte_ids, np.int32)
        t["spaces"] = {}
        _KEPT.update(of=self._named(), tables=t)
        return t

    def _named(self) -> tuple:
        return self.texts, self.scores, self.byte_ids, self.special

    def _halves(self, piece: str, rank: dict[str, int]) -> tuple[int, int]:
        """The two symbols that the last merge of the piece joins."""
        known, symbols = self.tables()["score"] if self._tables.get("score") else {}, list(piece)
        while len(symbols) > 2:
            best = max((known[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in known)
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return rank[symbols[0]], rank[symbols[1]]

    def spaces(self, n: int) -> np.ndarray:
        """The ids of a run of spaces that nothing follows."""
        t = self.tables()
        if n not in t["spaces"]:
            if len(t["spaces"]) >= 4096:
                t["spaces"].clear()
            t["spaces"][n] = np.array([t["id"][p] for p in self.merge([SPACE] * n)], np.int32)
        return t["spaces"][n]

    def __hash__(self) -> int:
        return id(self)

    def __eq__(self, other: object) -> bool:
        return self is other

    def __getstate__(self) -> dict:
        return {"texts": self.texts, "scores": self.scores, "byte_ids": self.byte_ids, "special": self.special, "_tables": {}}


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hash_table(keys: np.ndarray, values: np.ndarray, bits: int = 20) -> tuple[int, np.ndarray, np.ndarray]:
    """Open addressing with linear probing: (bits, key of each slot or -1, value)."""
    while len(keys) * 4 > 1 << bits:
        bits += 1
    slot_key, slot_value = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int64)
    for k, v, at in zip(keys.tolist(), values.tolist(), ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - bits)).tolist(), strict=True):
        while slot_key[at] >= 0:
            at += 1
        slot_key[at], slot_value[at] = k, v
    return bits, slot_key, slot_value


def _look_up(t: dict, keys: np.ndarray) -> np.ndarray:
    """Values of the keys, -1 where there is none."""
    at = ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - t["slots"])).astype(np.int64)
    out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    while len(open_):
        found = t["slot_key"][at]
        hit = found == keys[open_]
        out[open_[hit]] = t["slot_value"][at[hit]]
        go = ~hit & (found >= 0)
        open_, at = open_[go], at[go] + 1
    return out


def may_follow(t: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether BPE of each two pieces' joint text gives these two: undo their merges, latest first, and look for one across."""
    out, open_ = np.ones(len(a), bool), np.arange(len(a))
    a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 30)
    while len(open_):
        joined = _look_up(t, a << 16 | b)
        bad = (joined >= 0) & (joined < limit)
        out[open_[bad]] = False
        split_a = (a >= t["chars"]) & ((a > b) | (b < t["chars"]))
        split_b = (b >= t["chars"]) & ~split_a
        limit = np.where(split_a, a, b + 1)
        go = ~bad & (split_a | split_b)
        a, b = np.where(split_a, t["second"][a], a), np.where(split_b, t["first"][b], b)
        open_, a, b, limit = open_[go], a[go], b[go], limit[go]
    return out


def _suffix_ranks(text: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Suffixes sorted by their first 8, 16, 32, 64 bytes: for each depth the order and its sorted keys."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(DEPTH, np.uint8)]).astype(np.uint64)
    key = np.zeros(n + DEPTH - 8, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n + DEPTH - 8]
    key = key[:n]
    orders, keys = [], []
    depth = 8
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.append(True, sorted_key[1:] != sorted_key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        orders.append(order)
        keys.append(sorted_key)
        if depth >= DEPTH:
            return orders, keys
        later = np.zeros(n, np.int64)
        later[: n - depth] = rank[depth:] + 1 if n > depth else 0
        key = rank.astype(np.uint64) << np.uint64(32) | later.astype(np.uint64)
        depth *= 2


def _ranges(t: dict, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its range of suffixes, by bisection, in the order of the least depth that covers it: (low, high, depth index)."""
    size, n = t["len"][:-4], len(keys[0])
    word_low, word_high = [], []
    for k, w in enumerate(t["words"]):
        inside = np.clip(size - 8 * k, 0, 8)
        # Bytes that the piece does not reach may be anything: a range from all 0 to all 255.
        free = np.where(inside == 8, 0, (np.uint64(1) << (8 * (8 - np.maximum(inside, 1))).astype(np.uint64)) - np.uint64(1)).astype(np.uint64)
        free = np.where(inside == 0, np.uint64(0xFFFFFFFFFFFFFFFF), free)
        word_low.append(np.searchsorted(keys[0], w & ~free, "left"))
        word_high.append(np.searchsorted(keys[0], w | free, "right"))
    low, high = word_low, word_high
    best_low, best_high, level = low[0].copy(), high[0].copy(), np.zeros(len(size), np.int64)
    depth = 8
    for k in range(1, len(keys)):
        new_low, new_high = [], []
        for j in range(0, len(low), 2):
            # The first half must match whole, which makes it one rank; the second may be a range, up to the rank of any suffix.
            one = np.minimum(low[j], n - 1).astype(np.uint64) << np.uint64(32)
            there = low[j] < high[j]
            covers = size > depth * j + depth  # the piece goes on into the second half
            second_low, second_high = low[j + 1].astype(np.uint64) + np.uint64(1), high[j + 1].astype(np.uint64)
            a = np.searchsorted(keys[k], np.where(covers, one | second_low, one), "left")
            b = np.searchsorted(keys[k], np.where(covers, one | second_high, one | np.uint64(0xFFFFFFFF)), "right")
            # A first half that the piece does not fill is itself a range of ranks.
            part = ~covers
            last = np.maximum(high[j], 1).astype(np.uint64) - np.uint64(1)
            b = np.where(part, np.searchsorted(keys[k], last << np.uint64(32) | np.uint64(0xFFFFFFFF), "right"), b)
            new_low.append(np.where(there, a, 0))
            new_high.append(np.where(there & (~covers | (low[j + 1] < high[j + 1])), b, np.where(there, a, 0)))
        use = size > depth
        best_low[use], best_high[use], level[use] = new_low[0][use], new_high[0][use], k
        low, high, depth = new_low, new_high, depth * 2
    return best_low, np.maximum(best_high, best_low), level


def encode_units(pieces: Pieces, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of units of ``text``; each unit has one leading space at most, and no other space."""
    t, n_units = pieces.tables(), len(starts)
    sizes = ends - starts
    joined = np.full(int(sizes.sum()) + n_units, _END, np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    own = np.repeat(np.arange(n_units), sizes)
    within = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[begin[own] + within] = text[starts[own] + within]
    orders, keys = _suffix_ranks(joined)
    low, high, level = _ranges(t, keys)
    known, offset = np.zeros(len(joined), bool), np.zeros(len(joined), np.uint64)
    offset[begin[own] + within] = within
    # An edge is one number: offset in its unit, position, piece, each in as many bits as it needs.
    low_bits, place_bits, longest = (len(t["ids"]) + 4).bit_length(), len(joined).bit_length(), int(sizes.max(initial=0))
    if low_bits + place_bits + longest.bit_length() > 64:
        raise ValueError(f"a text has a run of {longest} bytes without a break, which is too long")
    above = np.uint64(low_bits + place_bits)
    edge = lambda at, piece: offset[at] << above | at.astype(np.uint64) << np.uint64(low_bits) | piece.astype(np.uint64)
    found = []
    for k in range(len(keys)):
        at = np.flatnonzero((level == k) & (high > low))
        count = high[at] - low[at]
        place = np.repeat(low[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        spots = orders[k][place]
        known[spots[np.repeat(at < t["chars"], count)]] = True
        found.append(edge(spots, np.repeat(at, count)))
    del orders, keys, spots, place
    # Characters without a piece of their own go to bytes; nothing merges with them.
    lone = np.flatnonzero(~known & (joined & 0xC0 != 0x80) & (joined != _END))
    wide = np.searchsorted([0xC0, 0xE0, 0xF0], joined[lone], "right")
    found.append(edge(lone, len(t["ids"]) + wide))
    edges = np.concatenate(found)
    del found
    edges.sort()
    steps = np.searchsorted(edges, np.arange(longest + 1, dtype=np.uint64) << above)
    n_plain, none = len(t["ids"]), -1
    last = np.full(len(joined), -2, np.int64)
    last[begin] = none
    for low_, high_ in zip(steps[:-1], steps[1:], strict=True):
        at = (edges[low_:high_] >> np.uint64(low_bits)).astype(np.int64) & ((1 << place_bits) - 1)
        p = (edges[low_:high_] & np.uint64((1 << low_bits) - 1)).astype(np.int64)
        reached = last[at] != -2
        at, p = at[reached], p[reached]
        before = last[at]
        test = (before >= 0) & (before < n_plain) & (p < n_plain)
        ok = np.ones(len(at), bool)
        ok[test] = may_follow(t, before[test], p[test])
        last[at[ok] + t["len"][p[ok]]] = p[ok]
    # The way back, for all units at once.
    unit, at, out_unit, out_step, out_piece, out_at = np.arange(n_units), begin + sizes, [], [], [], []
    step = 0
    while True:
        go = at > begin[unit]
        unit, at = unit[go], at[go]
        if not len(unit):
            break
        p = last[at]
        if (p < 0).any():
            raise AssertionError("a unit has no encoding")
        at = at - t["len"][p]
        out_unit.append(unit)
        out_step.append(np.full(len(unit), step))
        out_piece.append(p)
        out_at.append(at)
        step += 1
    if not step:
        return np.zeros(0, np.int32), np.zeros(n_units + 1, np.int64)
    unit, step_, p, at = (np.concatenate(x) for x in (out_unit, out_step, out_piece, out_at))
    order = np.lexsort((-step_, unit))
    unit, p, at = unit[order], p[order], at[order]
    width = np.where(p >= n_plain, p - n_plain + 1, 1)
    ids = np.repeat(np.where(p < n_plain, t["ids"][np.minimum(p, n_plain - 1)], 0), width).astype(np.int32)
    fallback = np.repeat(p >= n_plain, width)
    nth = np.arange(len(ids)) - np.repeat(np.cumsum(width) - width, width)
    ids[fallback] = t["byte_ids"][joined[np.repeat(at, width)[fallback] + nth[fallback]]]
    return ids, np.append(0, np.cumsum(np.bincount(unit, width, minlength=n_units).astype(np.int64)))


def encode(pieces: Pieces, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts; null is empty. A space is put before each text that is not empty, as the model asks for."""
    t = pieces.tables()
    raw = [f" {x.replace(SPACE, ' ')}".encode() if x else b"" for x in texts]
    bounds = np.append(0, np.cumsum([len(r) for r in raw]))
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space = data == 0x20
    before = np.append(False, space[:-1])
    alone = t["alone"][data] & ~space
    # A unit begins at a text, at the first space of a run, and at a byte that no longer piece holds, and after it.
    cut = (space & ~before) | alone | np.append(True, alone[:-1])
    cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    # Of a run of spaces only the last may join what follows; the others are told apart as a run.
    ahead = np.cumsum(np.append(0, ~space))
    next_other = np.append(np.flatnonzero(~space), len(data))[ahead[starts]]
    run = np.minimum(next_other, ends) - starts
    core = np.where(run > 0, starts + run - 1, starts)
    hashes = tokens.word_hashes(data, core, ends)
    order = np.argsort(hashes)
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    kind = np.empty(len(hashes), np.int64)
    kind[order] = np.cumsum(new) - 1
    one = order[new]
    ids, offsets = encode_units(pieces, data, core[one], ends[one])
    count = np.diff(offsets)
    lone_space = t["id"].get(SPACE)
    bare = (ids[np.minimum(offsets[:-1], max(len(ids) - 1, 0))] == lone_space) & (count > 0) & (data[core[one]] == 0x20)
    # Runs of several spaces: all of them if the last stays by itself, else all but the last.
    extra = np.where(run > 1, np.where(bare[kind], run, run - 1), 0)
    skip = (extra > 0) & bare[kind]
    length = count[kind] - skip
    lead = {n: pieces.spaces(n) for n in np.unique(extra[extra > 0]).tolist()}
    lead_length = np.zeros(len(starts), np.int64)
    for n, run_ids in lead.items():
        lead_length[extra == n] = len(run_ids)
    total = length + lead_length
    begin = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.int32)
    source = np.repeat(offsets[:-1][kind] + skip - (np.cumsum(length) - length), length) + np.arange(length.sum())
    target = np.repeat(begin + lead_length - (np.cumsum(length) - length), length) + np.arange(length.sum())
    out[target] = ids[source]
    for n, run_ids in lead.items():
        out[begin[extra == n][:, None] + np.arange(len(run_ids))] = run_ids
    at = np.searchsorted(starts, bounds)
    return out, np.append(begin, len(out))[at]


def decode(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The bytes of each row of ids, without the space that encoding puts in front."""
    t = pieces.tables()
    size = np.diff(t["out_start"])[ids]
    ends = np.append(0, np.cumsum(size))
    flat = t["out"][np.repeat(t["out_start"][ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    cuts = ends[offsets]
    return [flat[a + (flat[a : a + 1] == b" ") : b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _encoded(pieces: Pieces, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, _, _ in tokens.slices(batch["_text"], SLICE_BYTES):
                texts = batch["_text"][first:after].to_pylist()
                ids, offsets = encode(pieces, texts)
                back = decode(pieces, ids, offsets)
                good = [b == (x or "").encode() for b, x in zip(back, texts, strict=True)]
                for k in np.flatnonzero(~np.array(good, bool)):
                    # Units go by 64-bit hashes in a batch; by itself, a text's own units can hardly clash.
                    if SPACE not in texts[k]:
                        own = encode(pieces, [texts[k]])
                        if decode(pieces, *own)[0] != texts[k].encode():
                            raise AssertionError("a text does not come back from its pieces")
                        ids = np.concatenate([ids[: offsets[k]], own[0], ids[offsets[k + 1] :]])
                        offsets = np.concatenate([offsets[: k + 1], offsets[k + 1 :] + len(own[0]) - (offsets[k + 1] - offsets[k])])
                        good[k] = True
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                columns = [batch[c][first:after] for c in keep]
                tokens.release()
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(np.diff(offsets).astype(np.int32)), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], [*keep, "pieces", "n_pieces", "pieces_crc32", "round_trip"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, with ``pieces, n_pieces, pieces_crc32, round_trip``.

    pieces are the ids that the model's own library gives for the whole text; the CRC is that of the ids as 32-bit little-endian
    numbers; round_trip tells whether decoding gave back the text, as it does unless the text holds the model's space sign.
    A null or empty text has no pieces. Texts may have any length; a run in one without any place that no piece can cross, such as a space, may have
    up to about 8 MB, a longer one is an error. Repeated rows get equal results; an empty table gives no rows. Columns of ``docs`` that
    are not kept are ignored.
    """
    small_batches(docs)
    pieces = Pieces.load(model)
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "pieces array<int>, n_pieces int, pieces_crc32 long, round_trip boolean"])
    return docs.select(*(F.col(f.name) for f in kept), F.col("text").cast("string").alias("_text")).mapInArrow(tokens.slim(_encoded(pieces, [f.name for f in kept])), schema)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, pieces); null pieces give a null text."""
    pieces = Pieces.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["pieces"].to_pylist()
            ids = np.array([i for x in lists for i in x or []], np.int64)
            offsets = np.append(0, np.cumsum([len(x or []) for x in lists])).astype(np.int64)
            texts = [None if x is None else b.decode(errors="replace") for x, b in zip(lists, decode(pieces, ids, offsets), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
