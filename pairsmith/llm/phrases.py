"""Collocations by hierarchical pair naming.

Texts are cut into chunks of a bounded number of words, a language each, whose words are numbered within the chunk. Level 1 names words:
a chunk sends each of its words once, by the block of its hash; all of a word meet in its block to be counted, and a frequent one gets a global name, that of the
first chunk which has it. The chunk learns the names of its frequent words and forgets the others. Level k does the same to pairs of adjacent names of
level k - 1: a phrase of k words is the pair of its first and of its last k - 1 words. So a phrase is sent as often as there
are chunks that hold it, not once for each occurrence, and the two names of a pair are pointers to its parents: along them frequencies
of cuts are looked up, and shorter phrases learn of the longer ones that contain them.

What a chunk sends to a block travels as one row of packed numbers. A block has a bounded number of words or pairs, however many texts there are, as a word
comes once from each chunk. Most pairs of words are rare. Before they are named, chunks send the hashes of their pairs, some two bytes for each, and learn
which of them occur often enough in all; others cannot be frequent. It is a filter that lets a few too many through, and what is counted afterwards is exact.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas import factorize
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _free, small_batches, stage_folder, staged

MOST_WORDS, LEAST = 4, 30
TOP = 2000
#: A candidate goes if a longer one that contains it has at least this many hundredths of its occurrences.
COVERED = 80
#: Words of a task's open chunks, of all languages: they are closed at the end of the piece that reaches them. The larger chunks are, the fewer
#: rows a word has; a task holds four bytes for each of their words, and their distinct words.
CHUNK_WORDS = 1 << 21
#: Bits of a name for the number within the chunk, and of a chunk's number for that within its task.
UNIT_BITS, SEQ_BITS = 27, 15
#: Words to a block of words or pairs, and the bits of a pair's hash within its block.
BLOCK_WORDS, CELL_BITS = 1 << 20, 22
_MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _MARKS + b"\t", bytes(range(97, 123)) + b"\n" * len(_MARKS) + b" ")


class _Numbers(dict):
    """Words to their numbers from 1, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


_CODEC = pa.Codec("zstd", compression_level=9)


def _small(raw: bytes) -> bytes:
    """Compressed, the size before that first."""
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _whole(blob: bytes) -> bytes:
    return _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as bytes, the lowest bytes of all of them first: they are compressed apart from the high ones, which are mostly 0."""
    return _small(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_whole(blob), np.uint8).reshape(8, -1).T).view("<i8").ravel().astype(np.int64)


def _by_count(units: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units from 1 to ``kinds`` renumbered, the most frequent first; the old numbers in the new order, less 1; and the counts."""
    counts = np.bincount(units, minlength=kinds + 1)[1:]
    order = np.argsort(-counts, kind="stable")
    to = np.zeros(kinds + 1, np.int64)
    to[order + 1] = np.arange(1, kinds + 1)
    return to[units], order, counts[order]


def _schema(ddl: str) -> pa.Schema:
    """The Arrow schema of columns that are long, string, binary, or arrays of these."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: A chunk is two rows: its texts as numbers, and its words, which are done with earlier. Words are joined by line ends, which none has.
_CHUNKS = "chunk long, lang string, n long, units binary, hashes binary, words binary, many binary, part string"


def _chunked(chunk_words: int):
    """Rows (lang, text) to chunks: the words' numbers with a 0 at the end of each piece, and the words with their counts and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_chunks: dict[str, tuple[_Numbers, array]] = {}
        held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, (numbers, units) in open_chunks.items():
                if not numbers:
                    continue
                if made >> SEQ_BITS or len(numbers) >> UNIT_BITS:
                    raise ValueError("a task has too many chunks, or a chunk too many words")
                own, order, counts = _by_count(np.array(units, np.int64), len(numbers))
                words = np.array(list(numbers), object)[order]
                hashes = (hash_array(words, categorize=False) >> np.uint64(32)).astype(np.int64) ^ zlib.crc32(lang.encode())
                chunk, made = (task << SEQ_BITS) + made, made + 1
                yield _rows([(chunk, lang, int(counts.sum()), _packed(own), _packed(hashes), None, None, "units"), (chunk, lang, None, None, _packed(hashes), _small(b"\n".join(words)), _packed(counts), "words")], _CHUNKS)
            open_chunks.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                for piece in text.translate(_FOLD).split(b"\n"):
                    words = piece.split()
                    if words:
                        if lang not in open_chunks:
                            open_chunks[lang] = _Numbers(), array("i")
                        numbers, units = open_chunks[lang]
                        units.extend(map(numbers.__getitem__, words))
                        units.append(0)
                        held += len(words)
                        if held >= chunk_words:
                            yield from closed()
                            held = 0
        yield from closed()

    return run


def _pairs(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of adjacent units, left << 32 | right, in order, and their counts."""
    both = (units[:-1] != 0) & (units[1:] != 0)
    return np.unique(units[:-1][both] << 32 | units[1:][both], return_counts=True)


def _placed(units: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For every place but the last the number, from 1, of its pair among the keys, or 0."""
    if not len(keys) or len(units) < 2:
        return np.zeros(max(len(units) - 1, 0), np.int64)
    pairs = units[:-1] << 32 | units[1:]
    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
    return np.where(keys[at] == pairs, at + 1, 0)


def _known(units: np.ndarray, numbers: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units without those that have no name, renumbered, with names and old numbers by the new ones; of neighbouring gaps one stays."""
    to = np.zeros(max(int(units.max(initial=0)), int(numbers.max(initial=0))) + 1, np.int64)
    to[numbers] = np.arange(1, len(numbers) + 1)
    units, order, _ = _by_count(to[units], len(numbers))
    gap = units == 0
    gap[1:] &= units[:-1] == 0  # a gap after a gap
    return units[~gap], names[order], numbers[order]


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes whose high bits, which tell blocks, are as good as the low ones."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _pair_hashes(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Hashes of pairs from those of their words."""
    hashes = hashes.astype(np.uint64)
    return _mixed(hashes[(keys >> 32) - 1] << np.uint64(32) | hashes[(keys & 0xFFFFFFFF) - 1])


def _shares(h: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """The blocks of hashes and the places, in order, that each has."""
    if not len(h):
        return
    block = (h >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    blocks, starts = np.unique(block[order], return_index=True)
    yield from zip(blocks.tolist(), np.split(order, starts[1:]), strict=True)


def _cells(h: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of hashes with the places that each has, its distinct cells in order, and the cell of each place."""
    cell = ((h << np.uint64(bits)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    for block, at in _shares(h, bits):
        yield block, at, *np.unique(cell[at], return_inverse=True)


_SKETCH = "block long, chunk long, cells binary, many binary"
#: A bit for each cell that a chunk has sent.
_ENOUGH = "chunk long, block long, enough binary"


def _sketched(bits: int):
    """Rows for each chunk and block: the sorted cells of its pairs of words, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, counts = _pairs(_unpacked(batch["units"][k].as_py()))
                if not len(keys):
                    continue
                h = _pair_hashes(_unpacked(batch["hashes"][k].as_py()), keys)
                out = [(block, batch["chunk"][k].as_py(), _packed(np.diff(cells, prepend=0)), _packed(np.bincount(same, counts[at]))) for block, at, cells, same in _cells(h, bits)]
                yield _rows(out, _SKETCH)

    return run


def _often(least: int):
    """For one block's rows, which of their cells have ``least`` occurrences or more in all."""

    def run(rows: pa.Table) -> pa.Table:
        cells = [np.cumsum(_unpacked(c)) for c in rows["cells"].to_pylist()]
        distinct, at = np.unique(np.concatenate(cells), return_inverse=True)
        enough = (np.bincount(at, np.concatenate([_unpacked(m) for m in rows["many"].to_pylist()]), len(distinct)) >= least)[at]
        parts = np.split(enough, np.cumsum([len(c) for c in cells])[:-1])
        kept = [(chunk, rows["block"][0].as_py(), _small(np.packbits(e).tobytes())) for chunk, e in zip(rows["chunk"].to_pylist(), parts, strict=True) if e.any()]
        return pa.Table.from_batches([_rows(kept, _ENOUGH)])

    return run


#: What a chunk sends to a block: its units' numbers and counts, and what they are: words, or two names each.
_SENT = "block long, chunk long, lang string, units binary, many binary, words binary, l binary, r binary"
#: What comes back: for each chunk the units that are frequent and their names; and for each block, without a chunk, the names it has given.
_NAMED = "chunk long, units binary, names binary, lang array<string>, word array<string>, l array<long>, r array<long>, name array<long>, a array<long>"


def _sent_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, many = np.array(_whole(batch["words"][k].as_py()).split(b"\n"), object), _unpacked(batch["many"][k].as_py())
                same = [batch["chunk"][k].as_py(), batch["lang"][k].as_py()]
                h = _mixed(_unpacked(batch["hashes"][k].as_py()).astype(np.uint64))
                yield _rows([(block, *same, _packed(np.diff(at + 1, prepend=0)), _packed(many[at]), _small(b"\n".join(words[at])), None, None) for block, at in _shares(h, bits)], _SENT)

    return run


def _sent_pairs(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, counts = _keys_of(batch["keys"][k].as_py()), _unpacked(batch["counts"][k].as_py())
                names = np.append(0, _unpacked(batch["names"][k].as_py()))
                l, r = names[keys >> 32], names[keys & 0xFFFFFFFF]
                h = _mixed(l.astype(np.uint64) ^ _mixed(r.astype(np.uint64)))
                yield _rows([(block, batch["chunk"][k].as_py(), None, _packed(np.diff(at + 1, prepend=0)), _packed(counts[at]), None, _packed(l[at]), _packed(r[at])) for block, at in _shares(h, bits)], _SENT)

    return run


def _kinds(rows: pa.Table, words: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """The kind of each unit of a block's rows, numbered from 0, and what the kinds are: language and word, or two names."""
    if words:
        lists = [_whole(w).split(b"\n") for w in rows["words"].to_pylist()]
        langs, lang = np.unique(np.array(rows["lang"].to_pylist(), object), return_inverse=True)
        word, distinct = factorize(np.array([w for own in lists for w in own], object))
        pair = np.repeat(lang, [len(own) for own in lists]) * len(distinct) + word
        kinds, at = np.unique(pair, return_inverse=True)
        return at, [langs[kinds // len(distinct)], distinct[kinds % len(distinct)]]
    l, r = (np.concatenate([_unpacked(x) for x in rows[c].to_pylist()]) for c in ("l", "r"))
    (lefts, a), (rights, b) = np.unique(l, return_inverse=True), np.unique(r, return_inverse=True)
    kinds, at = np.unique(a * len(rights) + b, return_inverse=True)
    return at, [lefts[kinds // len(rights)], rights[kinds % len(rights)]]


def _given(least: int, words: bool):
    """Of one block's rows the units that occur ``least`` times or more in all, by chunk, with their names; and what has these names."""

    def run(rows: pa.Table) -> pa.Table:
        at, what = _kinds(rows, words)
        units = [np.cumsum(_unpacked(u)) for u in rows["units"].to_pylist()]
        many = np.concatenate([_unpacked(m) for m in rows["many"].to_pylist()])
        total = np.zeros(len(what[0]), np.int64)
        np.add.at(total, at, many)
        place = np.concatenate([(chunk << UNIT_BITS) + u for chunk, u in zip(rows["chunk"].to_pylist(), units, strict=True)])
        name = np.full(len(total), np.iinfo(np.int64).max)
        np.minimum.at(name, at, place)
        often, out, start = total >= least, [], 0
        for chunk, own in zip(rows["chunk"].to_pylist(), units, strict=True):
            kind = at[start : start + len(own)]
            start += len(own)
            if (some := often[kind]).any():
                out.append((chunk, _packed(np.diff(own[some], prepend=0)), _packed(name[kind[some]]), *[None] * 6))
        some = np.flatnonzero(often)
        if len(some):
            first, second = (w[some].tolist() for w in what)
            told = (first, [w.decode() for w in second], None, None) if words else (None, None, first, second)
            out.append((None, None, None, *told, name[some].tolist(), total[some].tolist()))
        return pa.Table.from_batches([_rows(out, _NAMED)])

    return run


class _Spent:
    """A written table that is deleted, as a whole or by the part that a column names, as soon as what was made of it is written too: of all chunks
    there is one state at a time."""

    def __init__(self, df: DataFrame, by: str | None = None) -> None:
        self.spark, self.folder, self.by = df.sparkSession, stage_folder(df.sparkSession), by
        df.write.partitionBy(*([by] if by else [])).parquet(self.folder)
        _free(self.spark)
        self.rows = self.spark.read.schema(df.schema).parquet(self.folder)

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col(self.by) == name).drop(self.by)

    def drop(self, part: str | None = None) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.by}={part}" if part else self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _named(sent: DataFrame, least: int, words: bool) -> _Spent:
    return _Spent(sent.groupBy("block").applyInArrow(_given(least, words), _NAMED))


def _dictionary(named: DataFrame) -> DataFrame:
    """(chunk, found): the numbers and names of a chunk's units, by block; a chunk has a bounded number of words."""
    return named.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("units", "names")).alias("found"))


_STATE = "chunk long, lang string, units binary, names binary, keys binary, counts binary"


def _both_halves(keys: np.ndarray) -> bytes:
    return _packed(np.concatenate([keys >> 32, keys & 0xFFFFFFFF]))


def _keys_of(blob: bytes) -> np.ndarray:
    left, right = _unpacked(blob).reshape(2, -1)
    return left << 32 | right


def _filtered(units: np.ndarray, hashes: np.ndarray, enough: dict[int, bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of words of a chunk, with their counts, whose cells occur often enough: it sent them in this order."""
    keys, counts = _pairs(units)
    some = np.zeros(len(keys), bool)
    for block, at, cells, same in _cells(_pair_hashes(hashes, keys), bits):
        if block in enough:
            some[at] = np.unpackbits(np.frombuffer(_whole(enough[block]), np.uint8), count=len(cells)).astype(bool)[same]
    return keys[some], counts[some]


def _renumbered(keys: np.ndarray, counts: np.ndarray, numbers: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs by the new numbers of their words, in order, without those of which a word has none."""
    to = np.zeros(largest + 1, np.int64)
    to[numbers] = np.arange(1, len(numbers) + 1)
    left, right = to[keys >> 32], to[keys & 0xFFFFFFFF]
    some = (left > 0) & (right > 0)
    keys = (left << 32 | right)[some]
    order = np.argsort(keys)
    return keys[order], counts[some][order]


def _learned(bits: int | None):
    """Chunks with their frequent units, the names of these, and the pairs that come next, those of words only as far as their cells occur often.

    The units are words with a number of bits, else the pairs that the chunk had before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                units, found = _unpacked(batch["units"][k].as_py()), batch["found"][k].as_py()
                numbers, names = (np.concatenate([f(_unpacked(x[c])) for x in found]) for c, f in (("units", np.cumsum), ("names", np.asarray)))
                if bits is None:
                    units, names, _ = _known(_placed(units, _keys_of(batch["keys"][k].as_py())), numbers, names)
                    keys, counts = _pairs(units)
                else:
                    keys, counts = _filtered(units, _unpacked(batch["hashes"][k].as_py()), {c["block"]: c["enough"] for c in batch["often"][k].as_py() or []}, bits)
                    before, (units, names, numbers) = units, _known(units, numbers, names)
                    keys, counts = _renumbered(keys, counts, numbers, int(before.max(initial=0)))
                yield _rows([(batch["chunk"][k].as_py(), batch["lang"][k].as_py(), _packed(units), _packed(names), _both_halves(keys), _packed(counts))], _STATE)

    return run


def _parents(level: DataFrame, below: DataFrame, more: bool) -> DataFrame:
    """A level's names with what the cuts of its phrases need from their parents.

    first and last: frequencies of the first and last word; of the parents their own (fl, fr) and, below them, that of the
    first parent's first part and of the last parent's last part (fll, frr).
    """
    side = lambda s: [F.col("name").alias(s), F.col("a").alias(f"f{s}"), F.col("first" if s == "l" else "last").alias("first" if s == "l" else "last"), (F.col(f"f{s}") if more else F.lit(None).cast("long")).alias(f"f{s}{s}")]
    left = below.select("lang", *side("l"), F.col("phrase").alias("begin"))
    right = below.select(*side("r"), F.col("word"))
    both = level.join(left, "l").join(right, "r")
    return both.select("lang", "name", "l", "r", "a", "first", "last", "fl", "fr", "fll", "frr", "word", F.concat_ws(" ", "begin", "word").alias("phrase"))


def _cuts(words: int) -> F.Column:
    """The lowest-scoring cut of a phrase, the first of them: (score, k, l, r). Exact: of decimals wider than a long."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    sides = {2: [("fl", "fr")], 3: [("first", "fr"), ("fl", "last")], 4: [("first", "fr"), ("fll", "frr"), ("fl", "last")]}[words]
    score = lambda l, r: F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide("a"), wide(l) + wide(r)).cast("long")
    each = [F.struct(score(l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate(sides, 1)]
    return each[0] if len(each) == 1 else F.least(*each)


def candidates(docs: DataFrame, least: int = LEAST, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score, longer``: every phrase of 2 to 4 words with ``least`` occurrences or more in a language.

    a: its contiguous occurrences within pieces, overlaps included; l and r: those of the two parts at the cut that scores lowest, ties to the
    shortest first part; score: floor(2000000 * a / (l + r)) there; n: words of the language in all; longer: the most
    occurrences of a phrase of one word more that contains it (null if there is none). No other longer one can have more.

    Texts are lower-cased in A-Z, cut at ``.,;:!?`` and line ends into pieces, and those at spaces and tabs into words. A null text is empty, a null
    language ``und``; repeated rows count as often as they come; other columns are ignored. Without frequent phrases there are no rows.
    """
    small_batches(docs)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    chunked = _Spent(rows.mapInArrow(_chunked(chunk_words), _CHUNKS), "part")
    chunks = chunked.part("units")
    totals = staged(chunks.groupBy("lang").agg(F.sum("n").alias("n")))
    # So many blocks that each has words or pairs for one task: there are as many as words at most.
    bits = max(0, (totals.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS).bit_length()
    named = _named(chunked.part("words").select("chunk", "lang", "hashes", "words", "many").mapInArrow(_sent_words(bits), _SENT), least, True)
    words = named.rows.where("chunk is null").select(F.inline(F.arrays_zip("lang", "name", "a", "word"))).toDF("lang", "name", "a", "word")
    none = F.lit(None).cast("long")
    below = staged(words.select("lang", "name", "a", F.col("a").alias("first"), F.col("a").alias("last"), none.alias("fl"), none.alias("fr"), "word", F.col("word").alias("phrase")))
    chunked.drop("words")
    often = _Spent(chunks.select("chunk", "units", "hashes").mapInArrow(_sketched(bits), _SKETCH).groupBy("block").applyInArrow(_often(least), _ENOUGH))
    cells = often.rows.groupBy("chunk").agg(F.collect_list(F.struct("block", "enough")).alias("often"))
    known = chunks.select("chunk", "lang", "units", "hashes").join(_dictionary(named.rows), "chunk").join(cells, "chunk", "left")
    state, levels = _Spent(known.mapInArrow(_learned(bits), _STATE)), []
    for spent in (chunked, named, often):
        spent.drop()
    for size in range(2, MOST_WORDS + 1):
        named = _named(state.rows.select("chunk", "names", "keys", "counts").mapInArrow(_sent_pairs(bits), _SENT), least, False)
        # Names tell languages apart: a name is of one chunk, which is of one language.
        pairs = named.rows.where("chunk is null").select(F.inline(F.arrays_zip("name", "l", "r", "a"))).toDF("name", "l", "r", "a")
        below = staged(_parents(pairs, below, size > 2))
        levels.append((size, below))
        before = state
        if size < MOST_WORDS:
            state = _Spent(before.rows.select("chunk", "lang", "units", "keys").join(_dictionary(named.rows), "chunk").mapInArrow(_learned(None), _STATE))
        for spent in (before, named):
            spent.drop()
    out = None
    for k, (size, level) in enumerate(levels):
        part = level.select("lang", "name", "phrase", F.lit(size).alias("words"), "a", _cuts(size).alias("cut"))
        if k + 1 < len(levels):
            above = levels[k + 1][1]
            # A longer phrase's occurrences reach a shorter one through those in between, which have no fewer.
            longer = above.select(F.col("l").alias("name"), "a").union(above.select("r", "a")).groupBy("name").agg(F.max("a").alias("longer"))
            part = part.join(longer, "name", "left")
        else:
            part = part.withColumn("longer", F.lit(None).cast("long"))
        part = part.drop("name")
        out = part if out is None else out.unionByName(part)
    return out.join(totals, "lang").select("lang", "phrase", "words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), "longer")


def top_phrases(docs: DataFrame, top: int = TOP, least: int = LEAST, covered: int = COVERED, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` candidates by score and a, falling, and phrase in byte order.

    A candidate that a longer one covers, with ``covered`` hundredths of its occurrences or more, is left out. See ``candidates``.
    """
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = candidates(docs, least, chunk_words).where(~F.coalesce(wide("longer") * 100 >= wide("a") * covered, F.lit(False)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # In parts first, so that the task that ranks a language gets a bounded number of rows.
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
