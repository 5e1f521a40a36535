"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its five-word shingles: count x idf. Document frequencies are counted over all documents, by
``CELLS`` cells of the shingles' hashes; idf falls with the logarithm of a shingle's frequency, in eighths, from 1 for a typical rare one to
1/2 for one in all documents, so shared boilerplate weighs less, but a large group of copies does not fall apart. Each of ``BANDS`` x ``ROWS`` consistent samples picks one shingle and a quantised weight; two sets agree in a
sample with the probability of their weighted Jaccard similarity. Texts that agree in all samples of a band are
candidates, and candidates are verified by the exact weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import checkpoint, connected_components, hot_rows, join_unique, small_batches

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
#: Cells of document frequencies. A cell's other shingles add about the corpus's count of shingles over CELLS to each one's, the same
#: share of all documents at any size of the corpus.
CELLS = 1 << 20
#: idf is rounded to this, which leaves most weights at 1.
STEP = 1 / 8
#: Counts of cells travel in pieces of this many.
PIECE = 1 << 14
#: Texts in a block of those that are compared with one another.
PAGE = 512

_GRID = 1 << 12
_seeds = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _gamma2() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution on a grid."""
    x = np.linspace(0, 40, 400_001)
    return np.interp((np.arange(_GRID) + 0.5) / _GRID, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


_R = _gamma2()
_LN_C = np.log(_R)


def samples(rows: np.ndarray, hashes: np.ndarray, ln_weights: np.ndarray, n_rows: int) -> np.ndarray:
    """(rows with shingles, samples) fingerprints; ``rows`` is sorted. Rows without shingles are left out of the result."""
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    other = np.flatnonzero(ln_weights)
    low = np.uint64(0xFFFFFFFF)
    finger = hashes * np.uint64(0xC2B2AE3D27D4EB4F)
    finger ^= finger >> np.uint64(32)
    finger &= low
    for k in range(BANDS * ROWS):
        h = (hashes ^ _seeds[k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        r = _R[(h >> np.uint64(52)).astype(np.int64)]
        ln_c = _LN_C[((h >> np.uint64(40)) & np.uint64(4095)).astype(np.int64)]
        beta = ((h >> np.uint64(8)) & low).astype(np.float32) * np.float32(2.0**-32)
        # ln a = ln c - r (t - beta) - r, with t = floor(ln w / r + beta), which is 0 for a weight of 1
        ln_a = ln_c + r * (beta - 1)
        f = finger
        if len(other):
            t = np.floor(ln_weights[other] / r[other] + beta[other])
            ln_a[other] -= r[other] * t
            f = finger.copy()
            f[other] = (finger[other] + tokens.mix64(t.astype(np.int64).astype(np.uint64))) & low
            f[other[t == 0]] = finger[other[t == 0]]
        key = ((ln_a + np.float32(400)) * np.float32(2.0**22)).astype(np.uint64) << np.uint64(32) | f
        out[:, k] = np.minimum.reduceat(key, starts) & low if len(starts) else 0
    return out


def bands(prints: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, as signed numbers."""
    keys = np.zeros((len(prints), BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            keys[:, b] = tokens.mix64(keys[:, b] * np.uint64(0x100000001B3) + prints[:, b * ROWS + r] + np.uint64(b + 1))
    return keys.view(np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, rows = tokens.words(data, offsets)
    return tokens.counted(*tokens.shingles(tokens.word_hashes(data, starts, ends), rows, len(offsets) - 1, WIDTH))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 20)).astype(np.int64)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells' counts of documents of one input partition, in pieces."""
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for _, _, data, offsets in tokens.slices(batch["text"]):
            counts += np.bincount(_cells(_sets(data, offsets)[1]), minlength=CELLS)
    yield _pieces({k: counts[k * PIECE : (k + 1) * PIECE] for k in range(CELLS // PIECE)})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces that came to one task, a few at a time."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            sums[piece] = sums.get(piece, 0) + np.frombuffer(counts, np.int64)
    yield _pieces(sums)


def _pieces(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    some = [k for k, c in sorted(counts.items()) if c.any()]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counts[k].tobytes() for k in some], pa.binary())], ["piece", "counts"])


def idf_of(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """The weight of each cell's shingles from its count of documents."""
    seen = counts > 0
    idf = np.zeros(len(counts))
    idf[seen] = np.log(max(n_docs, 1) / np.minimum(counts[seen], max(n_docs, 1)))
    typical = float(np.median(idf[seen])) if seen.any() else 0.0
    share = np.clip(0.5 + 0.5 * idf / typical, 0.5, 1) if typical > 0 else np.ones(len(counts))
    return (np.round(share / STEP) * STEP).astype(np.float32)


def shingle_idf(texts: DataFrame, n_docs: int) -> np.ndarray:
    """The weight of each cell; counted in one pass, and of a bounded size whatever the corpus."""
    pieces = texts.mapInArrow(tokens.slim(_document_counts), "piece int, counts binary")
    found = pieces.repartition(CELLS // PIECE, "piece").mapInArrow(_added, "piece int, counts binary").toArrow()
    counts = np.zeros(CELLS, np.int64)
    for piece, part in zip(found["piece"].to_pylist(), found["counts"].to_pylist(), strict=True):
        counts[piece * PIECE : (piece + 1) * PIECE] += np.frombuffer(part, np.int64)
    return idf_of(counts, n_docs)


def _weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts.astype(np.float32) * idf[_cells(hashes)]


def _signatures(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, data, offsets in tokens.slices(batch["text"]):
                rows, hashes, counts = _sets(data, offsets)
                prints = samples(rows, hashes, np.log(_weights(hashes, counts, idf)), after - first)
                keys = np.zeros((after - first, BANDS), np.int64)
                some = np.zeros(after - first, bool)
                some[rows] = True
                keys[some] = bands(prints)
                sizes = np.where(some, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][first:after], batch["rid"][first:after], batch["h"][first:after], lists], ["doc_id", "rid", "h", "keys"])

    return run


def _verified(idf: np.ndarray, threshold: float):
    """Keep the pairs of texts whose weighted Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def one(node: str, text: str) -> tuple[np.ndarray, np.ndarray]:
            if node not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                data = tokens.LOWER[np.frombuffer(text.encode(), np.uint8)]
                _, hashes, counts = _sets(data, np.array([0, len(data)]))
                kept[node] = hashes, _weights(hashes, counts, idf)
            return kept[node]

        for batch in batches:
            src, dst, good = batch["src"].to_pylist(), batch["dst"].to_pylist(), []
            for k, (a, b) in enumerate(zip(src, dst, strict=True)):
                (ha, wa), (hb, wb) = one(a, batch["src_text"][k].as_py()), one(b, batch["dst_text"][k].as_py())
                if len(ha) > len(hb):
                    ha, wa, hb, wb = hb, wb, ha, wa
                at = np.minimum(np.searchsorted(hb, ha), max(len(hb) - 1, 0))
                hit = hb[at] == ha if len(hb) else np.zeros(0, bool)
                common = float(np.minimum(wa[hit], wb[at[hit]]).sum(dtype=np.float64))
                union = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - common
                good.append(common >= (threshold - 1e-9) * union and union > 0)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["src"].filter(mask), batch["dst"].filter(mask)], ["src", "dst"])

    return run


def _digest() -> F.Column:
    return F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))


def _classified(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (doc_id, rid, h, keys) of every row, h being its text's digest, and for each text with words (h, n, least, size, keep_id, keep_h).

    n is the count of its rows; least, size, keep_id and keep_h are its class's least row id, its count of rows, and the row that stands for it.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = plain.select("doc_id", F.coalesce("doc_id", F.xxhash64("text", F.lit("id"))).alias("rid"), _digest().alias("h"), "text")
    idf = shingle_idf(plain.select("text"), plain.count())
    signed = checkpoint(rows.mapInArrow(tokens.slim(_signatures(idf)), "doc_id long, rid long, h string, keys array<long>"))
    # A node is a distinct text, named by its digest; the row with the least id stands for it.
    nodes = checkpoint(signed.where("size(keys) > 0").groupBy(F.col("h").alias("node")).agg(F.min("rid").alias("rid"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    keyed = checkpoint(nodes.select("node", F.explode("keys").alias("key")))
    # Each bucket is led by the text that meets the most others in all of its own buckets: near the middle of its group.
    sizes = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    held = sizes.agg(F.sum("n")).first()[0] or 0
    met = checkpoint(join_unique(keyed, sizes.withColumn("size", F.col("n")), "key", held))
    ranked = met.join(met.groupBy("node").agg(F.sum("size").alias("meets")), "node")
    leaders = checkpoint(ranked.groupBy("key").agg(F.max(F.struct("meets", "node"))["node"].alias("leader"), F.count("*").alias("n")))
    buckets = checkpoint(join_unique(met, leaders, "key", held))
    tested = checkpoint(buckets.where("node <> leader").groupBy(F.col("leader").alias("src"), F.col("node").alias("dst")).agg(F.max("size").alias("n")))
    texts = _texts(rows, nodes, buckets)
    links = checkpoint(_verify(tested, texts, idf, threshold, held))
    components = checkpoint(connected_components(links))
    # Only the leader was compared: in buckets that still hold several components, links between those may be missing.
    inside = checkpoint(buckets.select("key", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    parts = inside.groupBy("key", "component").agg(F.count("*").alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    parts = checkpoint(parts.where("parts > 1 and n > 2").select("key", "main", "n", F.col("n").alias("size")))
    left = checkpoint(join_unique(inside, parts, "key", held).select("key", "node", "component", (F.col("component") != F.col("main")).alias("outside"), F.col("size").alias("n")))
    more = checkpoint(_compare_blocks(left, texts, idf, threshold, held))
    if not more.isEmpty():
        components = checkpoint(connected_components(links.union(more)))
    named = checkpoint(nodes.drop("keys").join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
    classes = named.groupBy("component").agg(F.min("rid").alias("least"), F.sum("n").alias("size"), stands.alias("keep"), F.count("*").alias("n"))
    classes = checkpoint(classes.select("component", "least", "size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.node").alias("keep_h"), "n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    texts_of = join_unique(named.select("component", F.col("node").alias("h"), F.col("n").alias("times")), classes, "component", total)
    return signed, checkpoint(texts_of.select("h", F.col("times").alias("n"), "least", "size", "keep_id", "keep_h"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size`` for every row of ``docs``: classes of near-duplicate texts.

    Two texts are linked if the weighted Jaccard similarity of their shingles is ``threshold`` or more; classes are the
    connected components of links and of equal texts. Letters A-Z count as a-z; white space only parts words. A text
    without words (null, empty or blank) stands alone, whatever its copies: each such row is a class of its own, of size 1. The class id
    is the least row id in it: doc_id, or a hash of the text where doc_id is null. Texts may have any length: whole ones are read, in slices
    of a bounded size but for a single longer text. Repeated rows are returned, and counted, as often as they occur. An empty table gives
    no rows; other columns are ignored.
    """
    small_batches(docs)
    rows, classes = _classified(docs, threshold)
    worded = F.size("keys") > 0
    total = classes.agg(F.sum("n")).first()[0] or 0
    found = join_unique(rows.where(worded).select("doc_id", "h"), classes, "h", total)
    alone = rows.where(~worded).select("doc_id", F.col("rid").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.select("doc_id", F.col("least").alias("class_id"), F.col("size").alias("class_size")).union(alone)


def _texts(rows: DataFrame, nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, text) of the texts that have candidates: of each, the row with the least id only, before anything is shuffled by text."""
    wanted = buckets.select("node").distinct().join(nodes.select("node", F.col("rid").alias("_rid")), "node")
    found = rows.select("rid", "h", "text").join(wanted, (F.col("rid") == F.col("_rid")) & (F.col("h") == F.col("node")))
    return checkpoint(found.groupBy("node").agg(F.first("text").alias("text")))


def _compare_blocks(left: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, held: int) -> DataFrame:
    """Links between components of a bucket, by comparing each text outside its main component with all of its texts.

    Both sides are dealt to blocks of ``PAGE`` texts, and each pair of blocks is compared in one task by a matrix product: no
    pair of texts becomes a row. What comes out is a row at most for each component in a pair of blocks.
    """
    counts = checkpoint(left.groupBy("key").agg(F.max("n").alias("_n"), F.count_if("outside").alias("_out"), F.count("*").alias("n")))
    pages = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / PAGE)).cast("int")
    rows = join_unique(left.drop("n"), counts, "key", held).join(texts, "node")
    page = lambda n: F.pmod(F.xxhash64("node"), pages(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), pages(n) - 1))
    asks = rows.where("outside").select("key", page("_out").alias("x"), every("_n").alias("y"), F.lit(True).alias("ask"), "node", "component", "text")
    held = rows.select("key", every("_out").alias("x"), page("_n").alias("y"), F.lit(False).alias("ask"), "node", "component", "text")
    return asks.union(held).groupBy("key", "x", "y").applyInPandas(_linked_components(idf, threshold), "src string, dst string").distinct()


def _linked_components(idf: np.ndarray, threshold: float):
    def run(pdf):
        import pandas as pd

        nodes, at = np.unique(pdf["node"].to_numpy(str), return_inverse=True)
        first = np.unique(at, return_index=True)[1]
        component = pdf["component"].to_numpy(str)[first]
        owner, item, weight = [], [], []
        for k, text in enumerate(pdf["text"].iloc[first]):
            data = tokens.LOWER[np.frombuffer(text.encode(), np.uint8)]
            _, hashes, counts = _sets(data, np.array([0, len(data)]))
            # The i-th occurrence of a shingle is an item of its own, so that the smaller count is what is shared.
            each = _weights(hashes, np.ones(len(hashes), np.int64), idf)
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            owner.append(np.full(len(nth), k))
            item.append(tokens.mix64(np.repeat(hashes, counts) + nth.astype(np.uint64)))
            weight.append(np.repeat(each, counts))
        owner, item, weight = np.concatenate(owner), np.concatenate(item), np.concatenate(weight).astype(np.float64)
        total = np.bincount(owner, weight, minlength=len(nodes))
        order = np.argsort(item, kind="stable")
        owner, item, weight = owner[order], item[order], weight[order]
        new = np.append(True, item[1:] != item[:-1])
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        owner, column, weight = owner[shared], column[shared], weight[shared]
        column = np.unique(column, return_inverse=True)[1] if len(column) else column
        asks, held = np.unique(at[pdf["ask"].to_numpy(bool)]), np.unique(at[~pdf["ask"].to_numpy(bool)])
        common = np.zeros((len(asks), len(held)))
        width = 1 << 13
        for low in range(0, int(column.max(initial=-1)) + 1, width):
            here = slice(*np.searchsorted(column, [low, low + width]))
            block = np.zeros((len(nodes), width), np.float32)
            block[owner[here], column[here] - low] = np.sqrt(weight[here])
            common += block[asks] @ block[held].T
        union = total[asks][:, None] + total[held][None, :] - common
        names, part = np.unique(component, return_inverse=True)
        good = (common >= (threshold - 1e-6) * union) & (part[asks][:, None] != part[held][None, :])
        # Components linked here, directly or through others, come out as links to the first of them only.
        root = np.arange(len(names))
        x, y = np.nonzero(good)
        links = np.unique(np.column_stack([part[asks][x], part[held][y]]), axis=0)
        while len(links):
            low = np.minimum(root[links[:, 0]], root[links[:, 1]])
            before = root.copy()
            np.minimum.at(root, root[links[:, 0]], low)
            np.minimum.at(root, root[links[:, 1]], low)
            np.minimum.at(root, links[:, 0], low)
            np.minimum.at(root, links[:, 1], low)
            root = root[root]
            if (root == before).all():
                break
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"src": names[moved], "dst": names[root[moved]]}, dtype=object)

    return run


def _verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, held: int) -> DataFrame:
    """The pairs (src, dst, n) that are similar enough; n is the size of a bucket that src leads, by which its pairs go to tasks of a bounded number."""
    fan = F.ceil(F.col("n") / F.lit(hot_rows(held))).cast("int")
    left = pairs.groupBy("src").agg(F.max("n").alias("n")).join(texts.select(F.col("node").alias("src"), F.col("text").alias("src_text")), "src")
    left = left.select("src", "src_text", F.explode(F.sequence(F.lit(0), fan - 1)).alias("s"))
    right = texts.select(F.col("node").alias("dst"), F.col("text").alias("dst_text"))
    both = pairs.withColumn("s", F.pmod(F.xxhash64("dst"), fan).cast("int")).join(right, "dst").join(left, ["src", "s"])
    return both.select("src", "dst", "src_text", "dst_text").mapInArrow(tokens.slim(_verified(idf, threshold)), "src string, dst string")


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class of ``near_classes``, with all its columns, whatever their names.

    That with the least doc_id stays, rows without one last; of rows equal in doc_id and text just one stays. Rows are told apart by
    doc_id and text, so that other texts with the same doc_id are not touched. Texts without words all stay. An empty table gives no rows.
    """
    small_batches(docs)
    rows, classes = _classified(docs, threshold)
    named = lambda doc_id: F.coalesce(doc_id, F.lit(0)), lambda doc_id: doc_id.isNull()
    keep = classes.where("h = keep_h").select(*(f(F.col("keep_id")).alias(c) for f, c in zip(named, ("_d", "_u"), strict=True)), F.col("h").alias("_h"))
    doc_id = F.col("doc_id").cast("long")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), *(f(doc_id).alias(c) for f, c in zip(named, ("_d", "_u"), strict=True)), _digest().alias("_h"), F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_worded"))
    kept = whole.where("_worded").join(keep, ["_d", "_u", "_h"], "left_semi")
    if not rows.where(F.size("keys") > 0).groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        kept = kept.groupBy("_d", "_u", "_h").agg(F.first("_row").alias("_row"))
    return kept.select("_row.*").union(whole.where("not _worded").select("_row.*"))
