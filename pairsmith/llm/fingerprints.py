"""Document fingerprints: Merkle trees over sections, paragraphs and pieces, by DataFrame operations only.

A text is cut into pieces of up to four words, which end with a mark or a line at the latest; pieces up to the end of a line are a paragraph;
paragraphs up to an empty line, or up to one whose digest says so (one in eight), are a section, so that a change moves no
boundary but its own. A leaf's digest is that of its characters, white space included, a branch's that of its children's digests,
and leaves and branches of each level are told apart. So equal roots mean equal texts, and where roots differ the branches that differ lead to the
edits. A fingerprint is the root followed by 24 bits of every leaf, a share of the text's length that does not change with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to three words without a mark at their end, then one with or without; line ends only after it. It reads the same in Java and in RE2.
PIECE = r"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.,;:!?][\x20\x09\x0B-\x0D]+){0,3}(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+)"
#: An empty line.
BLANK = r"\x0A[\x20\x09\x0B-\x0D]*\x0A"
#: A paragraph whose digest ends so ends a section.
SECTION_END = ("0", "8")
#: Hexadecimal digits of a leaf's digest in a fingerprint, and the letters they become.
DIGITS, LETTERS = 6, 4
#: Documents of a block of neighbours, and blocks at most.
BLOCK_ROWS, BLOCKS = 256, 20_000


def _digest(level: int, content: F.Column) -> F.Column:
    return F.sha2(F.concat(F.lit(str(level)), content), 256)


def _joined(children: F.Column) -> F.Column:
    return F.array_join(F.transform(children, lambda c: c["digest"]), "")


def _runs(items: str, ends) -> F.Column:
    """The array ``items`` as an array of arrays, each up to an item for which ``ends`` holds; the last one ends with the items."""
    at = F.array_compact(F.transform(items, lambda x, i: F.when(ends(x) | (i + 1 == F.size(items)), i + 1)))
    return F.transform(at, lambda e, j: F.struct(e.alias("end"), F.coalesce(F.get(at, j - 1), F.lit(0)).alias("before")))


def with_tree(rows: DataFrame, text: str, tree: str) -> DataFrame:
    """``rows`` with the Merkle tree of a text: root, leaves (digest, chars) and sections of paragraphs of pieces, each with digest and chars.

    A null text has the tree of an empty one, whose root has no branches.
    """
    p, lines, paragraphs, sections = (f"{tree}_{k}" for k in ("pieces", "lines", "paragraphs", "sections"))
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["chars"])
    cut = lambda items: lambda r: F.slice(items, r["before"] + 1, r["end"] - r["before"])
    rows = rows.withColumn(p, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0)))
    rows = rows.withColumn(p, F.transform(p, lambda x: F.struct(_digest(0, x).alias("digest"), F.char_length(x).alias("chars"), F.contains(x, F.lit("\n")).alias("line"), F.regexp_like(x, F.lit(BLANK)).alias("blank"))))
    rows = rows.withColumn(lines, _runs(p, lambda x: x["line"]))
    paragraph = lambda xs: F.struct(_digest(1, _joined(xs)).alias("digest"), chars(xs).alias("chars"), F.element_at(xs, -1)["blank"].alias("blank"), F.transform(xs, lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("pieces"))
    rows = rows.withColumn(paragraphs, F.transform(F.transform(lines, cut(F.col(p))), paragraph))
    rows = rows.withColumn(lines, _runs(paragraphs, lambda x: x["blank"] | F.right(x["digest"], F.lit(1)).isin(*SECTION_END)))
    section = lambda xs: F.struct(_digest(2, _joined(xs)).alias("digest"), chars(xs).alias("chars"), F.transform(xs, lambda x: x.dropFields("blank")).alias("paragraphs"))
    rows = rows.withColumn(sections, F.transform(F.transform(lines, cut(F.col(paragraphs))), section))
    leaves = F.transform(p, lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars")))
    made = F.struct(_digest(3, _joined(F.col(sections))).alias("root"), leaves.alias("leaves"), F.col(sections).alias("sections"))
    return rows.withColumn(tree, made).drop(p, lines, paragraphs, sections)


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with a text's fingerprint: the root, a colon, and the leaves' codes, in base64 without line ends."""
    tree = f"{name}_tree"
    digits = F.array_join(F.transform(F.col(tree)["leaves"], lambda x: F.left(x["digest"], F.lit(DIGITS))), "")
    return with_tree(rows, text, tree).withColumn(name, F.concat(F.col(tree)["root"], F.lit(":"), F.translate(F.base64(F.unhex(digits)), "\r\n", ""))).drop(tree)


def codes(fingerprint: str) -> F.Column:
    """The distinct codes of a fingerprint's leaves."""
    return F.array_distinct(F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit(f".{{{LETTERS}}}"), F.lit(0)))


def likeness(one: str, other: str, one_codes: F.Column, other_codes: F.Column) -> F.Column:
    """From two fingerprints and their codes: the share of their leaves that both have, from 0 to 1; 1 for equal roots."""
    both = F.size(F.array_intersect(one_codes, other_codes))
    # Two texts without leaves are both empty, and their roots are equal.
    return F.when(F.col(one) == F.col(other), 1.0).otherwise(2.0 * both / F.greatest(F.size(one_codes) + F.size(other_codes), F.lit(1)))


def _numbers(values: list, kind: str) -> F.Column:
    """An array of constants, however many."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)")


def _block(bounds: list[int]) -> F.Column:
    """Number of the bounds below doc_id, by bisection; 0 for null."""
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda a, s: a + F.when(F.get(_numbers(bounds, "bigint"), a + s - 1) < F.col("doc_id"), s).otherwise(0))


def with_next(rows: DataFrame, columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` of doc_id, text and others with ``next_c`` for each of the columns c: that of the next row in descending doc_id, after the last one that of the first.

    Null ids come last, ties in the order of the texts. Rows are dealt to blocks of neighbouring ids, and the first row of each
    block is sent to the one before too, so that no task sees more than its blocks; rows of one id and text are in one block.
    """
    many, largest = rows.agg(F.count("*").alias("n"), F.max("doc_id")).first()
    blocks = max(1, min(BLOCKS, -(-many // block_rows)))
    quantiles = F.percentile_approx("doc_id", _numbers([k / blocks for k in range(1, blocks + 1)], "double"), 10 * blocks)
    # One number for each block. Each is an id that occurs: the largest one of its block.
    bounds = [] if largest is None else sorted({*rows.agg(quantiles).first()[0], largest})
    if bounds:
        rows = rows.withColumn("_block", _block(bounds))
        own = F.struct(F.col("_block").alias("block"), F.lit(False).alias("guest"))
        # The largest id of a block follows the least one of the block above; that of all follows the last row.
        above = F.struct(F.pmod(F.col("_block") + 1, F.lit(len(bounds))).alias("block"), F.lit(True).alias("guest"))
        head = F.get(_numbers(bounds, "bigint"), F.col("_block")) == F.col("doc_id")
        dealt = rows.withColumn("_to", F.explode(F.when(head, F.array(own, above)).otherwise(F.array(own)))).drop("_block")
    else:
        dealt = rows.withColumn("_to", F.struct(F.lit(0).alias("block"), F.lit(False).alias("guest")))
    order = Window.partitionBy("_to.block").orderBy(F.col("_to.guest"), F.desc_nulls_last("doc_id"), F.asc("text"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = {f"next_{c}": F.lead(c).over(order) if bounds else F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in columns}
    return dealt.withColumns(following).where(~F.col("_to.guest")).drop("_to")


def fingerprint_edits(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of ``docs``.

    The edited text has the last floor(n_chars / 3) code points of a text replaced by the first as many (or all) of the next
    document's, in descending doc_id; after the last comes the first. near_edited and near_next: likeness of the fingerprint to that of the edited text and of the next document.

    A null text is empty. Null ids come last, and rows of one id in the order of their texts; each repeated row gets a row. One row is its own next. An
    empty table gives no rows; other columns are ignored. A text of one leaf is like another one wholly or not at all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "fingerprint"), ["text", "fingerprint"], block_rows)
    rows = rows.withColumn("n_chars", F.char_length("text"))
    taken = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars") - taken), F.left("next_text", taken))).drop("text", "next_text")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint").drop("edited")
    rows = rows.withColumns({f"_{c}": codes(c) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")})
    near = {f"near_{n}": likeness("fingerprint", f"{f}_fingerprint", F.col("_fingerprint"), F.col(f"_{f}_fingerprint")) for n, f in (("edited", "edited"), ("next", "next"))}
    return rows.withColumns(near).select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def locate_edits(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """``key, side, start, chars``: the spans of the texts in which those of a pair differ, found by descending where branches differ.

    side: ``old`` or ``new``, whose text the span is in; start: code points before it. Neighbouring differing pieces are one span. What the other
    text has too, wherever it stands, is no edit. ``key`` tells the pairs apart, and is not null; null texts are empty. Pairs of equal texts have no rows.
    """
    sides = pairs.select(F.col(key).alias("_k"), F.lit("old").alias("side"), F.col(old).cast("string").alias("t")).union(pairs.select(key, F.lit("new"), F.col(new).cast("string")))
    level = with_tree(sides, "t", "tree").select("_k", "side", F.lit(0).alias("start"), F.col("tree.sections").alias("children"))
    for deeper in ("paragraphs", "pieces", None):
        each = level.select("_k", "side", F.col("start").alias("_from"), F.posexplode("children").alias("_at", "c"))
        before = Window.partitionBy("_k", "side", "_from").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        each = each.select("_k", "side", (F.col("_from") + F.coalesce(F.sum("c.chars").over(before), F.lit(0))).alias("start"), "c")
        # Branches that both texts have are left here.
        held = F.size(F.collect_set("side").over(Window.partitionBy("_k", "c.digest")))
        kept = each.withColumn("_held", held).where("_held = 1")
        level = kept.select("_k", "side", "start", F.col(f"c.{deeper}").alias("children")) if deeper else kept.select("_k", "side", "start", F.col("c.chars").alias("chars"))
    order = Window.partitionBy("_k", "side").orderBy("start")
    fresh = F.coalesce(F.lag(F.col("start") + F.col("chars")).over(order) != F.col("start"), F.lit(True))
    spans = level.withColumn("_new", fresh.cast("int")).withColumn("_span", F.sum("_new").over(order))
    return spans.groupBy(F.col("_k").alias(key), "side", "_span").agg(F.min("start").cast("long").alias("start"), F.sum("chars").alias("chars")).drop("_span")
