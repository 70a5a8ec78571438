"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph (the text between line feeds) is hashed to a wide vector; a
document's fingerprint is the sum of its paragraphs' vectors, each lane modulo a
power of two.  So the order of paragraphs doesn't matter, and a paragraph is
inserted or deleted by adding or subtracting its vector.  A vector has

* ``EQUAL`` lanes modulo 2**32, filled by four seeded 64-bit hashes of the paragraph, and
* one lane modulo 2**32 that counts the paragraph's *pieces* (cut at spaces behind ``.,;:!?`` and words in d, g or y,
  and behind ideographic marks), and
* 128 lanes modulo 2**30 that hold, for each bit of two 64-bit hashes of a piece, how many pieces have it set.

The first decide equality.  Twice a bit's count less the number of pieces is a
sum of random signs, so the cosine of two documents' sums estimates what share
of pieces they have in common (standard error about 0.09); below 0 it counts as 0.
That is exact arithmetic up to 2**30 pieces (over a gigabyte of text) a document.

All is one row's arithmetic: no shuffle is needed for a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import small_batches
from .ranges import id_ranges, input_size

EQUAL, SEEDS = 8, 4
LOW32 = 0xFFFFFFFF
LANE = 0x3FFFFFFF  # a lane's values
LANES = 0x3FFFFFFF3FFFFFFF  # two lanes in a long, two free bits above each
ONES = 0x0000000100000001
NIBBLES = 0x1111111111111111  # the lowest bits of a long's 16 fields
FIELDS = 0x0000FFFF0000FFFF
FEW = 1 << 15


def _sum32(array: str, value: str) -> str:
    return f"aggregate({array}, 0L, (a, h) -> (a + ({value} & {LOW32}L)) & {LOW32}L)"


def with_vector(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the fingerprint vector (73 longs) of the string column ``text`` (null counts as empty)."""
    q = f"coalesce(`{text}`, '')"
    # each split is bound once and hashed under all seeds
    bound = lambda split, names: f"transform(array({split}), ps -> named_struct({', '.join(f"'{x}', transform(ps, p -> xxhash64({s}, p))" for x, s in names)}))[0]"
    paragraphs = bound(f"split({q}, '\\n', -1)", [(f"e{s}", s) for s in range(SEEDS)])
    pieces = bound(f"split({q}, '\\n|(?<=[.,;:!?dgy]) |(?<=[。、，；：！？])', -1)", [("b11", 11), ("b12", 12)])
    h = "__h"
    df = df.withColumn(h, F.expr(f"struct({paragraphs} AS p, {pieces} AS q)")).withColumn(h, F.expr(f"struct({h}.p.*, {h}.q.*)"))
    equal = ", ".join(f"{_sum32(f'{h}.e{s}', 'h')}, {_sum32(f'{h}.e{s}', 'shiftrightunsigned(h, 32)')}" for s in range(SEEDS))
    # seven pieces are counted in fields of four bits (the highest must not reach the sign), so what follows reads words of blocks, not each piece
    blocks = "transform(sequence(0L, (size({b}) - 1) div 7), k -> transform(array(slice({b}, CAST(7 * k AS INT) + 1, 7)), t -> array({words}))[0])"
    words = ", ".join(f"aggregate(t, 0L, (a, h) -> a + (shiftrightunsigned(h, {s}) & {NIBBLES}L))" for s in range(4))
    # fewer than FEW pieces can't fill 16 bits, so four counts fit in a long and are dealt to lanes at the end
    each = lambda most, step: ", ".join(f"aggregate(w, 0L, (a, x) -> {step.format(x=f'(shiftrightunsigned(x[{s % 4}], {s // 4 * 4})')})" for s in range(most))
    many = f"array({each(32, f'(a & {LANES}L) + {{x}} & {7 * ONES}L)')})"
    packed = f"array({each(16, f'a + {{x}} & {7 * (ONES << 16 | ONES)}L)')})"
    few = f"transform(array({packed}), q -> concat(transform(q, x -> x & {FIELDS}L), transform(q, x -> shiftright(x, 16) & {FIELDS}L)))[0]"
    lanes = ", ".join(f"transform(array({blocks.format(b=f'{h}.b{s}', words=words)}), w -> CASE WHEN size({h}.b{s}) < {FEW} THEN {few} ELSE {many} END)[0]" for s in (11, 12))
    vector = f"concat(array({equal}, CAST(size({h}.b11) AS BIGINT)), transform(concat({lanes}), x -> x & {LANES}L))"
    return df.withColumn(out, F.expr(vector)).drop(h)


def added(a: str, b: str, sign: int = 1) -> Column:
    """The vector of two documents together (sign 1), or of the first without the paragraphs of the second (-1)."""
    carry = "" if sign == 1 else f" + CASE WHEN i < {EQUAL + 1} THEN {LOW32 + 1}L ELSE {ONES << 30}L END"
    op = "+" if sign == 1 else "-"
    s = f"transform(zip_with({a}, {b}, (x, y) -> named_struct('x', x, 'y', y)), (p, i) -> (p.x{carry} {op} p.y) & CASE WHEN i < {EQUAL + 1} THEN {LOW32}L ELSE {LANES}L END)"
    return F.expr(s)


def hex_of(vector: str) -> Column:
    """A vector as text: lanes modulo 2**32 in 8 digits, the packed ones in 16."""
    return F.expr(f"array_join(transform({vector}, (x, i) -> lower(lpad(hex(x), CASE WHEN i < {EQUAL + 1} THEN 8 ELSE 16 END, '0'))), '')")


def signs(vector: str) -> Column:
    """The 128 sums of signs: twice each bit's count less the number of pieces; exact below 2**30 pieces."""
    n = f"{vector}[{EQUAL}]"
    each = ", ".join(f"2 * (shiftright(x, {32 * k}) & {LANE}L) - {n}" for k in range(2))
    return F.expr(f"flatten(transform(slice({vector}, {EQUAL + 2}, 64), x -> array({each})))")


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * y), 0.0D, (s, v) -> s + v)"


def likeness(a: str, b: str, sa: str, sb: str) -> Column:
    """1 for equal vectors, else the cosine of the sums of signs, 0 to 1."""
    norm = f"sqrt({_dot(sa, sa)} * {_dot(sb, sb)})"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1.0D ELSE coalesce(greatest(0.0D, least(1.0D, {_dot(sa, sb)} / nullif({norm}, 0.0D))), 0.0D) END")


def with_next(docs: DataFrame, values: dict[str, str], *, id_col: str = "doc_id", tie: str, chunk_bytes: int = 8 << 20, text_col: str = "text") -> DataFrame:
    """Add to each row ``values`` ({new column: column}) of the next row by descending id, the first row following the last.

    Rows are dealt into ranges of ids, ``MAX_BOUNDS`` at most; the top row of each
    range is copied to the range above as the row that follows its last.  One
    shuffle, no global sort; a range that outgrows memory is sorted on disk.
    Rows with equal ids are ordered by ``tie``.  Rows without an id have no place in
    the order: they are followed by themselves, and dealt by ``tie``.
    """
    rows, size = input_size(docs, text_col)
    ranges = id_ranges(docs.select(id_col), id_col, min(rows, -(-size // chunk_bytes)))
    n = max(1, len(ranges.bounds))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 4)
    key = F.col(id_col).cast("long")
    known = key.isNotNull()
    docs = docs.withColumn("__range", F.coalesce(ranges.coarse(key), F.pmod(F.xxhash64(tie), F.lit(n)).cast("int")))
    top = known & (key == ranges.upper(F.col("__range"))) if ranges.bounds else F.lit(False)
    here = F.struct(F.lit(False).alias("copy"), F.col("__range").alias("range"))
    above = F.struct(F.lit(True).alias("copy"), F.pmod(F.col("__range") + 1, F.lit(n)).alias("range"))
    placed = docs.withColumn("__at", F.explode(F.when(top, F.array(here, above)).otherwise(F.array(here)))).withColumn("__range", F.col("__at.range"))
    w = Window.partitionBy("__range", known).orderBy(F.col("__at.copy"), F.col(id_col).desc(), F.col(tie))
    follows = {new: F.when(known, F.lead(old).over(w)).otherwise(F.col(old)) for new, old in values.items()}
    return placed.repartition(parts, "__range").withColumns(follows).where(~F.col("__at.copy")).drop("__at", "__range")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, in which the last third is replaced from the next document.

    Returns id_col, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (0 to 1).  Next is the document
    with the next smaller id, the greatest one for the last.  The edit replaces
    the last floor(n_chars / 3) code points by the first as many of the next
    text, or all of it if it is shorter.

    Null texts count as empty.  Rows with equal ids follow each other ordered by
    text; a single document is its own next, and so is a row without an id.
    Equal texts have equal fingerprints; so have texts that differ only in the
    order of paragraphs.  Other columns take no part.  An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = with_next(with_vector(docs, "text", "v"), {"next_text": "text", "next_v": "v"}, id_col="id", tie="text")
    third = F.floor(F.length("text") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS INT))"), F.substring(F.col("next_text"), F.lit(1), third)))
    both = with_vector(both, "edited", "edited_v")
    both = both.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "v", "edited_v", "next_v", signs("v").alias("s"), signs("edited_v").alias("edited_s"), signs("next_v").alias("next_s"))
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", hex_of("v").alias("fingerprint"), hex_of("edited_v").alias("edited_fingerprint"),
        likeness("v", "edited_v", "s", "edited_s").alias("near_edited"), likeness("v", "next_v", "s", "next_s").alias("near_next"),
    )
