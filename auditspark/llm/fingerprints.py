"""Operator 2: threshold-scaled sketches with built-in functions only.

A document's distinct shingles of five words are hashed to 63 bits and every hash below a fixed
fraction (1 / SCALE) of the range is retained, whatever the document's length.  So the sketch grows
with the document, sketches of very unequal documents can be compared, and the sketch of a union is
the union of the sketches.  An estimate from a document of n shingles has a standard error of about
sqrt(j (1 - j) SCALE / n).  Beside the hashes a sketch has `whole`, a hash of all words in order: equal
texts have likeness 1 even where none of their few shingles is retained.

Nulls and texts without words have the empty sketch (whole: null), which is like another empty one
(1.0) and unlike any other (0.0).  Texts with fewer than five words have one shingle, the whole
sequence.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read

SHINGLE = 5
#: One hash in so many is retained.
SCALE = 4
MOST = 2**63 - 1
NO_ID = -(2**63)
#: Documents of which one block of the order by id consists, about; their ids and lengths alone are sorted.
BLOCK_ROWS = 1_000_000
#: Blocks up to which the table of their successors is broadcast (24 bytes each); beyond it Spark joins by shuffle.
MOST_BROADCAST = 200_000


def bound_once(value: Column, f) -> Column:
    """f(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """struct<hashes: array<bigint> sorted, whole: bigint>."""

    def of_words(w: Column) -> Column:
        n = F.size(w)
        hashed = F.transform(
            F.slice(w, 1, F.greatest(n - (shingle - 1), F.lit(1))),
            lambda first, i: F.xxhash64(first, *[F.get(w, i + k) for k in range(1, shingle)]).bitwiseAND(F.lit(MOST)),
        )
        low = F.when(n > 0, F.filter(hashed, lambda x: x < MOST // scale)).otherwise(F.array().cast("array<bigint>"))
        return F.struct(F.sort_array(F.array_distinct(low)).alias("hashes"), F.when(n > 0, F.xxhash64(w)).alias("whole"))

    return bound_once(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), of_words)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketches; without retained hashes, 0."""
    both = bound_once(F.size(F.array_intersect(a["hashes"], b["hashes"])).cast("double"), lambda n: n / F.greatest(F.size(a["hashes"]) + F.size(b["hashes"]) - n, F.lit(1.0)))
    return F.when(a["whole"].eqNullSafe(b["whole"]), F.lit(1.0)).otherwise(both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too (an empty text is contained in anything)."""
    share = F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.greatest(F.size(a["hashes"]), F.lit(1))
    return F.when(a["whole"].isNull() | a["whole"].eqNullSafe(b["whole"]), F.lit(1.0)).otherwise(share)


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two documents' shingles; that of equal texts is their own."""
    other = F.coalesce(a["whole"], F.lit(0)).bitwiseXOR(F.coalesce(b["whole"], F.lit(0)))
    return F.struct(F.sort_array(F.array_union(a["hashes"], b["hashes"])).alias("hashes"), F.when(a["whole"].eqNullSafe(b["whole"]), a["whole"]).otherwise(other).alias("whole"))


def as_text(s: Column) -> Column:
    """whole and hashes as hexadecimal digits."""
    return F.concat_ws(":", F.coalesce(F.lower(F.hex(s["whole"])), F.lit("-")), F.array_join(F.transform(s["hashes"], lambda x: F.lower(F.hex(x))), "."))


def keyed(docs: DataFrame) -> DataFrame:
    """id (nulls first), th (60 bits of the text's MD5, which order and tell apart the rows of one id), text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    th = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), th.alias("th"), text.alias("text"))


def block_of(ids: DataFrame, block_rows: int, quantiles: int = 256) -> tuple[Column, int]:
    """An order-preserving block number for (id, th), and the number of blocks.

    At most `quantiles` approximate quantiles of the ids reach the driver.  Each interval between them
    is cut evenly: by id or, where one id (null, say) fills the interval, by th, which is uniform."""
    stats = ids.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("id", [i / quantiles for i in range(quantiles + 1)], 10 * quantiles).alias("q")).first()
    n, q = stats["n"], [int(x) for x in stats["q"] or []]
    keep = max(1, min(quantiles, n // block_rows))
    cuts = {q[i * quantiles // keep] for i in range(keep)} if q else {0}
    cuts |= {x + d for x, y in zip(q, q[1:], strict=False) if x == y and n > block_rows for d in (0, 1)}  # an id of its own interval
    cuts = sorted(c for c in cuts if c <= MOST)
    # an interval's blocks, by its share of the quantiles
    parts = [max(1, -(-n * sum(c <= x < e for x in q) // (max(1, len(q)) * block_rows))) for c, e in zip(cuts, [*cuts[1:], MOST + 1], strict=True)]
    first = list(itertools.accumulate(parts, initial=0))

    def tree(lo: int, hi: int) -> Column:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            return F.when(F.col("id") < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid, hi))
        a, b = cuts[lo], cuts[lo + 1] if lo + 1 < len(cuts) else (q[-1] + 1 if q else 1)
        if b - a <= 1:
            inside = F.floor(F.col("th").cast("double") * F.lit(parts[lo] / 2.0**60))
        else:
            inside = F.floor((F.col("id").cast("double") - F.lit(float(a))) * F.lit(parts[lo] / float(b - a)))
        return (F.lit(first[lo]) + F.greatest(F.lit(0), F.least(inside, F.lit(parts[lo] - 1)))).cast("bigint")

    return tree(0, len(cuts)), first[-1]


def followed(ids: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ids (distinct id, th and more) with next_id and next_th: the next by id, then th; after the last
    comes the first.  Rows are sorted in blocks; only one row a block is sorted in one task."""
    block, blocks = block_of(ids, block_rows)
    ids = ids.withColumn("block", block)
    heads = ids.groupBy("block").agg(F.min(F.struct("id", "th")).alias("head"))
    order = Window.orderBy("block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("block", F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("head"))
    heads = F.broadcast(heads) if blocks <= MOST_BROADCAST else heads
    after = F.lead(F.struct("id", "th")).over(Window.partitionBy("block").orderBy("id", "th"))
    found = ids.withColumn("after", after).join(heads, "block").withColumn("after", F.coalesce("after", "head"))
    return found.withColumn("next_id", F.col("after.id")).withColumn("next_th", F.col("after.th")).drop("block", "after", "head")


def edited_fingerprints(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text (see op2), and the next one's.

    The next document is found among ids and text hashes alone; then only its first quarter and its
    sketch travel.  Rows that agree in id and text are one document and get equal rows; other rows
    with equal or null doc_id are ordered by the MD5 of their text.
    """
    rows = keyed(docs)
    ids = cut_lineage(rows.groupBy("id", "th").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("copies")))
    again = ids.where("copies > 1").limit(1).count() > 0
    once = rows.dropDuplicates(["id", "th"]) if again else rows
    wants = followed(ids, block_rows).select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("to_id"), F.col("th").alias("to_th"), F.floor(F.col("n") / 4).cast("int").alias("quarter"))
    given = once.join(wants, ["id", "th"]).select(F.col("to_id").alias("id"), F.col("to_th").alias("th"), F.substring(F.col("text"), F.lit(1), F.col("quarter")).alias("put"), sketch(F.col("text")).alias("next"))
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.col("put"))
    both = rows.join(given, ["id", "th"]).select("id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), "next")
    return both.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited", sketch(F.col("text")).alias("own"), "next", sketch(F.col("edited")).alias("changed"))


def op2_scaled_sketch(spark, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(read(spark, sf_dir, "documents"))
    own, changed, following = F.col("own"), F.col("changed"), F.col("next")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"),
        resemblance(own, changed).alias("near_edited"), resemblance(own, following).alias("near_next"), containment(own, changed).alias("contained_in_edited"),
    )
