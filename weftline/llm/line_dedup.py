"""Line deduplication by a deletion-neighbourhood join (DataFrame functions only).

Order of lines: doc_id (null first), then line number. A line goes if an equal line comes earlier anywhere in
the corpus, or if its text lies within one edit (insertion, deletion or substitution of a character) of a
different line whose first occurrence is earlier. So of near-equal lines the earliest stays.

1. Distinct lines, each with its first occurrence, keyed by 128 bits of hash; copies combine before the shuffle.
2. Two lines within one edit share a half: for the greater length m of the two, the first (m-1)/2 characters, or the
   last m-1-(m-1)/2. A line alone under all its half keys has no partner and emits nothing more. This is exact.
3. Every line that is left emits the variants of its other half: as a line of length m all single deletions, with
   their positions, as one of length m-1 itself; all as hashed keys.
4. Equal variants meet. Deletions at one position pair with the earliest of their group; a line and the deletions
   that equal it pair with the earliest of the other kind. Pairs are stars, one row per variant at most.
5. Every pair is verified on the texts: without the characters at the positions that the variants lack, both must be equal.

A variant's hash is the exclusive or of a hash per character and place, so that all deletions of a line of n characters
follow from running values, in blocks: some n * sqrt(n) steps instead of n * n.

Edge cases: null text has no lines; blank lines always stay and are not counted; lines below ``min_chars`` go only
as exact copies. A row is known by doc_id and a hash of its text: rows of different texts with one doc_id, or with
none, are documents of their own, in the order of that hash; rows equal in both number their lines alike and keep the same ones. An
empty table gives an empty result; other columns are ignored by ``line_report`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, keys_of_rows, let, staged, text_or_empty, unused

MIN_CHARS = 10
HALVES = ("p0", "s0", "p1", "s1")


def row_hash(text: str = "text") -> Column:
    """Tells rows with one doc_id apart."""
    return F.xxhash64(text_or_empty(text))


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    rows = docs.select("doc_id", row_hash(text).alias("row"), F.posexplode(F.split(text_or_empty(text), "\n")).alias("line_no", "line"))
    return rows.where(F.regexp_replace("line", SPACE + "+", "") != "")


def half_keys(line: Column, min_chars: int) -> list[Column]:
    """Keys of the front and back half, for m = length and m = length + 1; null for short lines."""
    size, out = F.length(line), []
    for more in (0, 1):
        m = size + more
        front = F.floor((m - 1) / 2).cast("int")
        back = m - 1 - front
        for side, part in (("p", F.left(line, front)), ("s", F.right(line, back))):
            out.append(F.when(size >= min_chars, F.xxhash64(F.lit(side), m, part)).alias(f"{side}{more}"))
    return out


def line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def distinct_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """k1, k2, at (struct doc_id, row, line_no of the first occurrence) and the half keys."""
    rows = lines_of(docs).select(*line_key(F.col("line")), F.struct("doc_id", "row", "line_no").alias("at"), *half_keys(F.col("line"), min_chars))
    return rows.groupBy("k1", "k2").agg(F.min("at").alias("at"), *[F.max(h).alias(h) for h in HALVES])


def together(signs: Column) -> Column:
    return F.aggregate(signs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def running(signs: Column) -> Column:
    """For every place the exclusive or of the signs before it: over whole blocks, then over those before it in its own."""

    def of_signs(d: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(d))).cast("int"), F.lit(1))
        return let(F.transform(F.sequence(F.lit(1), F.greatest(F.size(d), F.lit(1)), step), lambda first: F.slice(d, first, step)), of_blocks)

    def of_blocks(b: Column) -> Column:
        return let(F.transform(b, together), lambda sums: F.flatten(F.transform(b, lambda own, k: let(together(F.slice(sums, 1, k)), lambda before: in_block(own, before)))))

    def in_block(own: Column, before: Column) -> Column:
        return F.transform(own, lambda _, j: before.bitwiseXOR(together(F.slice(own, 1, j))))

    return let(signs, of_signs)


def deletions(text: Column) -> Column:
    """The hash of ``text`` without its i-th character, for every i from 1."""

    def of_signs(c: Column) -> Column:
        # Each character's sign at its place, and a place further to the front, where it stands once one before it is gone.
        stays, moves = F.transform(c, lambda x, i: F.xxhash64(x, i)), F.transform(c, lambda x, i: F.xxhash64(x, i - 1))

        def of_moved(m: Column) -> Column:
            before = running(F.zip_with(stays, m, lambda a, b: a.bitwiseXOR(b)))
            return let(together(m), lambda all_moved: F.zip_with(before, F.transform(m, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p, e: F.struct(p.bitwiseXOR(all_moved).bitwiseXOR(e["x"]).alias("v"), (e["i"] + 1).alias("i"))))

        return let(moves, of_moved)

    return let(F.split(text, ""), of_signs)


def variants(front: DataFrame) -> DataFrame:
    """One row per variant: half key, hashed variant, position in the half (0: the line itself), position in the line."""
    size, more = F.length("line"), (F.col("which") >= 2).cast("int")
    m = size + more
    head = F.floor((m - 1) / 2).cast("int")
    back = m - 1 - head
    rest = F.when(F.col("which") % 2 == 0, F.substr("line", head + 1, size)).otherwise(F.left("line", size - back))
    rows = front.withColumn("rest", rest).withColumn("more", more)
    itself = F.array(F.struct(together(F.transform(F.split(F.col("rest"), ""), lambda x, i: F.xxhash64(x, i))).alias("v"), F.lit(0).alias("i")))
    emitted = F.when(F.col("more") == 1, itself).when(F.length("rest") > 0, deletions(F.col("rest"))).otherwise(F.slice(itself, 1, 0))
    made = rows.select("half", "at", "k1", "k2", F.when(F.col("which") % 2 == 0, head).otherwise(0).alias("ahead"), F.inline(emitted).alias("v", "i"))
    return made.withColumn("gone", F.when(F.col("i") > 0, F.col("ahead") + F.col("i")).otherwise(0)).drop("ahead")


def without(line: str, place: str) -> Column:
    """The line without the character at ``place``, from 1; the line itself at 0."""
    at = F.col(place)
    return F.when(at == 0, F.col(line)).otherwise(F.concat(F.left(line, at - 1), F.substr(line, at + 1, F.length(line))))


def near_pairs(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(k1, k2) of distinct lines with a verified earlier partner. ``lines``: staged distinct lines."""
    keyed = lines.where("p0 is not null").select("k1", "k2", "at", F.posexplode(F.array(*HALVES)).alias("which", "half"))
    shared = keyed.groupBy("half").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("half")
    shared = staged(shared, "line-halves")
    front = staged(keyed.join(keys_of_rows(shared), "half", "left_semi"), "line-front")
    wanted = staged(front.select("k1", "k2").distinct(), "line-wanted")
    texts = lines_of(docs).select(*line_key(F.col("line")), "line").join(keys_of_rows(wanted), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    texts = staged(texts, "line-texts")
    made = variants(front.join(texts, ["k1", "k2"]))
    one, same = Window.partitionBy("half", "v"), Window.partitionBy("half", "v", "i")
    me = F.struct("at", "k1", "k2", "gone")
    found = (
        made.withColumn("itself", F.min(F.when(F.col("i") == 0, me)).over(one))
        .withColumn("cut", F.min(F.when(F.col("i") > 0, me)).over(one))
        .withColumn("twin", F.min(me).over(same))
    )
    partners = F.when(F.col("i") == 0, F.array("cut")).otherwise(F.array("itself", "twin"))
    found = found.select("k1", "k2", "gone", F.explode(F.filter(partners, lambda p: p.isNotNull() & (p["at"] < F.col("at")))).alias("p"))
    pairs = found.select("k1", "k2", "gone", F.col("p.k1").alias("o1"), F.col("p.k2").alias("o2"), F.col("p.gone").alias("other_gone")).distinct()
    other = texts.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("line").alias("other"))
    return pairs.join(texts, ["k1", "k2"]).join(other, ["o1", "o2"]).where(without("line", "gone") == without("other", "other_gone")).select("k1", "k2").distinct()


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document with first occurrences: at_doc, at_row, keep (sorted line numbers that stay), n_near (first occurrences that go)."""
    lines = staged(distinct_lines(docs, min_chars), "lines")
    gone = near_pairs(docs, lines).withColumn("near", F.lit(True))
    judged = lines.select("k1", "k2", "at").join(gone, ["k1", "k2"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    return judged.groupBy(F.col("at.doc_id").alias("at_doc"), F.col("at.row").alias("at_row")).agg(
        F.sort_array(F.collect_list(F.when(~F.col("near"), F.col("at.line_no")))).alias("keep"), F.count_if("near").alias("n_near")
    )


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: lines that are not blank, how many stay, go as exact or near copies, and the numbers of those that stay."""
    kept = kept_lines(docs, min_chars)
    blank = F.filter(F.split(text_or_empty(), "\n"), lambda x: F.regexp_replace(x, SPACE + "+", "") != "")
    counts = docs.select("doc_id", row_hash().alias("row"), F.size(blank).cast("long").alias("n_lines"))
    joined = counts.join(kept, F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("row") == F.col("at_row")), "left")
    n_kept = F.coalesce(F.size("keep"), F.lit(0)).cast("long")
    n_near = F.coalesce("n_near", F.lit(0)).cast("long")
    listed = F.coalesce(F.array_join(F.transform("keep", lambda i: i.cast("string")), ","), F.lit(""))
    return joined.select("doc_id", "n_lines", n_kept.alias("n_kept"), (F.col("n_lines") - n_kept - n_near).alias("n_exact"), n_near.alias("n_near"), listed.alias("kept_lines"))


def clean(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with the lines that stay (blank ones included), all columns kept."""
    doc, row, keep = (unused(docs, n) for n in ("at_doc", "at_row", "kept_line_numbers"))
    kept = kept_lines(docs, min_chars).select(F.col("at_doc").alias(doc), F.col("at_row").alias(row), F.col("keep").alias(keep))
    kept = staged(kept, "line-kept")
    joined = docs.join(keys_of_rows(kept), docs["doc_id"].eqNullSafe(kept[doc]) & (row_hash() == kept[row]), "left")
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.when((F.regexp_replace(x, SPACE + "+", "") == "") | F.array_contains(keep, i), x))
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
    return joined.withColumn("text", text).select(docs.columns)
