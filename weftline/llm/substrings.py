"""Substring dedup by compaction of a De Bruijn graph of words.

A window is ``size`` consecutive words of a document. A word goes if a window covers it whose words also begin somewhere in a document with a
smaller doc_id. Windows are the edges of a De Bruijn graph (nodes: size - 1 words), but only few of them ever become rows:

1. Neighbouring windows that share their minimizer (the least hash of ``MINIMIZER`` consecutive words within a window) make one
   piece, some 18 windows: a path that is compact from the start. Equal windows have equal minimizers, so a minimizer that
   occurs with one doc_id alone has no repeated window, and its pieces go no further.
2. Of the rest, a minimizer with one distinct piece settles that piece as a whole. The windows of the distinct pieces of other minimizers
   become edges one by one; copies of a piece emit them once, from the place where the piece comes first.
3. Edges that occur with two doc_ids stay. Each has a source coordinate: its first place in the document with the smallest id.
   An edge's successor is the only edge that leaves the node which it alone enters, if the coordinates say that it follows in the
   same source document. These nonbranching paths compact by doubling joins, so a path of n edges takes log2(n) of them.
4. Every path is a stretch of one source document. Pieces of later documents that hold windows of it become spans there, and spans that
   follow each other in both documents join to long ones; the words that they cover are removed.

Windows, pieces and words are compared by 128 bits of hash. Hot minimizers, pieces and windows are spread over tasks; texts only
meet keys of their own document. What a step leaves is written to the shared folder.

Edge cases: null text has no words. A null doc_id is not smaller than any, nor has it smaller ones: such rows neither lose words nor take any. Rows
that share a doc_id don't take words from each other. Texts below ``size`` words stay; very long texts are taken whole; an
empty table gives an empty result. ``remove_repeats`` keeps the columns named in ``keep`` and ignores the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, discard, fresh_path, join_hot, keys_of_rows, release, staged, unused
from .words import MULTIPLIERS, coded, grouped, mixed, rolled, sliding_min, within, word_hashes

SIZE = 50
MINIMIZER = 16
PLACE = ["doc_id", "row", "pos"]
PIECE = "doc_id bigint, row bigint, pos int, n int, m bigint, p1 bigint, p2 bigint, src bigint, dst bigint"
WINDOW = "doc_id bigint, row bigint, pos int, p1 bigint, p2 bigint, off int, last bigint, w1 bigint, w2 bigint, src bigint, dst bigint"
#: off, n: windows within a piece. path: the source document and where the path begins there; first: where these windows do.
ENTRY = "struct<off:int,n:int,doc_id:bigint,row:bigint,path:int,first:int>"
SPANS = "array<struct<start:bigint,n_words:bigint,first_doc:bigint,first_start:bigint>>"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in StructType.fromDDL(ddl)])


def long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def comparable(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """doc_id, row (tells texts of one doc_id apart), body: rows that can hold a window."""
    return docs.where(F.col("doc_id").isNotNull() & (F.length(text) >= 2 * size - 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("body"))


def window_hashes(texts: list[list[bytes]], size: int) -> tuple[np.ndarray, ...]:
    """For all words of all texts on end: two hashes of the window from there, hash of the node before it, of one word's hashes, and bounds."""
    codes, distinct, bounds = coded(texts)
    one, two = (h[codes] for h in word_hashes(distinct))
    return rolled(one, size), rolled(two, size), rolled(one, size - 1), one, bounds


def pieces(docs: DataFrame, size: int = SIZE, length: int = MINIMIZER) -> DataFrame:
    """Stretches of neighbouring windows with one minimizer."""
    schema = arrow_schema(PIECE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, rows = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "row"))
            for at, texts in grouped(batch.column("body")):
                if not any(texts):
                    continue
                w1, w2, nodes, words, bounds = window_hashes(texts, size)
                least = sliding_min(rolled(words, length), size - length + 1)
                counts = np.maximum(np.diff(bounds) - size + 1, 0)
                owner = np.repeat(np.arange(len(counts)), counts)
                pos = within(counts)
                place = bounds[owner] + pos
                if not len(place):
                    continue
                m = least[place]
                new = np.ones(len(place), bool)
                new[1:] = (m[1:] != m[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(place)))
                step = within(n).astype(np.uint64) * MULTIPLIERS[1]
                p1, p2 = (np.add.reduceat(mixed(w[place] + step), first) for w in (w1, w2))
                start, who = place[first], owner[first]
                made = [doc_ids[at + who], rows[at + who], pos[first].astype(np.int32), n.astype(np.int32), long(m[first]), long(p1), long(p2), long(nodes[start]), long(nodes[start + n])]
                yield pa.record_batch([pa.array(x) for x in made], schema=schema)

    return comparable(docs, size).mapInArrow(cut, PIECE)


def windows(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """Every window of the pieces listed in ``pieces`` (pos, n, last, p1, p2), with the nodes that it joins."""
    schema = arrow_schema(WINDOW)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, rows = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "row"))
            listed = batch.column("pieces")
            for at, texts_ in grouped(batch.column("body")):
                w1, w2, nodes, _, bounds = window_hashes(texts_, size)
                some = listed.slice(at, len(texts_))
                who = np.repeat(np.arange(len(texts_)), np.asarray(some.value_lengths()))
                flat = some.flatten()
                pos, n, last, p1, p2 = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "n", "last", "p1", "p2"))
                each = np.repeat(np.arange(len(n)), n)
                off = within(n)
                place = bounds[who[each]] + pos[each] + off
                made = [doc_ids[at + who[each]], rows[at + who[each]], (pos[each] + off).astype(np.int32), p1[each], p2[each], off.astype(np.int32), last[each], long(w1[place]), long(w2[place]), long(nodes[place]), long(nodes[place + 1])]
                yield pa.record_batch([pa.array(x) for x in made], schema=schema)

    return texts.select("doc_id", "row", "body", "pieces").mapInArrow(emit, WINDOW)


def successors(edges: DataFrame) -> DataFrame:
    """Place of an edge and ``before``, the place (in the same source document) of the edge that it alone follows."""
    me = F.struct(*PLACE, "n")
    ends = F.array(F.struct(F.col("dst").alias("node"), me.alias("enters"), F.lit(None).cast(edges.select(me.alias("e")).schema["e"].dataType).alias("leaves")), F.struct(F.col("src").alias("node"), F.lit(None).cast(edges.select(me.alias("e")).schema["e"].dataType).alias("enters"), me.alias("leaves")))
    at_nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.count("enters").alias("n_in"), F.count("leaves").alias("n_out"), F.min("enters").alias("a"), F.min("leaves").alias("b"))
    follows = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.pos") + F.col("a.n") == F.col("b.pos"))
    return at_nodes.where((F.col("n_in") == 1) & (F.col("n_out") == 1) & follows).select("b.doc_id", "b.row", "b.pos", F.col("a.pos").alias("before"))


def compacted(edges: DataFrame) -> DataFrame:
    """Every edge with ``path``, the place of its path's first edge. Places grow along a path, so there are no cycles."""
    spark = edges.sparkSession
    where = fresh_path(spark, "path-heads")
    heads = staged(edges.select(*PLACE).join(successors(edges), PLACE, "left").select(*PLACE, F.coalesce("before", "pos").alias("path")), "", where)
    while True:
        jump = heads.select("doc_id", "row", F.col("pos").alias("path"), F.col("path").alias("further"))
        after = fresh_path(spark, "path-heads")
        longer = staged(heads.join(jump, ["doc_id", "row", "path"]).select(*PLACE, F.col("further").alias("path"), (F.col("further") != F.col("path")).alias("moved")), "", after)
        discard(spark, where)
        heads, where = longer.select(*PLACE, "path"), after
        if longer.where("moved").isEmpty():
            return edges.join(heads, PLACE)


def spans_of(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, row, spans: windows of the document (start, n) that a document with a smaller doc_id has, with their path there."""
    spark = docs.sparkSession
    bounded_batches(spark)
    cut = staged(pieces(docs, size), "pieces")
    total = cut.count()
    differ = (F.min("p1") != F.max("p1")) | (F.min("p2") != F.max("p2"))
    shared = cut.groupBy("m").agg(F.count("*").alias("size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), differ.alias("mixed")).where("low < high").select("m", "size", "mixed")
    shared = staged(shared, "minimizers")
    held = staged(join_hot(cut, shared, ["m"], "size", total, "row").drop("size", "m"), "shared-pieces")
    release(spark)
    place = F.struct(*PLACE)
    distinct = held.groupBy("p1", "p2").agg(F.min(place).alias("at"), F.max("doc_id").alias("last"), F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("n", "mixed", "src", "dst")])
    distinct = staged(distinct, "distinct-pieces")
    listed = distinct.where("mixed").groupBy("at.doc_id", "at.row").agg(F.collect_list(F.struct("at.pos", "n", "last", "p1", "p2")).alias("pieces"))
    sources = comparable(docs, size).join(keys_of_rows(listed), ["doc_id", "row"])
    single = staged(windows(sources, size), "piece-windows")
    release(spark)
    edge = single.groupBy("w1", "w2").agg(F.min(place).alias("at"), F.max("last").alias("last"), F.count("*").alias("size"), F.first("src").alias("src"), F.first("dst").alias("dst"))
    edge = edge.where(F.col("at.doc_id") < F.col("last")).select("w1", "w2", "at.*", F.lit(1).alias("n"), "src", "dst", "size")
    whole = distinct.where(~F.col("mixed") & (F.col("at.doc_id") < F.col("last"))).select(F.col("p1").alias("w1"), F.col("p2").alias("w2"), "at.*", "n", "src", "dst", "size")
    edges = staged(edge.withColumn("mixed", F.lit(True)).unionByName(whole.withColumn("mixed", F.lit(False))), "edges")
    edges = staged(compacted(edges), "path-edges")
    release(spark)
    known = F.struct(F.lit(0).alias("off"), "n", "doc_id", "row", "path", F.col("pos").alias("first")).cast(ENTRY)
    settled = edges.where("not mixed").select(F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.array(known).alias("entries"))
    where_ = edges.where("mixed").select("w1", "w2", "size", "doc_id", "row", "path", F.col("pos").alias("first"))
    met = join_hot(single.select("w1", "w2", "p1", "p2", "off"), where_, ["w1", "w2"], "size", single.count(), "p1")
    # Windows of a piece that lie on one path a constant way apart make one entry, if none between is missing.
    offs = F.array_sort(F.collect_set("off"))
    runs = met.groupBy("p1", "p2", "doc_id", "row", "path", (F.col("first") - F.col("off")).alias("apart")).agg(offs.alias("offs"))
    entry = lambda off, n: F.struct(off.alias("off"), n.alias("n"), "doc_id", "row", "path", (F.col("apart") + off).alias("first")).cast(ENTRY)
    n_offs = F.size("offs")
    dense = F.col("offs")[n_offs - 1] - F.col("offs")[0] + 1 == n_offs
    each = F.when(dense, F.array(entry(F.col("offs")[0], n_offs))).otherwise(F.transform("offs", lambda o: entry(o, F.lit(1))))
    found = runs.select("p1", "p2", each.alias("entries")).groupBy("p1", "p2").agg(F.flatten(F.collect_list("entries")).alias("entries"))
    entries = staged(settled.unionByName(found).join(distinct.select("p1", "p2", "size"), ["p1", "p2"]), "piece-entries")
    here = join_hot(held.select("p1", "p2", *PLACE), entries.withColumnRenamed("entries", "_entries"), ["p1", "p2"], "size", held.count(), "row")
    earlier = F.filter("_entries", lambda e: e["doc_id"] < F.col("doc_id"))
    moved = F.transform(earlier, lambda e: F.struct((F.col("pos") + e["off"]).alias("start"), e["n"].alias("n"), e["doc_id"].alias("doc"), e["row"].alias("source"), e["path"].alias("path"), e["first"].alias("first")))
    spans = here.select("doc_id", "row", moved.alias("spans")).where(F.size("spans") > 0).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = staged(spans, "spans")
    release(spark)
    return out


def joined(spans: list[dict], size: int) -> list[dict]:
    """Spans that follow each other, or overlap, on one path and equally far apart, as long ones; in words."""
    out: list[dict] = []
    last = None
    for s in sorted(spans, key=lambda s: (s["doc"], s["source"], s["path"], s["first"] - s["start"], s["start"])):
        key = s["doc"], s["source"], s["path"], s["first"] - s["start"]
        if key == last and s["start"] <= out[-1]["start"] + out[-1]["n_words"] - size + 1:
            out[-1]["n_words"] = max(out[-1]["n_words"], s["start"] + s["n"] - 1 + size - out[-1]["start"])
        else:
            out.append({"start": s["start"], "n_words": s["n"] - 1 + size, "first_doc": s["doc"], "first_start": s["first"]})
        last = key
    return sorted(out, key=lambda s: (s["start"], s["first_doc"], s["first_start"]))


def remove_repeats(docs: DataFrame, keep: Sequence[str], size: int = SIZE) -> DataFrame:
    """The columns ``keep``, then n_words, n_removed, kept (the words that stay, joined by a space) and spans (long repeated stretches, with their first source).

    The four get underscores before their names where ``keep`` has such columns.
    """
    spans = spans_of(docs, size)
    plain = docs.select(*keep)
    key, row, found, body, *names = (unused(plain, n) for n in ("at_doc", "at_row", "found", "body", "n_words", "n_removed", "kept", "spans"))
    spans = spans.select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("spans").alias(found))
    can_hold = F.col("doc_id").isNotNull() & (F.length("text") >= 2 * size - 1)
    texts = docs.select(*keep, F.col("text").alias(body), F.when(can_hold, F.col("doc_id").cast("bigint")).alias(key), F.when(can_hold, F.xxhash64("text")).alias(row))
    kind = spans.schema[found].dataType
    # Texts that can't hold a window go without the join: their keys are null and would meet in one task.
    with_spans = texts.where(F.col(key).isNotNull()).join(keys_of_rows(spans), [key, row], "left").select(*keep, body, found)
    all_texts = with_spans.unionByName(texts.where(F.col(key).isNull()).select(*keep, body, F.lit(None).cast(kind).alias(found)))
    added = StructType.fromDDL(f"a bigint, b bigint, c string, d {SPANS}")
    for f, n in zip(added, names, strict=True):
        f.name = n
    schema = StructType([*plain.schema.fields, *added.fields])
    span_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "n_words", "first_doc", "first_start")]))

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(i) for i in range(batch.num_columns - 2)]
            listed = batch.column(batch.num_columns - 1)
            for at, texts in grouped(batch.column(batch.num_columns - 2)):
                removed, left, shown = [], [], []
                for i, t in enumerate(texts):
                    own = joined(listed[at + i].as_py() or [], size)
                    gone = np.zeros(len(t) + 1, np.int64)
                    for s in own:
                        gone[s["start"]] += 1
                        gone[s["start"] + s["n_words"]] -= 1
                    stays = np.cumsum(gone[:-1]) == 0
                    removed.append(len(t) - int(stays.sum()))
                    left.append(b" ".join(w for w, s in zip(t, stays.tolist(), strict=True) if s) if own else b" ".join(t))
                    shown.append(own)
                made = [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array([x.decode() for x in left], pa.string()), pa.array(shown, span_type)]
                yield pa.record_batch([*[c.slice(at, len(texts)) for c in kept], *made], schema.names)

    return all_texts.mapInArrow(strike, schema)


def kept_digest(found: DataFrame) -> DataFrame:
    """doc_id, numbers of words and of removed ones, and the hash of the words that stay."""
    digest: Column = F.sha2("kept", 256)
    return found.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))
