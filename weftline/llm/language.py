"""Language identification by cross-parsing entropy.

Training: per language a bounded sample of labelled texts (``SAMPLE_CHARS`` characters; a piece of each distinct
text, at a hashed place of the whole text, in the order of a seeded hash) becomes a suffix automaton: its paths from the start are exactly the substrings of the sample. A text is parsed
greedily into the longest phrases the sample contains; unlike text breaks into more and shorter phrases. A phrase
costs log2(sample length) bits, so the count is normalised by the size of the sample as well as by the length of the
text, and the language with the fewest bits per character wins.

Characters: every letter, lower case, is a sign of its own; each run of anything else is one sign. A letter that a
language's sample lacks is a phrase of its own there. Edges of a sample's most frequent letters are in a dense table, those of
all its others in a sorted list. Automata are trained on the executors and kept in the shared folder; any number of
languages takes part, so many at a time as fit ``STATES_AT_ONCE``. Texts are parsed in segments of ``SEGMENT`` characters, all segments of a batch in step; a segment's end closes a
phrase for every language alike.

The labels of a table are the rows whose lang is not null and whose crc32(doc_id as text) mod 4 is not 2; the others
are held out. lang, source and doc_id take no part in a prediction. Score: 1 - bits of the best / bits of the next.

Edge cases: null text or text without letters gives ``und`` and score 0; a training table without labelled letters
gives ``und`` for all, and a language without labelled letters takes no part; with one language only, the score is 1; equal bits go to the language that comes first in code-point
order; repeated rows are predicted each for itself; very long texts are parsed whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged
from .common import facts as as_facts

#: Bound of the training sample per language.
SAMPLE_CHARS = 60_000
#: States of the automata that a worker holds at a time (some 260 bytes each at most).
STATES_AT_ONCE = 1_000_000
#: Letters of a language, its most frequent ones, whose edges are in a dense table.
DENSE_LETTERS = 62
SEGMENT = 256
UNKNOWN, GAP = 0, 1
UNDETERMINED = "und"
AUTOMATA = "lang string, states long, length long, letters binary, edges binary, targets binary"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@cache
def sign_table() -> np.ndarray:
    """Sign of every code point: a letter's lower case, or the gap."""
    table = np.full(0x110000, GAP, np.uint32)
    for i in range(0x40000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def signs(text: str) -> np.ndarray:
    """A text's signs, with runs of gaps as one."""
    found = sign_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = found == GAP
    return found[~(gap & np.r_[False, gap[:-1]])] if len(found) else found


def automaton(sample: np.ndarray, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Suffix automaton: number of states, edges as state * width + sign in ascending order, and the states they lead to. 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for sign in sample.tolist():
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and sign not in edges[at]:
            edges[at][sign] = now
            at = link[at]
        if at != -1:
            to = edges[at][sign]
            if length[at] + 1 == length[to]:
                link[now] = to
            else:
                copy = len(edges)
                edges.append(dict(edges[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at != -1 and edges[at].get(sign) == to:
                    edges[at][sign] = copy
                    at = link[at]
                link[to] = link[now] = copy
        last = now
    keys = np.fromiter((state * width + sign for state, out in enumerate(edges) for sign in out), np.int64)
    targets = np.fromiter((to for out in edges for to in out.values()), np.int32)
    order = np.argsort(keys)
    return len(edges), keys[order], targets[order]


class Trained(NamedTuple):
    """A language's automaton as it is kept: signs of its edges are 1 for the gap, and from 2 on for ``letters``."""

    lang: str
    states: int
    length: int
    letters: np.ndarray
    edges: np.ndarray
    targets: np.ndarray


def train(lang: str, sample: str) -> Trained | None:
    """Nothing for a sample without letters."""
    found = signs(sample)
    letters, times = np.unique(found[found != GAP], return_counts=True)
    if not len(letters):
        return None
    letters = letters[np.argsort(-times, kind="stable")]
    local = np.full(int(letters.max()) + 1, GAP, np.int64)
    local[letters] = np.arange(len(letters)) + 2
    states, edges, targets = automaton(local[found], len(letters) + 2)
    return Trained(lang, states, len(found), letters, edges, targets)


class Language:
    """An automaton ready to parse: 0 says that there is no such edge."""

    def __init__(self, kept: Trained):
        self.name, self.letters = kept.lang, kept.letters
        self.cost = float(np.log2(max(kept.length, 2)))
        self.signs = len(kept.letters) + 2
        self.width = min(self.signs, DENSE_LETTERS + 2)
        state, sign = np.divmod(kept.edges, self.signs)
        dense = sign < self.width
        self.table = np.zeros((kept.states, self.width), np.int32)
        self.table[state[dense], sign[dense]] = kept.targets[dense]
        self.edges, self.targets = kept.edges[~dense], kept.targets[~dense]
        self.start = np.zeros(self.signs, np.int32)
        first = state == 0
        self.start[sign[first]] = kept.targets[first]

    def local(self, columns: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Own signs for a batch's: 0, the gap, and from 2 on ``letters``."""
        order = np.argsort(self.letters)
        known = self.letters[order]
        at = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        own = np.where(known[at] == letters, order[at] + 2, UNKNOWN)
        return np.r_[UNKNOWN, GAP, own].astype(np.int64)[columns]

    def follow(self, state: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Targets of edges outside the dense table."""
        wanted = state.astype(np.int64) * self.signs + sign
        at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
        return np.where(self.edges[at] == wanted, self.targets[at], 0)

    def phrases(self, columns: np.ndarray, letters: np.ndarray, active: list[int]) -> np.ndarray:
        """Phrases of every segment. ``columns``: segments as columns, longest first; ``active``: how many reach each row."""
        flat = self.table.reshape(-1)
        own = self.local(columns, letters)
        rare = own >= self.width
        any_rare = rare.any(axis=1)
        state, ended = np.zeros(columns.shape[1], np.int32), np.zeros(columns.shape[1], np.int32)
        for step, n in enumerate(active):
            if not n:
                break
            sign = own[step, :n]
            now = state[:n]
            if any_rare[step]:
                at = np.flatnonzero(rare[step, :n])
                dense = sign.copy()
                dense[at] = UNKNOWN
                to = flat[now.astype(np.int64) * self.width + dense]
                to[at] = self.follow(now[at], sign[at])
            else:
                to = flat[now.astype(np.int64) * self.width + sign]
            stuck = to == 0
            # A phrase ends before this sign, which opens the next one; a sign the sample lacks is a phrase of its own.
            ended[:n] += stuck & (now != 0)
            again = self.start[sign]
            ended[:n] += stuck & (again == 0)
            state[:n] = np.where(stuck, again, to)
        return ended + (state != 0)


class Parse:
    """Texts against languages in code-point order: the least bits a character, whose they are, and the next."""

    def __init__(self, texts: list[str | None]):
        found = [signs(t or "") for t in texts]
        self.letters = np.array([bool((s != GAP).any()) for s in found])
        self.sizes = np.array([len(s) for s in found])
        parts = -(-self.sizes // SEGMENT)
        flat = np.concatenate([*found, np.zeros(0, np.uint32)])
        self.alphabet = np.unique(flat[flat != GAP])
        compact = np.where(flat == GAP, GAP, np.searchsorted(self.alphabet, flat) + 2).astype(np.int32)
        # Cell of each sign: texts begin with a segment of their own.
        begin = np.repeat((np.cumsum(parts) - parts) * SEGMENT - (np.cumsum(self.sizes) - self.sizes), self.sizes)
        padded = np.zeros(int(parts.sum()) * SEGMENT, np.int32)
        padded[begin + np.arange(len(flat))] = compact
        owner = np.repeat(np.arange(len(texts)), parts)
        lengths = np.full(len(owner), SEGMENT)
        ends = np.cumsum(parts)[parts > 0] - 1
        lengths[ends] = (self.sizes - (parts - 1) * SEGMENT)[parts > 0]
        order = np.argsort(-lengths, kind="stable")  # segments that have ended drop off the end
        self.columns, self.owner = np.ascontiguousarray(padded.reshape(-1, SEGMENT)[order].T), owner[order]
        self.active = (len(lengths) - np.searchsorted(np.sort(lengths), np.arange(1, SEGMENT + 1), "left")).tolist()
        self.least, self.next = np.full(len(texts), np.inf), np.full(len(texts), np.inf)
        self.names = np.full(len(texts), UNDETERMINED, object)

    def against(self, language: Language) -> None:
        counts = np.bincount(self.owner, language.phrases(self.columns, self.alphabet, self.active), len(self.sizes))
        bits = counts * language.cost / np.maximum(self.sizes, 1)
        better = bits < self.least
        self.next = np.where(better, self.least, np.minimum(self.next, bits))
        self.least = np.where(better, bits, self.least)
        self.names[better] = language.name

    def verdicts(self) -> tuple[list[str], list[float], list[float]]:
        ok = self.letters & np.isfinite(self.least)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isinf(self.next), 1.0, np.clip(1 - self.least / np.maximum(self.next, 1e-12), 0, 1))
        return np.where(ok, self.names, UNDETERMINED).tolist(), np.where(ok, score, 0.0).tolist(), np.where(ok, self.least, 0.0).tolist()


def sampled(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, before, piece): at most ``sample_chars`` characters of labelled text per language and the rest of a piece, drawn in hash order."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # A language needs at most sample_chars texts of one character; far fewer here. Pieces keep a long text from filling the sample.
    size = F.lit(sample_chars // 20)
    rows = rows.select("lang", "text", F.xxhash64(F.lit(23), "text").alias("h"), F.xxhash64(F.lit(24), "text").alias("h2"))
    once = rows.select("lang", "h", "h2", F.least(F.length("text"), size).alias("n")).distinct()
    facts = once.groupBy("lang").agg(F.sum("n").alias("chars"), F.count("*").alias("rows"))
    at = F.pmod("h2", F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int") + 1
    # Rows below a hash threshold that makes some twice the wanted characters likely; then in order until the sample is full.
    share = F.least(F.lit(1.0), F.lit(2.0 * sample_chars) / F.greatest("chars", F.lit(1)) + F.lit(8.0) / F.col("rows"))
    facts = staged(facts.select("lang", F.floor(share * float(1 << 31)).alias("near")), "language-facts")
    chosen = rows.join(as_facts(facts), "lang").where(F.shiftrightunsigned("h", 33) <= F.col("near"))
    chosen = chosen.select("lang", "h", "h2", F.substr("text", at, size).alias("piece")).distinct()
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("lang").orderBy("h", "h2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chosen.withColumn("before", before).where(F.col("before") < sample_chars).select("lang", "before", "piece")


def trained(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Staged automata, one row per language that has letters."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        sample = (" " + " ".join(rows.sort_values("before", kind="stable")["piece"]))[: sample_chars + 1]
        kept = train(rows["lang"].iloc[0], sample)
        values = [] if kept is None else [(kept.lang, kept.states, kept.length, kept.letters.astype("<u4").tobytes(), kept.edges.astype("<i8").tobytes(), kept.targets.astype("<i4").tobytes())]
        return pd.DataFrame(values, columns=["lang", "states", "length", "letters", "edges", "targets"])

    return staged(sampled(docs, sample_chars).groupBy("lang").applyInPandas(one, AUTOMATA), "language-automata")


def shared_groups(automata: DataFrame) -> list:
    """Broadcasts of some languages each, in code-point order; the driver holds one group at a time."""
    spark, groups, states = automata.sparkSession, [], STATES_AT_ONCE
    for r in automata.select("lang", "states").orderBy("lang").collect():
        if states + r["states"] > STATES_AT_ONCE:
            groups.append([])
            states = 0
        groups[-1].append(r["lang"])
        states += r["states"]
    shared = []
    for names in groups:
        rows = automata.where(F.col("lang").between(names[0], names[-1])).collect()
        kept = [Trained(r["lang"], r["states"], r["length"], np.frombuffer(r["letters"], "<u4"), np.frombuffer(r["edges"], "<i8"), np.frombuffer(r["targets"], "<i4")) for r in rows]
        shared.append(spark.sparkContext.broadcast(sorted(kept, key=lambda t: t.lang)))
    return shared


def predictor(shared: list):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_char", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            first = 0
            while first < len(texts):
                last, chars = first, 0
                while last < len(texts) and (last == first or chars < 3_000_000):
                    chars += len(texts[last] or "")
                    last += 1
                parse = Parse(texts[first:last])
                if len(shared) == 1:
                    only = only or [Language(k) for k in shared[0].value]
                    for language in only:
                        parse.against(language)
                else:
                    for group in shared:
                        for kept in group.value:
                            parse.against(Language(kept))
                        if group._path:  # read again from the worker's file when its turn comes
                            del group._value
                names, scores, bits = parse.verdicts()
                yield pa.record_batch([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], schema=schema)
                first = last

    return run


def identify(docs: DataFrame, automata: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(predictor(shared_groups(automata)), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_char double")


def train_and_identify(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    return identify(docs, trained(docs, sample_chars))
