"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces already encoded.

A byte-level BPE with the usual pattern never joins a non-space character with a single space or line break that
follows it, when another non-space character comes next. Cutting there gives pieces that encode alone as they do in the
text, so a portion's distinct pieces are found by Arrow, and each is encoded once and looked up afterwards. A piece that is a word of letters, perhaps with ASCII marks
after it, is two pre-tokens, the word and its marks: such words go to the library's BPE many at a time, as a list already cut into
words, in its byte alphabet. Pieces are cut, told apart and put together as Arrow and numpy columns, never one by one.
Any other piece goes to the tokenizer as it is, and so do whole texts if the tokenizer is of another kind.
A worker that gets no text for ``IDLE_S`` seconds forgets its pieces, as Spark keeps it waiting beside the stages that follow.
The file's added tokens are matched in the text, as the library does by default; one that could reach over a cut or lie inside a
word and its marks makes the tokenizer one of another kind.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import threading
import time
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces held before the memory starts anew (some 50 bytes each with their words), and bytes of text encoded at a time.
MOST_PIECES = 800_000
CHARS_AT_ONCE = 4_000_000
#: Seconds without a text after which an encoder forgets its pieces.
IDLE_S = 2

#: White space of any kind, for the patterns of Arrow: two in a row, or one at an end, make a text uneven.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
UNEVEN = rf"(?:\A|{BLANK}){BLANK}|{BLANK}\z"
EDGE = re.compile(r"(?<=\S) (?=\S)")
#: A piece that is a word and its marks, perhaps after a line break.
WORD = r"\A(?P<newline>\n?)(?P<word>\p{L}+)(?P<marks>[!-/:-@\[-`{-~]*)\z"


def byte_alphabet() -> dict[int, int]:
    """Code point that stands for each byte: printable bytes for themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(rest)}


#: Stands at the cuts of a text; one that holds it is a piece of its own.
CUT = "\0"


def within_piece(added: dict) -> bool:
    """Whether matches of an added token lie inside one piece, and never in one that is a word and its marks."""
    content = added["content"]
    whole = not (added.get("lstrip") or added.get("rstrip") or any(c.isspace() for c in content))
    return whole and not re.fullmatch(r"[^\W\d_]*[!-/:-@\[-`{-~]*", content)


def text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def known_and_new(known: pa.Array, values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``known`` (distinct) with the new ones of ``values`` after it, and the place of each value there."""
    if not len(values):
        return known, np.zeros(0, np.int64)
    found = pa.chunked_array([known, values]).dictionary_encode().chunks[-1]
    return found.dictionary, found.indices.to_numpy().astype(np.int64)


def spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of all spans in a row."""
    done = np.cumsum(sizes)
    total = int(done[-1]) if len(done) else 0
    return values[np.repeat(starts - (done - sizes), sizes) + np.arange(total)]


def give_back() -> None:
    """Returns freed memory to the system, which the allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


class Encoder:
    def __init__(self, path: str):
        self.lock, self.used = threading.Lock(), time.monotonic()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        step = said.get("pre_tokenizer") or {}
        usual = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
        self.by_piece = bool(usual and not said.get("normalizer") and said["model"].get("type") == "BPE" and all(map(within_piece, said.get("added_tokens") or [])))
        if self.by_piece:
            self.alphabet = np.array([point for _, point in sorted(byte_alphabet().items())], "<u2")
            self.by_word = Tokenizer.from_file(path)
            self.by_word.pre_tokenizer = None
            self.widths = np.zeros(self.by_word.get_vocab_size(with_added_tokens=True), np.int64)
            for token, i in self.by_word.get_vocab().items():
                self.widths[i] = len(token)
        del said  # large, and clear() gives back what is free
        self.clear()

    def clear(self) -> None:
        """Pieces, without line breaks before and marks after words, are a column; the ids of the one numbered n lie between the ends n and n + 1."""
        self.pieces = pa.array([], pa.large_string())
        self.ids, self.ends = array("i"), array("q", [0])
        give_back()

    def forget_if_idle(self) -> None:
        with self.lock:
            if self.pieces and time.monotonic() - self.used > IDLE_S:
                self.clear()

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.int32, int(sizes.sum())), sizes

    def plain_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, with or without a space before them."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lines = pc.binary_join_element_wise(words, text("\n"), text(""))
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        raw = np.frombuffer(lines.buffers()[2], np.uint8)[ends[0] : ends[-1] - 1]
        in_bytes = self.alphabet[raw].tobytes().decode("utf-16-le").split(chr(self.alphabet[10]))
        ids = np.array(self.by_word.encode_batch_fast([in_bytes], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        # The characters of a word's tokens are the word's, one for each of its bytes: their counts tell where it ends.
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(np.diff(ends) - 1), "left") + 1
        return ids, np.diff(ends, prepend=0)

    def learn(self, new: pa.Array) -> None:
        """Appends the ids of pieces that are new."""
        is_word = pc.match_substring_regex(new, r"\A ?\p{L}+\z")
        word_ids, word_sizes = self.plain_words(new.filter(is_word))
        other_ids, other_sizes = self.plain(new.filter(pc.invert(is_word)).to_pylist())
        words, sizes = flags(is_word), np.empty(len(new), np.int64)
        sizes[words], sizes[~words] = word_sizes, other_sizes
        self.ends.frombytes((np.cumsum(sizes) + len(self.ids)).tobytes())
        own, ids = np.repeat(words, sizes), np.empty(int(sizes.sum()), np.int32)
        ids[own], ids[~own] = word_ids, other_ids
        self.ids.frombytes(ids.tobytes())

    def parts(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, with the start and the size of each part in them: three for each of ``found``, a line break, a piece and marks, each perhaps absent."""
        said = pc.extract_regex(found, WORD)
        words = flags(said.is_valid())
        newline, word, marks = (pc.fill_null(said.field(n).cast(pa.large_string()), text("")) for n in ("newline", "word", "marks"))
        broken = pc.starts_with(found, "\n")
        rest = pc.if_else(said.is_valid(), word, pc.if_else(broken, pc.utf8_slice_codeunits(found, 1), found)) if not words.all() else word
        n_known = len(self.pieces)
        self.pieces, codes = known_and_new(self.pieces, pc.binary_join_element_wise(pc.if_else(broken, text(""), text(" ")), rest, text("")))
        self.learn(self.pieces.slice(n_known))
        distinct, marks_of = known_and_new(pa.array([], pa.large_string()), marks)
        ids, sizes = self.plain(["", "\n", *distinct.to_pylist()])
        ends = np.r_[np.cumsum(sizes), np.frombuffer(self.ends, np.int64)[1:] + len(ids)]
        parts = np.array([flags(broken), codes + len(sizes), marks_of + 2]).T
        starts = np.r_[0, ends[:-1]][parts]
        return np.r_[ids, np.frombuffer(self.ids, np.int32)], starts, ends[parts] - starts

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text ends in them."""
        with self.lock:
            found = self.looked_up(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
            self.used = time.monotonic()
            return found

    def looked_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_piece:
            ids, sizes = self.plain(texts.to_pylist())
            return ids, np.cumsum(sizes)
        if len(self.pieces) > MOST_PIECES:
            self.clear()
        cut, at_cuts = pc.replace_substring(texts, "\n", " \n"), " "
        holds_cut = pc.match_substring(texts, CUT)
        apart = pc.or_(holds_cut, pc.match_substring_regex(texts, UNEVEN))
        if pc.any(apart).as_py():
            own = ["" if CUT in x else EDGE.sub(CUT, x) for x in texts.filter(apart).to_pylist()]
            cut, at_cuts = pc.replace_with_mask(pc.replace_substring(cut, " ", CUT), apart, pa.array(own, pa.large_string())), CUT
        lists = pc.split_pattern(cut, at_cuts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        # The first piece of a text has no space before it, and is encoded for itself.
        first = np.zeros(int(offsets[-1]), bool)
        first[offsets[:-1]] = True
        flat = lists.flatten()
        heads = pc.if_else(holds_cut, texts, flat.filter(pa.array(first))).to_pylist()
        found, places = known_and_new(pa.array([], pa.large_string()), flat.filter(pa.array(~first)))
        ids, starts, sizes = self.parts(found)
        whole, (head_ids, head_sizes) = sizes.sum(axis=1), self.plain(heads)
        ids = np.r_[spans(ids, starts.reshape(-1), sizes.reshape(-1)), head_ids]
        sizes = np.r_[whole, head_sizes]
        codes = np.empty(len(first), np.int64)
        codes[~first], codes[first] = places, len(found) + np.arange(len(heads))
        starts = (np.cumsum(sizes) - sizes)[codes]
        sizes = sizes[codes]
        return spans(ids, starts, sizes), np.r_[0, np.cumsum(sizes)][offsets[1:]]


_held: dict[str, Encoder] = {}


def forget_when_idle(tool: Encoder) -> None:
    while True:
        time.sleep(IDLE_S)
        tool.forget_if_idle()


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _held:
        _held[path] = Encoder(path)
        threading.Thread(target=forget_when_idle, args=[_held[path]], daemon=True).start()
    return _held[path]


def gathered(batches: Iterator[pa.RecordBatch], column: int, chars_at_once: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches put together up to that many bytes of text, as every portion looks all pieces held up anew."""
    held, chars = [], 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and chars + own > chars_at_once:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, chars = [], 0
        if batch.num_rows:
            held, chars = [*held, batch], chars + own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encoded(texts: list[str] | pa.Array, path: str, end_id: int, chars_at_once: int = CHARS_AT_ONCE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, ids of each text with ``end_id`` appended), a bounded number of bytes of text at a time."""
    tool = encoder(path)
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    sizes = pc.binary_length(texts).to_pylist()
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars + sizes[last] <= chars_at_once):
            chars += sizes[last]
            last += 1
        ids, ends = tool.encode(texts.slice(first, last - first))
        with_end = np.insert(ids, ends, end_id).astype(np.uint32)
        ends = ends + np.arange(1, len(ends) + 1)
        yield first, np.split(with_end, ends[:-1])
        first = last
