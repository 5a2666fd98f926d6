"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Each task tokenises its documents and cuts overlong ones into full windows, which need no packing.
The rests wait until their tokens fill a block; then the longest goes first, each into the open
window with the least sufficient room, which a segment tree over remaining capacities finds in
log(window) steps. Blocks never meet, so nothing is shuffled, memory is bounded by the block, and
a task that is run again gives the same windows.

A window that is not full is padded, unless its length is a power of two; the last windows of a
block are therefore the only ones that waste much, a few windows in thousands.

Words repeat, so that a task encodes each distinct white-space word once with the tokenizer and
puts texts together from those ids. That equals encoding the whole text if the tokenizer drops white
space, folds case, keeps digits apart and never merges over white space; a tokenizer that does not is refused when it
is loaded. Words of ASCII letters go straight to the tokenizer's model, as nothing else of it changes or cuts them, which is
checked as well. Texts that hold a special token's string, in whatever letter case, are always encoded whole and as they stand.
When a worker has too many words, it goes on with those it meets again and again.

Defined cases: a null text is empty and is packed as the end id alone. Repeated rows are packed
each. A null id is packed like any other. An empty table gives an empty result; other columns are
never looked at.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import once_per_worker, pick, return_memory

WINDOW = 2048
BLOCK_TOKENS = 1 << 24
# Words kept by a worker, and the bytes of those words: some 100 MB.
WORDS_KEPT = 600_000
BYTES_KEPT = 24 << 20
MARK = "0"
SIGNS = ".,"
# Words that the tokenizer gets at a time; it slows down on longer texts.
TOGETHER = 256


class RoomTree:
    """Open windows by remaining room. A segment tree over 0..window holds how many windows have
    a room in each span, and finds the least room that is at least the wanted one."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.open[room].append(which)
        self._change(room, 1)

    def take(self, wanted: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``wanted``, and its room."""
        node = self.leaves + wanted
        if not self.count[node]:
            # Up until a right sibling has an open window, then down its leftmost path.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return self.open[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each piece its window and offset, and the number of windows."""
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = RoomTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        if found is None:
            found, used = (used, window), used + 1
        which[i], offset[i] = found[0], window - found[1]
        if found[1] > size:
            tree.add(found[1] - size, found[0])
    return which, offset, used


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places of spans one after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(4096)
def _letter(char: str) -> bool:
    """Whether a character is a letter, also in lower case and in NFC, which takes some apart into a letter and a mark."""
    return len(low := unicodedata.normalize("NFC", char).lower()) == 1 and low.isalpha()


class WordEncoder:
    """Ids of texts from the ids of their words, which are kept while there are not too many."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        # A task has one core; a thread for each core of the machine would keep a heap of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        ids = self.tokenizer.get_vocab(with_added_tokens=True).values()
        self.kind = np.uint16 if max(ids, default=0) < 1 << 16 else np.uint32
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        one = {s: self.tokenizer.encode(s, add_special_tokens=False).ids for s in SIGNS}
        self.signs = {s: ids[0] for s, ids in one.items() if len(ids) == 1}
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._check()
        # The model alone, for words that reach it unchanged and in one piece.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.straight = self._letters_are_left_alone()
        self.known: dict[str, int] = {}
        self.held_bytes = 0
        self.flat = np.zeros(0, self.kind)
        self.starts, self.lens, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _check(self) -> None:
        """Raises unless texts can be put together from their words."""
        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        words = ["the", "th", "e", "in", "g", "ing", "a", "b", "ab", "é", "x1", "word.", "7", "70", "(", "))", "漢字", "don't"]
        for space in (" ", "\n", "\t", "  \r\n "):
            if ids(space.join(["", *words, ""])) != [i for w in words for i in ids(w)]:
                raise ValueError("the tokenizer does not drop white space, or merges over it")
        if any(ids(w.upper() if w.isascii() else w) != ids(w) for w in words):
            raise ValueError("the tokenizer does not fold case")
        if any(len(ids(d)) != 1 for d in "0123456789") or ids("a00b") != [*ids("a"), self.mark, self.mark, *ids("b")]:
            raise ValueError("the tokenizer does not keep digits apart")

    def _letters_are_left_alone(self) -> bool:
        """Whether words of ASCII letters have the same ids from the model alone: all of one and two letters, and long ones."""
        words = [*ascii_lowercase, *(a + b for a in ascii_lowercase for b in ascii_lowercase)]
        words += ["".join(words), ascii_lowercase[::-1] * 40, "a" * 1000, "understandings", "don", MARK]
        full, bare = (t.encode_batch_fast(words, add_special_tokens=False) for t in (self.tokenizer, self.model))
        return all(f.ids == b.ids for f, b in zip(full, bare, strict=True))

    def _forget(self) -> None:
        """Keeps the words met most often, at most half of what may be kept, and of them only those met again."""
        words = list(self.known)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        often = np.argsort(-self.uses, kind="stable")[:WORDS_KEPT // 2]
        often = np.sort(often[(self.uses[often] > 1) & (np.cumsum(sizes[often]) <= BYTES_KEPT // 2)])
        self.known = dict(zip([words[i] for i in often.tolist()], range(len(often)), strict=True))
        self.held_bytes = int(sizes[often].sum())
        self.flat = self.flat[_spans(self.starts[often], self.lens[often])]
        self.lens, self.uses = self.lens[often], self.uses[often] // 2
        self.starts = np.cumsum(self.lens) - self.lens

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        lowered = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(lowered)
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat, starts, lens = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lens = lens[codes]
        ends = np.concatenate(([0], np.cumsum(lens)))
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        counts = ends[bounds[1:]] - ends[bounds[:-1]]
        ids = flat[_spans(starts[codes], lens)]
        special = np.zeros(len(texts), bool)
        data = lowered.buffers()[2]
        held = data.to_pybytes() if data is not None else b""  # of all texts: hardly ever has one
        for s in self.special:
            if s.encode() in held:
                special |= pc.match_substring(lowered, s).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(special).tolist()
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in whole:
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.kind)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def _lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words one after another, and for each word its place and number of them."""
        if len(self.known) > WORDS_KEPT or self.held_bytes > BYTES_KEPT:
            self._forget()
        words, signs = self._cores(words)
        found = list(map(self.known.get, words))
        gaps = [i for i, n in enumerate(found) if n is None]
        if gaps:
            new = list(dict.fromkeys([words[i] for i in gaps]))
            self._add(new, *self._encode_words(new))
            for i in gaps:
                found[i] = self.known[words[i]]
        at = np.array(found, np.int64)
        self.uses[at] += 1
        signed = signs >= 0
        lens = self.lens[at] + signed
        ends = np.cumsum(lens)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, self.kind)
        inner = np.ones(len(flat), bool)
        inner[ends[signed] - 1] = False
        flat[ends[signed] - 1] = signs[signed]
        flat[inner] = self.flat[_spans(self.starts[at], self.lens[at])]
        return flat, ends - lens, lens

    def _cores(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Words without one closing sign after a letter, which is a token of its own, and the id of that sign or -1."""
        words, signs = words.copy(), np.full(len(words), -1, np.int64)
        closed, ids = [], []
        for i in [i for i, w in enumerate(words) if w[-1:] in self.signs]:
            word = words[i]
            if len(word) > 1 and _letter(word[-2]):
                words[i] = word[:-1]
                closed.append(i)
                ids.append(self.signs[word[-1]])
        signs[closed] = ids
        return words, signs

    def _add(self, words: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        first = len(self.lens)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
        self.lens, self.flat = np.concatenate((self.lens, lens)), np.concatenate((self.flat, flat))
        self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int64)))
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.held_bytes += sum(map(len, words))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and the number of each."""
        ways = np.fromiter((2 if MARK in w else 0 if self.straight and w.isascii() and w.isalpha() else 1 for w in words),
                           np.int64, len(words))
        order = np.argsort(ways, kind="stable")
        sorted_words = [words[i] for i in order.tolist()]
        straight, unmarked = np.searchsorted(ways[order], (1, 2)).tolist()
        own = [np.array(e.ids, self.kind) for e in
               self.tokenizer.encode_batch_fast(sorted_words[unmarked:], add_special_tokens=False)]
        parts = [self._encode_runs(self.model, sorted_words[:straight]),
                 self._encode_runs(self.tokenizer, sorted_words[straight:unmarked]),
                 (np.concatenate([np.zeros(0, self.kind), *own]), np.array([len(o) for o in own], np.int64))]
        flat, lens = (np.concatenate(p) for p in zip(*parts, strict=True))
        # Spans of all ways in the order of the words.
        back = np.argsort(order)
        starts = (np.cumsum(lens) - lens)[back]
        lens = lens[back]
        return flat[_spans(starts, lens)], lens

    def _encode_runs(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words go to the tokenizer many at a time, with a digit between them that none of them has; digits always
        are tokens of their own."""
        runs = [f" {MARK} ".join(words[low:low + TOGETHER]) + f" {MARK}" for low in range(0, len(words), TOGETHER)]
        ids = [np.array(e.ids, self.kind) for e in tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, self.kind), *ids])
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not keep digits apart")
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Per piece: id, start (the document's ids before it), length, ids (little-endian 32-bit),
    doc_tokens, sequence_id, offset. ``end_id`` follows each document. The tokenizer file must be
    on every worker."""
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker(f"words {tokenizer_path}", lambda: WordEncoder(tokenizer_path), alone=True)
        # Ids wait as narrow as they can.
        kept = encoder.kind if end_id < 1 << 16 else np.uint32
        sequence = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []
        held = 0

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            columns[3] = [ids.astype("<u4").tobytes() for ids in columns[3]]
            kinds = [rows_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, waiting, held
            which, offset, used = best_fit_decreasing(np.array([p[2] for p in waiting], np.int64), window)
            placed = [(*p, sequence + w, o) for p, w, o in zip(waiting, which.tolist(), offset.tolist(), strict=True)]
            waiting, held, sequence = [], 0, sequence + used
            for low in range(0, len(placed), 2000):
                yield batch(placed[low:low + 2000])

        rows_type = None
        for received in batches:
            return_memory()
            rows_type = received.schema.field(0).type
            for low in range(0, received.num_rows, 512):
                part = received.slice(low, 512)
                ids, counts = encoder.encode(pc.fill_null(part.column(1).cast(pa.string()), ""))
                full, at = [], 0
                for doc, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[at:at + n], kept(end_id))
                    at, total = at + n, n + 1
                    for start in range(0, total - total % window, window):
                        full.append((doc, start, window, own[start:start + window], total, sequence, 0))
                        sequence += 1
                    if rest := total % window:
                        waiting.append((doc, total - rest, rest, own[total - rest:].copy(), total))
                        held += rest
                if full:
                    yield batch(full)
                if held >= block_tokens:
                    yield from settle()
        if waiting:
            yield from settle()

    out = rows.mapInArrow(run, (
        f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    ))
    return out.withColumnRenamed("id", id_col)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    columns = [F.crc32("ids").alias("ids_crc32") if c == "ids" else F.col(c) for c in pieces.columns]
    return pieces.select(*columns)
