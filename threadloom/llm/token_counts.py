"""Token counts of whole texts by a SentencePiece BPE model.

Short texts are encoded in batches. A huge text is encoded in overlapping chunks with offsets, and
the chunks are spliced where both have a token boundary that is provably stable: before a space
that follows a non-space. If no piece of the vocabulary has a space after a non-space, no merge
ever crosses such a place, so the tokens on either side of it do not depend on each other. Where an
overlap has no such place, it is widened until it has one or the text ends, so a text without
spaces is encoded in one go and the count is exact in any case.

Defined cases: a null text counts as empty and has no token. Repeated rows are counted each; an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import once_per_worker, pick

SPACE = "▁"
CHUNK = 1 << 16
OVERLAP = 1 << 9


class Counter:
    """Counts tokens of one model. ``chunk`` and ``overlap`` are in characters."""

    def __init__(self, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        inner = any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:], strict=False))
        # The proof also needs a normaliser that leaves texts as they are, but for the sign of the space.
        probe = " Aé  ﬁ\tⅨ \n x "
        self.stable = not inner and self.model.normalize(probe) == SPACE + probe.replace(" ", SPACE)

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.spliced(t)
        return out

    def spliced(self, text: str) -> int:
        """Count of a huge text from overlapping chunks."""
        if not self.stable:
            return len(self.model.encode(text))
        total, start, splice = 0, 0, 0
        end = min(len(text), self.chunk + self.overlap)
        begins = self._begins(text, start, end)
        while end < len(text):
            wide, cut = self.overlap, None
            while cut is None:
                low = max(splice, end - wide)
                high = min(len(text), low + self.chunk + 2 * wide)
                ahead = self._begins(text, low, high)
                cut = self._common(text, begins, ahead, low, end)
                if low == splice:
                    break
                wide *= 2
            if cut is None:  # no place to splice since the last one: a chunk twice as long
                end = min(len(text), end + max(self.chunk, end - start))
                begins = self._begins(text, start, end)
                continue
            total += sum(1 for b in begins if splice <= b < cut)
            start, end, begins, splice = low, high, ahead, cut
        return total + sum(1 for b in begins if b >= splice)

    def _begins(self, text: str, start: int, end: int) -> list[int]:
        """Where the tokens of a chunk begin, in the whole text. Bytes of one character share a place."""
        chunk = text[start:end]
        at = np.array([p.begin for p in self.model.encode(chunk, return_type="proto").pieces], np.int64)
        if not chunk.isascii():  # offsets count bytes
            first = np.flatnonzero(np.frombuffer(chunk.encode(), np.uint8) & 0xC0 != 0x80)
            at = np.searchsorted(first, at)
        return (start + at).tolist()

    @staticmethod
    def _common(text: str, left: list[int], right: list[int], low: int, high: int) -> int | None:
        """The last stable boundary that both chunks have in their overlap, not at its edges."""
        both = set(left) & set(right)
        for at in sorted(both, reverse=True):
            if low < at < high and text[at] == " " and text[at - 1] not in (" ", SPACE):
                return at
        return None


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit. The model file must be on every worker."""
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once_per_worker(f"counter {model_path} {chunk} {overlap}", lambda: Counter(model_path, chunk, overlap))
        for batch in batches:
            column = batch.column(1)
            for low in range(0, len(column), 256):  # some texts at a time: ids take many times the text
                texts = [t or "" for t in column.slice(low, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, 256),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counter.counts(texts), pa.int64()),
                ], names=["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
