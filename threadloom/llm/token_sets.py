"""Word shingles of many records, and the ones that several records share.

The similarity joins start from here. Each record (a text, or a line of one) becomes a set of 48-bit
tokens: hashes of its five-word shingles, or of all its words if it has fewer. ``shared_tokens``
finds out how many records have each token and gives every record its shared tokens, rarest
first. A token that no other record has cannot take part in any overlap, so sizes and shared
tokens are all that a join needs, and most records turn out to have no possible partner at all.

How it runs: a task hashes its texts and counts tokens among its own records, so that a token
which is in a third of all records still costs each task one entry. Entries travel to buckets of the
token space as packed arrays, are summed there, and what is shared travels back to where it came
from. Which records of the task have a token that it counted never leaves with the counts.

``block_bytes`` of text are counted together, ``bucket_bytes`` of text make a bucket. Both bound the
memory of a task. A hundred terabytes want larger blocks (256 MB) and buckets, so that the arrays
that travel from a block to a bucket stay worth packing.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import forget_kept, pick, stage

WORDS = 5
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
# Two sets of a thousand tokens share one by chance once in 10^8 comparisons; a chance hit elsewhere only
# makes a candidate that verification drops. Fewer bits pack better.
TOKEN_BITS = 48

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.uint64(0xBF58476D1CE4E5B9)
_SECOND = np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Threshold:
    """A least Jaccard similarity as an exact fraction."""

    part: int = 4
    whole: int = 5

    def least(self, size):
        """The overlap that a set of this size has at least with any similar set."""
        return (size * self.part + self.whole - 1) // self.whole

    def prefix(self, size):
        """How many of its rarest tokens a set must be looked up by."""
        return size - self.least(size) + 1

    def similar(self, overlap, one, other):
        return overlap * self.whole >= self.part * (one + other - overlap)


def mix(x: np.ndarray, factor: np.uint64 = _FIRST) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * factor
    x = (x ^ (x >> np.uint64(27))) * _ODD
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased, split at ASCII white space), and how many each has."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = words.flatten()
    bounds = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
    lens = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    full = np.concatenate(([0], np.cumsum(lens > 0)))
    counts = full[bounds[1:]] - full[bounds[:-1]]
    lens = lens[lens > 0]
    if not len(lens):
        return np.zeros(0, np.uint64), counts
    flat = flat.cast(pa.large_string())
    edges = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8)[edges[0]:edges[-1]]
    starts = np.cumsum(lens) - lens
    place = np.arange(len(data)) - np.repeat(starts, lens)
    powers = np.ones(int(lens.max()) + 1, np.uint64)
    powers[1:] = _SECOND
    powers = np.cumprod(powers)
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], starts)
    return mix(sums + lens.astype(np.uint64) * _ODD), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Tokens one after another and the record of each; a record may have a token several times."""
    record = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts

    def chain(at: np.ndarray, n: int) -> np.ndarray:
        token = np.full(len(at), n, np.uint64)
        for i in range(n):
            token = mix(token * _ODD + hashes[at + i])
        return token

    left = np.repeat(starts + counts, counts) - np.arange(len(hashes))
    at = np.flatnonzero(left >= words)
    tokens, owners = [chain(at, words)], [record[at]]
    for n in range(1, words):
        own = np.flatnonzero(counts == n)
        tokens.append(chain(starts[own], n))
        owners.append(own)
    return np.concatenate(tokens) >> np.uint64(64 - TOKEN_BITS), np.concatenate(owners)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: sorted and small numbers then compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not data:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _to_bytes(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def _from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


PACKED = "bucket bigint, origin bigint, records binary, tokens binary, who binary, total binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
        names=["bucket", "origin", "records", "tokens", "who", "total"])


class Block:
    """Records of one task counted together."""

    def __init__(self, by_line: bool, buckets: int):
        self.by_line, self.buckets = by_line, buckets
        self.keys, self.sizes = [], []
        self.tokens, self.owners = [], []
        self.records = self.bytes = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        if self.by_line:
            lines = pc.split_pattern(texts, "\n")
            counts = np.diff(lines.offsets.to_numpy())
            first = np.repeat(np.cumsum(counts) - counts, counts)
            ids, texts = ids.take(pa.array(np.repeat(np.arange(len(counts)), counts))), lines.flatten()
            number = np.arange(len(texts)) - first
        else:
            number = np.zeros(len(texts), np.int64)
        tokens, owners = shingles(*word_hashes(texts))
        self.keys.append(pa.table([ids, pa.array(number, pa.int64())], names=["id", "line"]))
        self.tokens.append(tokens)
        self.owners.append((owners + self.records).astype(np.int32))
        self.records += len(texts)

    def rows(self, origin: int) -> Iterator[tuple]:
        tokens, owners = np.concatenate(self.tokens), np.concatenate(self.owners)
        self.tokens = self.owners = None
        # Stable sorting leaves a record's equal tokens side by side: records were added in order, but
        # for those of less than five words, which have one token.
        order = np.argsort(tokens, kind="stable")
        held = np.ones(len(order), bool)
        same = (tokens[order[1:]] == tokens[order[:-1]]) & (owners[order[1:]] == owners[order[:-1]])
        held[1:] = ~same
        order = order[held]
        tokens, owners = tokens[order], owners[order]
        sizes = np.bincount(owners, minlength=self.records).astype(np.int64)
        # A record's class is its set: two sums over hashes of its tokens.
        by_owner = np.argsort(owners, kind="stable")
        filled = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[filled]
        classes, checks = np.zeros(self.records, np.uint64), np.zeros(self.records, np.uint64)
        if len(filled):
            grouped = tokens[by_owner]
            classes[filled] = np.add.reduceat(mix(grouped, _SECOND), starts)
            checks[filled] = np.add.reduceat(mix(grouped + _ODD), starts)
        unique, first = np.unique(classes[filled], return_index=True)
        leads = np.zeros(self.records, bool)
        leads[filled[first]] = True
        kept = leads[owners]
        tokens, owners = tokens[kept], owners[kept]
        # Runs of equal tokens: one record's, or several records' which stay behind under the count.
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1])))
        count = np.diff(begin, append=len(tokens))
        several = count > 1
        who = np.where(several, -count, owners[begin]).astype(np.int32)
        stay = np.repeat(several, count)
        records = pa.concat_tables(self.keys).append_column("size", pa.array(sizes)).append_column(
            "class", pa.array(classes.view(np.int64))).append_column("check", pa.array(checks.view(np.int64))
        ).append_column("leads", pa.array(leads))
        yield (-1 - origin, origin, _to_bytes(records), None, _planes(owners[stay]), _planes(count[several].astype(np.int32)))
        tokens = tokens[begin]
        edges = [(b << TOKEN_BITS) // self.buckets for b in range(1, self.buckets)]
        cuts = [0, *np.searchsorted(tokens, np.array(edges, np.uint64)).tolist(), len(tokens)]
        for b, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if low < high:
                yield (b, origin, None, _planes(tokens[low:high]), _planes(who[low:high]), None)


def _sum_bucket(group: pa.Table) -> pa.Table:
    """Sums the counts of a bucket's tokens and sends the shared ones back to each origin."""
    if group.column("bucket")[0].as_py() < 0:
        return group
    origins = group.column("origin").to_pylist()
    tokens = [_from_planes(t, np.uint64) for t in group.column("tokens").to_pylist()]
    who = [_from_planes(w, np.int32) for w in group.column("who").to_pylist()]
    sizes = [len(t) for t in tokens]
    tokens, who = np.concatenate(tokens), np.concatenate(who)
    order = np.argsort(tokens, kind="stable")
    tokens, who, origin = tokens[order], who[order], np.repeat(np.arange(len(origins)), sizes)[order]
    begin = np.flatnonzero(np.concatenate((np.ones(1, bool), tokens[1:] != tokens[:-1])))
    total = np.add.reduceat(np.where(who < 0, -who, 1).astype(np.int64), begin)
    total = np.repeat(total, np.diff(begin, append=len(tokens)))
    shared = total > 1
    tokens, who, origin, total = tokens[shared], who[shared], origin[shared], total[shared]
    by_origin = np.argsort(origin, kind="stable")
    tokens, who, origin, total = tokens[by_origin], who[by_origin], origin[by_origin], total[by_origin]
    cuts = np.searchsorted(origin, np.arange(len(origins) + 1))
    bucket = group.column("bucket")[0].as_py()
    rows = [
        (bucket, origins[i], None, _planes(tokens[low:high]), _planes(who[low:high]), _planes(total[low:high]))
        for i, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if low < high
    ]
    return pa.Table.from_batches([_packed(rows)])


def shared_tokens(
    docs: DataFrame, threshold: Threshold, by_line: bool = False, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """A staged table with a row per record: id, line (0 for whole texts), n (size of its token set),
    class and check (equal sets have equal ones), q (how many of its shared tokens belong to its prefix),
    tokens (its shared tokens by rarity; null if it has no possible partner, or if a record of the
    same class in the same block carries them). Records with q > 0 and tokens are candidates."""
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        block, origin = Block(by_line, buckets), TaskContext.get().partitionId() << 24
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < len(texts):
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
                block.add(batch.column(0).slice(low, high - low), texts.slice(low, high - low))
                block.bytes += int(ends[high - 1]) - before
                low = high
                if block.bytes >= block_bytes:
                    for row in block.rows(origin):
                        yield _packed([row])
                    block, origin = Block(by_line, buckets), origin + 1
        if block.records:
            for row in block.rows(origin):
                yield _packed([row])

    def settle(group: pa.Table) -> pa.Table:
        mine = [r for r in group.to_pylist()]
        own = next(r for r in mine if r["bucket"] < 0)
        records = _from_bytes(own["records"])
        sizes = records.column("size").to_numpy()
        back = sorted((r for r in mine if r["bucket"] >= 0), key=lambda r: r["bucket"])
        tokens = np.concatenate([np.zeros(0, np.uint64), *(_from_planes(r["tokens"], np.uint64) for r in back)])
        who = np.concatenate([np.zeros(0, np.int32), *(_from_planes(r["who"], np.int32) for r in back)])
        total = np.concatenate([np.zeros(0, np.int64), *(_from_planes(r["total"], np.int64) for r in back)])
        # Tokens come back in order, so counted ones meet the records that stayed behind.
        several, count = who < 0, _from_planes(own["total"], np.int32)
        owners = np.concatenate((who[~several], _from_planes(own["who"], np.int32)))
        total = np.concatenate((total[~several], np.repeat(total[several], count)))
        tokens = np.concatenate((tokens[~several], np.repeat(tokens[several], count)))
        held = np.bincount(owners, minlength=len(sizes))
        q = np.clip(threshold.prefix(sizes) - (sizes - held), 0, held)
        wanted = q[owners] > 0
        owners, total, tokens = owners[wanted], total[wanted], tokens[wanted]
        order = np.lexsort((tokens, total, owners))
        lens = np.where(q > 0, held, 0)
        offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
        lists = pa.ListArray.from_arrays(
            pa.array(offsets, mask=np.concatenate((lens == 0, [False])) if len(lens) else None),
            pa.array(tokens[order].view(np.int64)))
        return pa.table([
            records.column("id"), records.column("line"), records.column("size"), records.column("class"),
            records.column("check"), pa.array(q.astype(np.int64)), lists,
        ], names=["id", "line", "n", "class", "check", "q", "tokens"])

    counted = rows.mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(_sum_bucket, PACKED)
    out = counted.groupBy("origin").applyInArrow(settle, (
        f"id {kind}, line bigint, n bigint, class bigint, check bigint, q bigint, tokens array<bigint>"))
    return stage(out, "tokens")


def one_per_class(records: DataFrame) -> DataFrame:
    """Candidates, one row a class: class, n, q, tokens. Equal sets have equal tokens in any block."""
    rows = records.where("q > 0 AND tokens IS NOT NULL")
    return rows.groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "q", "tokens")])


def prefix_postings(candidates: DataFrame) -> DataFrame:
    """The inverted index of the prefixes: token, class, n, alone (tokens that nothing else has), place (in
    the record's order by rarity, from 0)."""
    return candidates.select("class", "n", (F.col("n") - F.size("tokens")).alias("alone"), F.posexplode(
        F.slice("tokens", F.lit(1), F.col("q").cast("int"))).alias("at", "token")).select(
        "token", "class", "n", "alone", (F.col("alone") + F.col("at")).alias("place"))


def overlap(one: np.ndarray, short: int, other: np.ndarray, needed: int) -> int:
    """The overlap of two token sets, or something below ``needed`` once that is out of reach.

    The first ``short`` tokens of ``one`` have the short inverted lists, which are merged; the others'
    long lists are probed by binary search, a part at a time."""
    other = np.sort(other)

    def probe(tokens: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(other, tokens), len(other) - 1)
        return int((other[at] == tokens).sum())

    found, at = probe(one[:short]), short
    while at < len(one) and found + len(one) - at >= needed:
        step = max(64, (len(one) - at) // 2)
        found += probe(one[at:at + step])
        at += step
    return found


def similar_pairs(pairs: DataFrame, candidates: DataFrame, threshold: Threshold) -> DataFrame:
    """Of pairs (one, other) of classes those whose sets are similar."""
    for side in ("one", "other"):
        pairs = pairs.join(candidates.select(
            F.col("class").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "q", "tokens")]), side)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            a, b, q = (get[c].to_numpy() for c in ("one_n", "other_n", "one_q"))
            part, whole = threshold.part, threshold.whole
            needed = -(-part * (a + b) // (part + whole))
            flat = [get[f"{s}_tokens"].flatten().to_numpy() for s in ("one", "other")]
            cut = [get[f"{s}_tokens"].offsets.to_numpy() - get[f"{s}_tokens"].offsets[0].as_py() for s in ("one", "other")]
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                found = overlap(flat[0][cut[0][i]:cut[0][i + 1]], int(q[i]), flat[1][cut[1][i]:cut[1][i + 1]], int(needed[i]))
                good[i] = threshold.similar(found, int(a[i]), int(b[i]))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([get["one"].filter(keep), get["other"].filter(keep)], names=["one", "other"])

    return pairs.mapInArrow(verify, "one bigint, other bigint")
