"""Removal of long byte strings that occur elsewhere, by blockwise suffix sorting.

A *suffix* here is a place with ``LENGTH`` more bytes in its text; two suffixes tie if those bytes agree, and every byte
of a tied suffix goes. Suffixes are dealt into buckets by an anchor that follows from their bytes alone: the
smallest hash among the k-mers of the string. Equal strings have equal anchors, and neighbours mostly share theirs, so
a bucket gets runs of neighbouring suffixes as one piece of text rather than every suffix on its own.

1. Anchors are counted (partial sums first). An anchor at one place only has no ties: its pieces never move. Frequent
   anchors go into a Bloom filter of bounded size; what exceeds it is dealt with in further rounds.
2. Pieces with frequent anchors go to their bucket. An anchor with very many pieces is spread over several
   buckets by a salt of the piece (row, place and which copy of the row), so copies and a passage that one text repeats
   are spread too; its strings' 128-bit fingerprints are then counted across them.
3. A task sorts one bucket at a time, so its memory is bounded by the bucket. Suffixes are ordered by fingerprint;
   neighbours that tie are resolved without reading their whole strings: all places in a difference cover modulo
   ``COVER`` are ranked beforehand (equal ranks at depth 32 and, by doubling, 128 mean equal bytes), any two
   places meet cover places at one common shift below ``COVER``, so a few words, two ranks and the last words decide.
4. Spans are united per text and cut out.

Order inside a bucket is by fingerprint, not alphabetical: only ties matter for removal. Long texts are read in
segments with an overlap, so memory does not grow with a text.

Null text is empty. Texts under ``LENGTH`` bytes lose nothing. Rows that agree in identifier and text are each other's
copies and lose the same. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foldwright.llm.common import text_of
from foldwright.session import materialise, scratch_path

LENGTH, KMER, COVER = 200, 64, 32
#: Bytes of text that a task works on at once, and that a bucket aims at.
SEGMENT, BUCKET_BYTES = 1 << 19, 2 << 20
#: Bits of a Bloom filter round, at 16 bits per anchor.
MAX_FILTER_BITS = 1 << 29
#: Anchors with more places than this, or than this share of all, are spread over buckets.
HOT_PLACES, HOT_SHARE = 4096, 1 / 4_000_000
PIECE = "bucket long, hot boolean, doc_id long, text_key long, at long, piece binary"
FOUND = "doc_id long, text_key long, start long, end long, f1 long, f2 long, n long"
_BASE = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64) | np.uint64(1)
_TABLE = np.random.default_rng(200).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=8)
def _powers(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_BASE[which])
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def rolling(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes."""
    size = 1 << max(10, int(len(data)).bit_length())
    up, down = _powers(size, which)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[which][data] * up[: len(data)], out=total[1:])
    return mixed((total[width:] - total[:-width]) * down[: len(data) - width + 1])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over all runs of ``width`` values, by doubling."""
    now, size = values, 1
    while 2 * size <= width:
        now = pick(now[:-size], now[size:])
        size *= 2
    return pick(now[: len(now) - (width - size)], now[width - size :]) if width > size else now


class Runs:
    """The suffixes of some segments of text, in runs that share an anchor."""

    def __init__(self, segments: list[bytes], length: int, kmer: int):
        self.data = np.frombuffer(b"".join(segments), np.uint8)
        size = np.array([len(s) for s in segments])
        self.begin = np.cumsum(size) - size
        places = len(self.data) - length + 1
        if places <= 0:
            self.anchor = self.first = self.last = np.zeros(0, np.int64)
            self.seen = np.zeros(0, np.uint64)
            return
        edge = np.zeros(places + 1, np.int64)
        has = size >= length
        np.add.at(edge, self.begin[has], 1)
        np.add.at(edge, self.begin[has] + size[has] - length + 1, -1)
        whole = np.cumsum(edge[:-1]) > 0  # the string lies in one segment
        hashes = rolling(self.data, kmer)
        width = length - kmer + 1
        least = sliding(hashes, width, np.minimum)
        low = np.where(whole, least, np.uint64(0))
        # a place is an anchor's if some suffix over it has its hash as the least
        padded = np.r_[np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]
        self.seen = hashes[(sliding(padded, width, np.maximum) == hashes) & (hashes > 0)]
        change = np.r_[True, (low[1:] != low[:-1]) | (whole[1:] != whole[:-1])]
        first = np.flatnonzero(change)
        last = np.r_[first[1:], places]
        keep = whole[first]
        self.first, self.last = first[keep], last[keep]  # suffixes first .. last - 1
        self.anchor = least[self.first]


def segments_of(batch: pa.RecordBatch, length: int, segment: int) -> Iterator[list[tuple]]:
    """Slices of (doc_id, text_key, offset, bytes) with about ``segment`` bytes each."""
    held, size = [], 0
    for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        raw = text.as_buffer().to_pybytes()
        for at in range(0, max(1, len(raw) - length + 1), segment):
            part = raw[at : at + segment + length - 1]
            held.append((doc, key, at, part))
            size += len(part)
            if size >= segment:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchor_counts(docs: DataFrame, length: int, kmer: int, segment: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in segments_of(batch, length, segment):
                anchor, n = np.unique(Runs([h[3] for h in held], length, kmer).seen, return_counts=True)
                yield pa.RecordBatch.from_pydict({"anchor": anchor.view(np.int64), "n": n.astype(np.int64)})

    return docs.mapInArrow(work, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def filter_bits(anchor: np.ndarray, bits: int) -> np.ndarray:
    """Three places in a filter of ``bits`` (a power of two) for each anchor."""
    a = anchor.view(np.uint64)
    h = [mixed(a + np.uint64(k * int(_BASE[1]) % (1 << 64))) & np.uint64(bits - 1) for k in (1, 2, 3)]
    return np.stack(h)


def bloom(frequent: DataFrame, bits: int) -> np.ndarray:
    """A filter of the anchors as 64-bit words, put together from the tasks' words."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = filter_bits(batch.column(0).to_numpy(), bits).ravel()
            mask = np.left_shift(np.uint64(1), at & np.uint64(63))
            yield pa.RecordBatch.from_pydict({"word": (at >> np.uint64(6)).astype(np.int64), "mask": mask.view(np.int64)})

    rows = frequent.select("anchor").mapInArrow(work, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return words


def pieces(docs: DataFrame, sent, rounds: int, now: int, buckets: int, length: int, kmer: int, segment: int) -> DataFrame:
    """Runs of suffixes whose anchor is in the filter, as text for their bucket."""
    schema = to_arrow_schema(StructType.fromDDL(PIECE))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot, salts = sent.value
        bits = 64 * len(words)
        partition, copies = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for held in segments_of(batch, length, segment):
                runs = Runs([h[3] for h in held], length, kmer)
                at = filter_bits(runs.anchor, bits)
                keep = ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)
                keep &= round_of(runs.anchor, rounds) == now
                anchor, first, last = runs.anchor[keep], runs.first[keep], runs.last[keep]
                own = np.searchsorted(runs.begin, first, "right") - 1
                place = np.searchsorted(hot, anchor)
                is_hot = np.zeros(len(anchor), bool) if not len(hot) else hot[np.minimum(place, len(hot) - 1)] == anchor
                key = np.array([h[1] for h in held], np.int64)[own]
                at = np.array([h[2] for h in held], np.int64)[own] + first - runs.begin[own]
                salt = np.zeros(len(anchor), np.uint64)
                if is_hot.any():
                    copy = np.zeros(len(held), np.int64)
                    for i in np.unique(own[is_hot]).tolist():  # rows that agree are told by their number in the task
                        copy[i] = copies[held[i][:3]]
                        copies[held[i][:3]] += 1
                    doc = np.array([h[0] or 0 for h in held], np.int64)[own]
                    salt[is_hot] = (salt_of(partition, doc, key, at, copy[own]) % salts[np.minimum(place, len(hot) - 1)])[is_hot]
                bucket = mixed(anchor + salt * _BASE[0]) % np.uint64(buckets)
                data = runs.data.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": bucket.astype(np.int64), "hot": is_hot, "doc_id": [held[i][0] for i in own.tolist()], "text_key": key,
                        "at": at, "piece": [data[a : b + length - 1] for a, b in zip(first.tolist(), last.tolist(), strict=True)],
                    },
                    schema=schema,
                )

    return docs.mapInArrow(work, PIECE)


def salt_of(partition: int, *columns: np.ndarray) -> np.ndarray:
    """Hashes of rows of numbers; a task that runs again on the same rows, in any order, deals the same pieces alike."""
    h = np.full(len(columns[0]), partition, np.uint64)
    for c in columns:
        h = mixed(h * _BASE[0] + c.view(np.uint64) + _BASE[1])
    return h


def round_of(anchor: np.ndarray, rounds: int) -> np.ndarray:
    return (mixed(anchor + _BASE[0]) % np.uint64(rounds)).astype(np.int64)


@lru_cache(maxsize=2)
def difference_cover(modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """A cover D, taken greedily, and shift[a, b]: the least d with a + d and b + d both in D."""
    cover, missing = [0], set(range(1, modulus))
    while missing:
        gain = [len(missing & {(c - x) % modulus for x in cover} | missing & {(x - c) % modulus for x in cover}) for c in range(modulus)]
        best = int(np.argmax(gain))
        cover.append(best)
        missing -= {(a - b) % modulus for a in cover for b in cover}
    inside = np.zeros(modulus, bool)
    inside[cover] = True
    a, b, d = np.ogrid[:modulus, :modulus, :modulus]
    return inside, (inside[(a + d) % modulus] & inside[(b + d) % modulus]).argmax(2)


class Block:
    """One bucket's text with its words and the ranks of its cover places."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        padded = np.r_[data, np.zeros(2 * LENGTH, np.uint8)].astype(np.uint64)
        self.n, self.words = n, np.zeros(n + 2 * LENGTH - 8, np.uint64)
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | padded[k : len(self.words) + k]
        inside, self.shift = difference_cover(COVER)
        place = np.flatnonzero(inside[np.arange(n) % COVER])
        self.rank32 = np.full(n + 2 * LENGTH, -1, np.int64)
        self.rank32[place] = self._named([self.words[place + k] for k in range(0, 32, 8)])
        rank64, self.rank128 = self.rank32.copy(), self.rank32.copy()
        rank64[place] = self._named([self.rank32[place], self.rank32[place + 32]])
        self.rank128[place] = self._named([rank64[place], rank64[place + 64]])

    @staticmethod
    def _named(columns: list[np.ndarray]) -> np.ndarray:
        """Numbers of the distinct rows: by a hash of the row, confirmed by its columns, else by a full sort."""
        key = columns[0].astype(np.uint64)
        for c in columns[1:]:
            key = mixed(key) + c.astype(np.uint64)
        order = np.argsort(mixed(key))
        for exact in (False, True):
            if exact:
                order = np.lexsort(columns)
            same = np.ones(max(0, len(order) - 1), bool)
            for c in columns:
                same &= c[order[1:]] == c[order[:-1]]
            if exact or not (~same & (key[order[1:]] == key[order[:-1]])).any():
                break
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(np.r_[0, ~same]) if len(order) else 0
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the strings at a and b agree: the first words, a rank at the common shift, the last words."""
        same = np.ones(len(a), bool)
        ranked = length >= COVER + 160
        for k in range(0, COVER if ranked else length - 7, 8):
            same &= self.words[a + k] == self.words[b + k]
        if ranked:
            d = self.shift[a % COVER, b % COVER]
            same &= (self.rank128[a + d] == self.rank128[b + d]) & (self.rank32[a + d + 128] == self.rank32[b + d + 128])
            for k in range(160, length - 7, 8):  # the ranks reach to 160 + d
                same &= self.words[a + k] == self.words[b + k]
        return same & (self.words[a + length - 8] == self.words[b + length - 8])


def sort_bucket(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bucket's suffixes in fingerprint order: places, fingerprints, class numbers, and each class's size."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    count = size - length + 1
    place = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    mark = rolling(data, length)[place]
    order = np.argsort(mark)
    place, mark = place[order], mark[order]
    tie = np.flatnonzero(mark[1:] == mark[:-1])
    block = Block(data)
    same = np.zeros(max(0, len(place) - 1), bool)
    same[tie] = block.equal(place[tie], place[tie + 1], length)
    if not same[tie].all():  # equal fingerprints of different strings: order them by their bytes
        raw = data.tobytes()
        strings = np.array([raw[p : p + length] for p in place.tolist()], object)
        order = np.lexsort((np.unique(strings, return_inverse=True)[1], mark))
        place, mark, strings = place[order], mark[order], strings[order]
        same = strings[1:] == strings[:-1]
    number = np.cumsum(np.r_[0, ~same]) if len(place) else np.zeros(0, np.int64)
    return place, mark, number, np.bincount(number)[number] if len(place) else number


def repeated_in_bucket(length: int):
    """Spans of tied suffixes; of hot pieces also one fingerprint per class, to be counted across buckets."""
    schema = to_arrow_schema(StructType.fromDDL(FOUND))

    def work(table: pa.Table) -> pa.Table:
        texts = [t.as_py() for t in table["piece"]]
        begin = np.cumsum([0] + [len(t) for t in texts[:-1]])
        docs, keys, at = table["doc_id"].to_pylist(), table["text_key"].to_numpy(), table["at"].to_numpy()
        place, mark, number, times = sort_bucket(texts, length)
        tied = np.zeros(sum(map(len, texts)) + 1, np.int8)
        tied[place[times > 1]] = 1
        edge = np.flatnonzero(np.diff(np.r_[0, tied]))
        a, b = edge[::2], edge[1::2]
        own = np.searchsorted(begin, a, "right") - 1
        zero = np.zeros(len(a), np.int64)
        out = {
            "doc_id": [docs[i] for i in own.tolist()], "text_key": keys[own], "start": at[own] + a - begin[own],
            "end": at[own] + b - begin[own] + length - 1, "f1": zero, "f2": zero, "n": zero,
        }
        made = [pa.Table.from_pydict(out, schema=schema)]
        hot = table["hot"].to_numpy(zero_copy_only=False)
        if hot.any():
            some = np.flatnonzero(hot[np.searchsorted(begin, place, "right") - 1] & np.r_[True, number[1:] != number[:-1]])
            data = np.frombuffer(b"".join(texts), np.uint8)
            second = rolling(data, length, 1)[place[some]]
            own = np.searchsorted(begin, place[some], "right") - 1
            start = at[own] + place[some] - begin[own]
            out = {
                "doc_id": [docs[i] for i in own.tolist()], "text_key": keys[own], "start": start, "end": start + length,
                "f1": mark[some].view(np.int64), "f2": second.view(np.int64), "n": times[some].astype(np.int64),
            }
            made.append(pa.Table.from_pydict(out, schema=schema))
        return pa.concat_tables(made)

    return work


def repeated_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, segment: int = SEGMENT, bucket_bytes: int = BUCKET_BYTES, filter_max: int = MAX_FILTER_BITS, hot_places: int = HOT_PLACES) -> DataFrame:
    """doc_id, text_key and spans (united, in order) of ``docs`` (doc_id, text_key, text); rows without spans are left out."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "suffix-dedup")
    frequent = materialise(anchor_counts(docs, length, kmer, segment).where("n > 1"), "anchors")
    many, total = frequent.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rounds = max(1, -(-16 * many // filter_max))
    bits = min(filter_max, 1 << max(10, int(16 * many).bit_length()))
    buckets = max(1, total * (2 * length) // bucket_bytes // rounds)
    level = max(hot_places, int(total * HOT_SHARE))
    # at most 1 / HOT_SHARE anchors can lie above the level
    hot = frequent.where(F.col("n") > level).orderBy("anchor").toArrow()
    hot_anchor = hot["anchor"].to_numpy().view(np.uint64)
    by = np.argsort(hot_anchor)
    hot_anchor, salts = hot_anchor[by], (hot["n"].to_numpy()[by] // level + 1).astype(np.uint64)
    for now in range(rounds):
        own = frequent
        if rounds > 1:
            own = frequent.mapInArrow(lambda batches, now=now: (b.filter(pa.array(round_of(b.column(0).to_numpy().view(np.uint64), rounds) == now)) for b in batches), frequent.schema)
        sent = spark.sparkContext.broadcast((bloom(own, bits), hot_anchor, salts))
        cut = pieces(docs, sent, rounds, now, buckets, length, kmer, segment)
        cut.groupBy("bucket").applyInArrow(repeated_in_bucket(length), FOUND).write.parquet(f"{folder}/found/{now}")
    found = spark.read.schema(FOUND).parquet(f"{folder}/found/*")
    spans = found.where("n = 0").select("doc_id", "text_key", "start", "end")
    if len(hot_anchor):
        marks = found.where("n > 0")
        twice = marks.groupBy("f1", "f2").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
        spans = spans.union(marks.where("n = 1").join(twice, ["f1", "f2"]).select("doc_id", "text_key", "start", "end"))
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def united(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_bytes, the removed spans in bytes, and the remaining bytes."""
    docs = text_of(docs, id_col, text_col)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = repeated_spans(docs, **options).toDF("_doc", "_key", "spans")
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_doc"]) & (docs["text_key"] == found["_key"]), "left")
    out = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    schema = to_arrow_schema(StructType.fromDDL(out))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                gone = united(spans.as_py()) if spans.is_valid else []
                sizes.append(len(raw))
                removed.append([{"start": a, "end": b} for a, b in gone])
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": sizes, "removed": removed, "kept": kept}, schema=schema)

    return joined.select("doc_id", "text", "spans").mapInArrow(cut, out)


def digests(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
