"""Byte-level BPE encoding and decoding by a public rank file.

Texts up to ``CHUNK`` characters are split by the pattern and encoded where they lie. Longer texts are cut into
chunks that overlap; all chunks are split in parallel, each from its own start. The pattern looks ahead
only, so once two neighbours begin a piece at the same place they agree from there on: that place is the
seam. Pieces between seams, already encoded, are joined in order. Where no common beginning lies in the
overlap (a run longer than it) the two chunks are split again as one. Decoding joins the tokens' bytes.

Null text is empty: no tokens. Long rows that agree in identifier and text are encoded once and returned as
often as they came. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import map_text, text_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Pieces whose tokens a worker remembers.
REMEMBER = 150_000
_SPLIT = regex.compile(public_tokenizers.PATTERN)


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Tokens of pieces; the merges are the library's, the latest pieces are remembered."""

    def __init__(self, path: str):
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
        self.known: dict[str, list[int]] = {}

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        found = list(map(self.known.get, pieces))
        for i in [i for i, t in enumerate(found) if t is None]:
            piece = pieces[i]
            found[i] = self.library._core_bpe.encode_single_piece(piece.encode())
            if len(piece) < 64:
                self.known[piece] = found[i]
        if len(self.known) > REMEMBER:
            self.known.clear()
        return found

    def text(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.pieces(_SPLIT.findall(text))))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def split_chunk(text: str, last: bool) -> list[str]:
    """The pieces of a chunk that what follows it cannot change; all of them in a text's last chunk."""
    pieces = _SPLIT.findall(text)
    if not last:
        end = len(text)
        while pieces:
            start = end - len(pieces[-1])
            if end < len(text) and start + 3 <= len(text):
                break
            end = start
            pieces.pop()
    return pieces


def stitch(chunks: list[dict], path: str) -> list[int]:
    """Tokens of a text from its chunks in order: {start, text, last, ends, sizes, ids} each."""
    out: list[np.ndarray] = []
    now, true = chunks[0], 0  # true: the place up to which all is joined, where a piece begins
    at = 1
    while at < len(chunks):
        begins, others = now["start"] + np.r_[0, now["ends"]], chunks[at]["start"] + np.r_[0, chunks[at]["ends"]]
        common = np.intersect1d(begins[begins >= true], others)
        if len(common):
            out.append(_between(now, true, common[0]))
            now, true = chunks[at], int(common[0])
            at += 1
            continue
        # one run covers the overlap: split on as one text, from the last place that is certain. The text at
        # least doubles each time, so a run of many chunks is split few times
        texts, end = [now["text"][true - now["start"] :]], now["start"] + len(now["text"])
        aim = end + (end - true)
        while at < len(chunks) and (end < aim or len(texts) < 2):
            texts.append(chunks[at]["text"][end - chunks[at]["start"] :])
            end, at = chunks[at]["start"] + len(chunks[at]["text"]), at + 1
        now = split_and_encode(true, "".join(texts), chunks[at - 1]["last"], path)
    out.append(_between(now, true, None))
    return np.concatenate(out).tolist()


def _between(chunk: dict, begin: int, end: int | None) -> np.ndarray:
    begins = chunk["start"] + np.r_[0, chunk["ends"]]
    tokens = np.r_[0, np.cumsum(chunk["sizes"])]
    a = np.searchsorted(begins, begin)
    b = len(begins) - 1 if end is None else np.searchsorted(begins, end)
    return np.asarray(chunk["ids"], np.int32)[tokens[a] : tokens[b]]


def split_and_encode(start: int, text: str, last: bool, path: str) -> dict:
    pieces = split_chunk(text, last)
    tokens = encoder(path).pieces(pieces)
    return {
        "start": start, "text": text, "last": last,
        "ends": np.cumsum([len(p) for p in pieces], dtype=np.int64) if pieces else np.zeros(0, np.int64),
        "sizes": np.array([len(t) for t in tokens], np.int32),
        "ids": np.fromiter(chain.from_iterable(tokens), np.int32),
    }


def ids_only(tokens: list[list[int]]) -> dict:
    return {"ids": tokens}


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP,
    told: Callable[[list[list[int]]], dict] = ids_only, schema: str = "ids array<int>",
) -> DataFrame:
    """doc_id and the columns that ``told`` makes of each text's tokens, one row for every row of ``docs``."""
    docs = text_of(docs, id_col, text_col)
    short = map_text(
        docs.where(F.char_length("text") <= chunk),
        lambda ids, texts: {"doc_id": ids} | told([encoder(path).text(t) for t in texts]),
        f"doc_id long, {schema}",
        chars=500_000,
    )
    return short.union(_encode_long(docs.where(F.char_length("text") > chunk), path, chunk, overlap, told, schema))


def _encode_long(docs: DataFrame, path: str, chunk: int, overlap: int, told: Callable, schema: str) -> DataFrame:
    once = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    key = F.sha2(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256).alias("key")
    cut = "key string, doc_id long, copies long, start long, last boolean, text string"

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                for start in range(0, len(text), chunk):
                    last = start + chunk + overlap >= len(text)
                    own = {"start": start, "last": last, "text": text[start : start + chunk + overlap]}
                    yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("key", "doc_id", "copies")} | own], schema=arrow)
                    if last:
                        break

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(cut))
    encoded = cut + ", ends array<long>, sizes array<int>, ids array<int>"
    arrow_encoded = to_arrow_schema(StructType.fromDDL(encoded))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = split_and_encode(row["start"], row["text"], row["last"], path)
                yield pa.RecordBatch.from_pylist([row | made], schema=arrow_encoded)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        made = told([stitch(rows.to_dict("records"), path)])
        return pd.DataFrame({"doc_id": rows["doc_id"][:1].astype("Int64"), "copies": rows["copies"][:1]} | made)

    spread = once.select(key, "doc_id", "copies", "text").mapInArrow(chunks, cut).repartition("key", "start")
    joined = spread.mapInArrow(work, encoded).groupBy("key").applyInPandas(join, f"doc_id long, copies long, {schema}")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


@lru_cache(maxsize=2)
def token_table(path: str) -> list[bytes]:
    by_rank = ranks(path)
    table = [b""] * (max(by_rank.values()) + 1)
    for token, i in by_rank.items():
        table[i] = token
    return table


@lru_cache(maxsize=2)
def token_names(path: str) -> list[str]:
    return [str(i) for i in range(len(token_table(path)))]


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, ids and the decoded bytes."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [decode_ids(i.as_py(), token_table(path)) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.mapInArrow(work, "doc_id long, ids array<int>, bytes binary")


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str = RANKS, **options) -> DataFrame:
    """Encoded, decoded again, and both told by their digests, in the task that has the tokens."""

    def told(tokens: list[list[int]]) -> dict:
        table, names = token_table(path), token_names(path)
        return {
            "n_tokens": [len(t) for t in tokens],
            "ids_sha256": [hashlib.sha256(" ".join([names[i] for i in t]).encode()).hexdigest() for t in tokens],
            "decoded_sha256": [hashlib.sha256(decode_ids(t, table)).hexdigest() for t in tokens],
        }

    return encode(docs, path=path, told=told, schema=DIGESTS, **options)
