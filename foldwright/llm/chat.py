"""Chat formatting with an offset-aligned loss mask.

A conversation's turns are rendered whole and encoded once. The template's marks are tokens of their own, so no token
crosses one. Token spans follow from the tokens' lengths; every assistant text's span meets the sorted token
spans by binary search, and the tokens inside are the ones the loss sees.

``<s>role[INST]text[/INST]</s>`` is one turn. Inside roles and texts a mark gets a backslash after its first
character (``<\\/s>``), one more if it has some already, so unescaping is exact and no text can forge a mark.

Rows are ordered by turn, then role, then text (nulls first), so repeated turns are kept in a fixed order. Null role or
text is empty; rows without conv_id are one conversation without identifier. A conversation that is longer
than ``PART`` characters is rendered and encoded in parts that end with a turn: marks part tokens, so the tokens are the
same and no task holds more than a part and a turn. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foldwright.llm.bpe import RANKS, encoder, ranks

MARKS = ("<s>", "[INST]", "[/INST]", "</s>")
PART = 1 << 20
_ESCAPE = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]))")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(?=/?(?:s>|INST\]))")
_MARK = re.compile("(" + "|".join(map(re.escape, MARKS)) + ")")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)
PARTS = "conv_id long, part int, n_turns int, formatted string, ids array<int>, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns and the assistants' spans in it, in bytes."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"<s>{escape(role)}[INST]", escape(text), "[/INST]</s>"
        begin = at + len(head.encode())
        at = begin + len(body.encode())
        if role == "assistant":
            spans.append((begin, at))
        at += len(tail)
        parts += [head, body, tail]
    return "".join(parts), spans


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple[dict[str, int], np.ndarray]:
    """The marks' tokens, which follow the public ranks, and every token's length in bytes."""
    by_rank = ranks(path)
    first = max(by_rank.values()) + 1
    marks = {m: first + i for i, m in enumerate(MARKS)}
    sizes = np.zeros(first + len(marks), np.int64)
    for token, i in by_rank.items():
        sizes[i] = len(token)
    for mark, i in marks.items():
        sizes[i] = len(mark)
    return marks, sizes


def loss_mask(ids: np.ndarray, spans: list[tuple[int, int]], sizes: np.ndarray) -> np.ndarray:
    """Which tokens meet a span: both are sorted, so each span finds its first and last token by bisection."""
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    mask = np.zeros(len(ids), bool)
    if spans:
        span = np.array(spans)
        first, last = np.searchsorted(ends, span[:, 0], "right"), np.searchsorted(starts, span[:, 1], "left")
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            mask[a:b] = True
    return mask


def masked_spans(ids: np.ndarray, mask: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of masked tokens as byte spans."""
    ends = np.cumsum(sizes[ids])
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [(int(ends[a - 1]) if a else 0, int(ends[b - 1])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def format_conversations(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """Parts of conversations in order: the formatted text, its tokens, and the spans under the loss in bytes."""
    rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    schema = to_arrow_schema(StructType.fromDDL(PARTS))

    def part(conv, number: int, turns: list[tuple[str, str]]) -> tuple:
        mark_ids, sizes = tokenizer(path)
        text, spans = render(turns)
        # marks part the text; what lies between is split by our own matcher, which no run of white space overflows
        ids = np.fromiter(chain.from_iterable([mark_ids[s]] if s in mark_ids else encoder(path).text(s) for s in _MARK.split(text) if s), np.int64)
        loss = masked_spans(ids, loss_mask(ids, spans, sizes), sizes)
        return conv, number, len(turns), text, ids.astype(np.int32), [{"start": a, "end": b} for a, b in loss]

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        conv, number, n_turns, text, ids, loss = zip(*parts, strict=True)
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(ends, np.concatenate(ids), type=schema.field("ids").type)
        return pa.RecordBatch.from_pydict({"conv_id": conv, "part": number, "n_turns": n_turns, "formatted": text, "ids": ids, "loss": loss}, schema=schema)

    def parts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        now, number, turns, held = None, 0, [], 0
        for batch in batches:
            convs, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for conv, role, text in zip(convs, roles, texts, strict=True):
                if turns and (conv != now or held > PART):
                    yield part(now, number, turns)
                    number, turns, held = (number + 1 if conv == now else 0), [], 0
                now = conv
                turns.append((role or "", text or ""))
                held += len(text or "")
        if turns:
            yield part(now, number, turns)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for made in parts_of(batches):
            held.append(made)
            size += len(made[3])
            if size > PART:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    # sorted runs of rows, not groups: a task reads turn by turn
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(work, PARTS)


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation what the formatted text gives back when it is parsed and unescaped."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def told() -> dict:
            return now | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        for batch in batches:
            # the tokens are not needed here: the loss spans were read off them
            for row in batch.drop_columns(["ids"]).to_pylist():
                if row["part"] == 0:
                    if now:
                        done.append(told())
                    now = {"conv_id": row["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                text = row["formatted"]
                for role, said in _TURN.findall(text):
                    now["n_turns"] += 1
                    turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                raw = text.encode()
                for span in row["loss"]:
                    said = unescape(raw[span["start"] : span["end"]].decode())
                    now["loss_chars"] += len(said)
                    loss.update(said.encode())
                now["formatted_chars"] += len(text)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
        if now:
            yield pa.RecordBatch.from_pylist([told()], schema=schema)

    schema = to_arrow_schema(StructType.fromDDL(out))
    return format_conversations(rows).mapInArrow(work, out)


#: A conversation whose texts hold marks of this and other templates.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.union(spark.createDataFrame(PROBE, rows.schema))
