"""Quality rules: simple counts, and repetition found in a suffix array of each text's words.

The suffix array is built for many documents at once by prefix doubling on word numbers: ranks at depths
1, 2, 4, ... are refined only where suffixes still tie. Neighbours in the array give the longest common
prefixes; every position's longest repeat is the larger of its two, and the spans of all maximal repeats of
at least ``MIN_REPEAT`` words are united. A text fails if too much of it is covered, or if one repeat is
too long. Word numbers differ between documents, so no match crosses them.

Null or empty text has no words: all counts are 0, and it fails the base rule. Very long texts are handled
alone, in memory of about 100 bytes per word. Repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import SPACE_BYTES, map_text, text_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: The method's own limits: repeats of so many words count; a text keeps if at most so many of 100 words lie
#: in them and the longest has at most so many words.
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_LONGEST = 5, 40, 200
_SYMBOLS = b"#*$%&|<>"
COLUMNS = [
    "doc_id long", "n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long",
    "base_failed boolean", "kept boolean", "covered_words long", "longest_repeat long",
]


def rank_levels(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until no two tie.

    Equal ranks at level k mean equal words to depth 2^k; a rank is the place of its group's first member.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = np.flatnonzero(np.r_[True, words[order][1:] != words[order][:-1]]) if n else np.zeros(0, int)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    levels, depth = [rank], 1
    size = np.bincount(rank, minlength=n)
    tied = np.flatnonzero(size[rank] > 1) if n else np.zeros(0, int)
    while len(tied):
        ahead = np.full(len(tied), -1)
        inside = tied + depth < n
        ahead[inside] = rank[tied[inside] + depth]
        key = rank[tied] * (n + 1) + ahead + 1
        by = np.argsort(key, kind="stable")
        at, key = tied[by], key[by]
        old = rank[at]
        new_group = np.r_[True, old[1:] != old[:-1]]
        new_part = np.r_[True, key[1:] != key[:-1]]
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        part = np.maximum.accumulate(np.where(new_part, place, 0))
        rank = rank.copy()
        rank[at] = old + part - start
        levels.append(rank)
        alone = np.diff(np.r_[np.flatnonzero(new_part), len(at)])
        tied = at[np.repeat(alone > 1, alone)]
        depth *= 2
    return levels


def longest_repeats(levels: list[np.ndarray], least: int) -> np.ndarray:
    """Per position the length of the longest repeat that starts there, 0 if it is under ``least``."""
    n = len(levels[0]) if levels else 0
    out = np.zeros(n, np.int64)
    shallow = int(least).bit_length() - 1  # repeats of ``least`` words tie at depth 2^shallow
    if n == 0 or shallow >= len(levels):
        return out
    base = levels[shallow]
    some = np.flatnonzero(np.bincount(base, minlength=n)[base] > 1)
    if not len(some):
        return out
    array = some[np.argsort(levels[-1][some])]
    a, b = array[:-1].copy(), array[1:].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        equal = np.zeros(len(a), bool)
        equal[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = np.where(equal, 1 << k, 0)
        a, b, common = a + step, b + step, common + step
    out[array] = np.maximum(np.r_[0, common], np.r_[common, 0])
    out[out < least] = 0
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def judge(ids: list, texts: list, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> dict:
    raws = [t.encode() for t in texts]
    numbers, counts, chars, symbols, dup_lines = [], [], [], [], []
    known = 0
    for text, raw in zip(texts, raws, strict=True):
        words = raw.split()  # bytes split at exactly the contract's white space
        number: dict[bytes, int] = {}
        numbers.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + known)
        known += len(number)
        counts.append(len(words))
        chars.append(len(text) - len(raw) + len(raw.translate(None, SPACE_BYTES)))
        symbols.append(len(raw) - len(raw.translate(None, _SYMBOLS)))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    doc = np.repeat(np.arange(len(texts)), counts)
    n, total = np.array(counts, np.int64), int(sum(counts))
    levels = rank_levels(np.concatenate(numbers) if numbers else np.zeros(0, np.int64))

    def per_doc(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flag], minlength=len(texts)).astype(np.int64)

    window = np.zeros(0, int)
    if len(levels) > 3:  # ranks at depth 8
        window = np.flatnonzero(np.bincount(levels[3], minlength=total)[levels[3]] > 1)
    repeated = per_doc(covered(window, np.full(len(window), WINDOW), total))
    repeat = longest_repeats(levels, min_repeat)
    at = np.flatnonzero(repeat)
    inside = per_doc(covered(at, repeat[at], total))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc[at], repeat[at])
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    kept = ~failed & (100 * inside <= max_covered * n) & (longest <= max_longest)
    made = [ids, n, chars, symbols, dup_lines, repeated, failed, kept, inside, longest]
    return {c.split()[0]: v for c, v in zip(COLUMNS, made, strict=True)}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict for every row."""
    return map_text(text_of(docs, id_col, text_col), judge, ", ".join(COLUMNS))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, all columns as they are: a text is judged where it lies."""
    import pyarrow as pa

    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep: list[bool] = []
            texts = batch.column(at)
            step = max(1, 2_000_000 // max(1, texts.nbytes // max(1, len(texts))))
            for k in range(0, len(texts), step):
                part = ["" if t is None else t for t in texts.slice(k, step).to_pylist()]
                keep += judge([0] * len(part), part)["kept"].tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    return quality(docs).select(*[F.col(c.split()[0]) for c in COLUMNS])
