"""Language identification by unigram pieces, summed over all segmentations.

A word is a run of letters, in lower case, with the vocabulary's word mark before it. Under a language a word's
probability is the sum, over all ways to cut it into pieces of the fixed public vocabulary, of the product of
the pieces' probabilities: one forward pass per word. Letters outside the vocabulary are spelled in its byte
pieces. Words are independent, so a text's score is the sum of its words' log scores, and every distinct
word is computed once.

Piece probabilities are learned per language by expectation-maximisation (forward and backward sums), from
about ``SAMPLE_DOCS`` labelled documents per language chosen by a hash of their identifier (of the text, if that is null);
runs of more than ``RUN`` letters are learned from in pieces. Prediction sees the text alone. ``score`` is the posterior of the predicted language under equal priors.

Null text or text without letters gives ``und`` with score 0, and so does a model without languages. Rows
without a label train nothing. Ties go to the first language in code point order. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import drawn, empty_if_null, map_text, row_key
from foldwright.session import materialise

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SAMPLE_DOCS, ROUNDS = 1_000, 2
#: Words whose scores a worker remembers.
REMEMBER = 600_000
#: Letters of a run that are learned from as one.
RUN = 16
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_MARK = "▁"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], int, int]:
    """Numbers of the pieces without inner word marks, and 0 for every other beginning of one; the longest; the
    count of numbers. Bytes are under their names."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))}
    own = {p: i for p, i in pieces.items() if _MARK not in p[1:]}
    plain = [p for p in own if not p.startswith("<0x")]
    return {p[:k]: 0 for p in plain for k in range(1, len(p))} | own, max(map(len, plain)), model.get_piece_size()


def spelled(word: str, pieces: dict[str, int]) -> str | list[str]:
    """The word with its mark; a letter that is no piece is spelled in byte pieces."""
    word = _MARK + word
    if all(map(pieces.get, word)):
        return word
    return [p for c in word for p in ([c] if pieces.get(c) else [f"<0x{b:02X}>" for b in c.encode()])]


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def parts(word: str) -> list[str]:
    """A run as pieces of at most ``RUN`` letters, for learning: some scripts put no spaces between words."""
    return [word[k : k + RUN] for k in range(0, len(word), RUN)]


def lattice(batch: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers [word, end, length] (0 where there is none) and the words' lengths in places.

    A letter that is no piece takes one place per byte, spelled in byte pieces.
    """
    pieces, longest, _ = vocabulary(path)
    cells: list[int] = []
    lengths = []
    get = pieces.get
    for n, word in enumerate(batch):
        places = spelled(word, pieces)
        join = "".join if isinstance(places, list) else str
        size = len(places)
        lengths.append(size)
        for start in range(size):
            for end in range(start + 1, size + 1):
                found = get(join(places[start:end]))
                if found:
                    cells += (n, end, end - start, found)
                elif found is None:
                    break
    table = np.zeros((len(batch), max(lengths) + 1, longest + 1), np.int32)
    at = np.array(cells).reshape(-1, 4)
    table[at[:, 0], at[:, 1], at[:, 2]] = at[:, 3]
    return table, np.array(lengths)


def forward(table: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Sums over all segmentations up to each place: [word, place, language]; prob is [piece, language]."""
    n, places, sizes = table.shape
    alpha = np.zeros((n, places, prob.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, places):
        for size in range(1, min(sizes - 1, end) + 1):
            rows = np.flatnonzero(table[:, end, size])
            if len(rows):
                alpha[rows, end] += alpha[rows, end - size] * prob[table[rows, end, size]]
    return alpha


def word_scores(batch: list[str], log_prob: np.ndarray, path: str) -> np.ndarray:
    """log P(word | language) for distinct words, [word, language]; long words alone, in a scaled pass."""
    out = np.zeros((len(batch), log_prob.shape[1]))
    size = np.array([len(w.encode()) for w in batch])
    prob = np.exp(log_prob)
    order = np.argsort(size, kind="stable")
    short = order[size[order] <= 24]
    for part in np.array_split(short, len(short) // 4096 + 1):
        if len(part):
            table, lengths = lattice([batch[i] for i in part], path)
            out[part] = np.log(forward(table, prob)[np.arange(len(part)), lengths])
    for i in order[size[order] > 24].tolist():
        out[i] = long_word(batch[i], log_prob, path)
    return out


def long_word(word: str, log_prob: np.ndarray, path: str) -> np.ndarray:
    """The same in logarithms with a window of the longest piece: no underflow, little memory."""
    pieces, longest, _ = vocabulary(path)
    places = spelled(word, pieces)
    last = [np.zeros(log_prob.shape[1])]
    for end in range(1, len(places) + 1):
        ways = [last[-1] + log_prob[pieces[places[end - 1]]]]
        for size in range(2, min(longest, end) + 1):
            found = pieces.get("".join(places[end - size : end]))
            if found:
                ways.append(last[-size] + log_prob[found])
        last = [*last[-longest:], np.logaddexp.reduce(ways, axis=0)]
    return last[-1]


def expected_counts(batch: list[str], weight: np.ndarray, prob: np.ndarray, path: str) -> np.ndarray:
    """Expected piece counts of words with their counts ``weight``, under one language's ``prob`` [piece]."""
    table, lengths = lattice(batch, path)
    n, places, sizes = table.shape
    alpha = forward(table, prob[:, None])[:, :, 0]
    beta = np.zeros((n, places))
    beta[np.arange(n), lengths] = 1
    whole = alpha[np.arange(n), lengths]
    out = np.zeros(len(prob))
    for end in range(places - 1, 0, -1):
        for size in range(1, min(sizes - 1, end) + 1):
            rows = np.flatnonzero(table[:, end, size])
            if len(rows):
                p = prob[table[rows, end, size]] * beta[rows, end]
                beta[rows, end - size] += p
                np.add.at(out, table[rows, end, size], weight[rows] * alpha[rows, end - size] * p / whole[rows])
    return out


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, path: str = PIECES, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities [piece, language] from ``docs`` (doc_id, text, lang)."""
    own = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    langs = sorted(counts)
    _, _, size = vocabulary(path)
    if not langs:
        return [], np.zeros((size, 0))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(SAMPLE_DOCS / counts[lang]))])
    some = own.where(drawn(F.xxhash64(row_key(), F.lit(6)), F.element_at(share, F.col("lang"))))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.update((lang, part) for w in words(text.as_py() or "") for part in parts(w))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    table = some.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = materialise(table, "language-words")
    pieces, _, _ = vocabulary(path)
    usable = np.zeros(size)
    usable[[i for i in pieces.values() if i]] = 1
    prob = np.repeat((usable / usable.sum())[:, None], len(langs), axis=1)
    for _ in range(rounds):
        now = prob

        def expect(batches: Iterable[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now)
            for batch in batches:
                lang, word, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                for k, name in enumerate(langs):
                    mine = np.flatnonzero(lang == name)
                    mine = mine[np.argsort([len(w) for w in word[mine]], kind="stable")]
                    for part in np.array_split(mine, len(mine) // 2048 + 1):
                        if len(part):
                            total[:, k] += expected_counts(word[part].tolist(), n[part].astype(float), now[:, k], path)
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[piece, k])], names=["piece", "lang", "n"]
            )

        sums = table.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counted = np.zeros_like(prob)
        counted[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = np.round(sums["n"].to_numpy(), 6)
        prob = (counted + 0.1) * usable[:, None]
        prob /= prob.sum(0)
    with np.errstate(divide="ignore"):
        return langs, np.log(prob)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str = PIECES) -> DataFrame:
    """doc_id, lang_pred and score of ``docs`` (doc_id, text)."""
    langs, log_prob = model
    sent = docs.sparkSession.sparkContext.broadcast(log_prob)  # the vocabulary's size times the languages
    width = log_prob.shape[1]

    def work(ids: list, texts: list) -> dict:
        known, scores, used = _memory(width)
        seen = [Counter(words(t)) for t in texts] if langs else [Counter()] * len(texts)
        fresh = list({w: None for c in seen for w in c if w not in known})
        if len(known) + len(fresh) > REMEMBER:
            known.clear()
            used[0] = 0
            fresh = list({w: None for c in seen for w in c})
        if fresh:
            if used[0] + len(fresh) > len(scores[0]):
                scores[0] = np.resize(scores[0], (used[0] + len(fresh), width))
            scores[0][used[0] : used[0] + len(fresh)] = word_scores(fresh, sent.value, path)
            known.update(zip(fresh, range(used[0], used[0] + len(fresh)), strict=True))
            used[0] += len(fresh)
        preds, posts = [], []
        for c in seen:
            if not c:
                preds.append("und")
                posts.append(0.0)
                continue
            at = np.fromiter((known[w] for w in c), np.int64, len(c))
            total = np.fromiter(c.values(), float, len(c)) @ scores[0][at]
            best = int(np.argmax(total))
            preds.append(langs[best])
            posts.append(float(1 / np.exp(total - total[best]).sum()))
        return {"doc_id": ids, "lang_pred": preds, "score": posts}

    memory: dict = {}

    def _memory(n: int):
        if not memory:
            memory["all"] = ({}, [np.zeros((REMEMBER, n))], [0])
        return memory["all"]

    return map_text(docs, work, "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame) -> DataFrame:
    """Train on the documents not held out, predict all."""
    docs = docs.select(F.col("doc_id").cast("long"), empty_if_null(F.col("text")).alias("text"), F.col("lang").cast("string"))
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
