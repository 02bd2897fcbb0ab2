"""How far the sources of a language differ in their words, with strings joined back late.

1. Tasks count the terms of each (lang, source) and the documents that hold them, and write these partial counts once,
   by a 64-bit digest of the term, with each string beside its digest once for all sources of the language.
2. Only digests are shuffled and summed: per (lang, source, digest) occurrences and documents, then per (lang, digest).
   Digests of at least ``MIN_DOCS`` documents of the language are kept.
3. For kept digests alone the smallest and the largest string are found. Where they differ, terms share a digest:
   these are counted again from the texts by digest and string, and each is kept or not by its own documents.
4. A group's share of a term is a whole number of billionths, floor by long division, so all that follows is exact.
   The most over-represented terms are ranked by digest, equals of the last rank included; the strings of these
   join back to settle order and cut. Differences of all pairs of sources are summed in blocks of terms: a block is a
   dense table of terms by sources, of at most ``CELLS`` cells (or one term), and strips of ``STRIP`` sources are
   compared with all. The output has a row per pair of sources of a language, as has each block's partial sum.

Null lang, source and text are empty strings. A document is a row: repeated rows and repeated or null identifiers count
each. A group without kept terms has the same share for all. Long texts are cut between terms into pieces of
``PIECE`` bytes. Empty tables give no rows. Columns other than lang, source and text are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import empty_if_null
from foldwright.session import materialise, small_side

MIN_DOCS, TOP, ADDED, SCALE = 30, 50, 5, 1_000_000_000
#: Counts that a task holds before it writes them.
HELD = 800_000
PIECE = 1 << 20
#: Cells of a block of terms by sources, and sources compared with all others in one task.
CELLS, STRIP = 1 << 17, 256
#: Kept digests (some 30 bytes each) up to which they are sent to the tasks; beyond, both sides are shuffled.
SEND_ROWS = 500_000

#: A byte of a term stands for itself, in lower case; all others are spaces. UTF-8 bytes over 127 belong to terms.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists that come from at most ``PIECE`` bytes, or from one term."""
    plain, at = text.translate(_TERM_BYTES), 0
    while at < len(plain):
        end = at + PIECE
        if end < len(plain):
            cut = plain.rfind(b" ", at, end + 1)
            end = cut if cut > at else plain.find(b" ", end)
            end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end + 1


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Partial counts: lang, source, term, n, docs, and ``first``: whether the term is new to what a task holds of the
    language. Every group has a row with a null term besides."""
    plain = docs.select(*[empty_if_null(docs[c]).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], empty_if_null(docs[text_col]).cast("binary").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64()), ("first", pa.bool_())])

    def told(counts: dict, holders: dict) -> Iterator[pa.RecordBatch]:
        known = defaultdict(set)
        for (lang, source), terms in counts.items():
            names = [None, *terms]
            n, held, old = [0, *terms.values()], holders[lang, source], known[lang]
            columns = [[lang] * len(names), [source] * len(names), names, n, [0, *map(held.__getitem__, terms)], [False, *(t not in old for t in terms)]]
            old.update(terms)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, holders, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own, seen = counts[lang, source], set()
                held -= len(own)
                for terms in pieces(text.as_py()):
                    own.update(terms)
                    seen.update(terms)
                holders[lang, source].update(seen)
                held += len(own)
                if held > HELD:
                    yield from told(counts, holders)
                    counts.clear()
                    holders.clear()
                    held = 0
        yield from told(counts, holders)

    return plain.mapInArrow(work, "lang string, source string, term binary, n long, docs long, first boolean").withColumn("term", F.col("term").cast("string"))


def share(count: Column, whole: Column) -> Column:
    """1 + floor(1e9 * count / whole) for 0 <= count <= whole < 9e15, by long division in steps of a thousand."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, whole)
        rest = F.pmod(rest * 1000, whole)
    return out + 1


def kept_terms(counts: DataFrame, min_docs: int, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, digest, split, term, lang_n) of the kept terms and (lang, source, digest, split, n) of their counts.

    ``split`` is empty, or the string itself where terms share a digest: these are counted again from ``whole``, which
    has the string in every row.
    """
    cells = materialise(counts.where("digest IS NOT NULL").groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "digest-counts")
    heads = cells.groupBy("lang", "digest").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    heads = materialise(heads.drop("docs"), "kept-digests")
    strings = counts.where("term IS NOT NULL").select("lang", "digest", "term").join(small_side(heads, SEND_ROWS), ["lang", "digest"])
    named = strings.groupBy("lang", "digest").agg(F.min("term").alias("term"), F.max("term").alias("last"), F.first("lang_n").alias("lang_n"))
    named = materialise(named, "kept-strings")
    plain = named.where(F.col("term") == F.col("last"))
    terms = plain.select("lang", "digest", F.lit("").alias("split"), "term", "lang_n")
    shared = named.where(F.col("term") != F.col("last")).select("lang", "digest")
    of_terms = cells.join(small_side(plain.select("lang", "digest"), SEND_ROWS), ["lang", "digest"])
    of_terms = of_terms.select("lang", "source", "digest", F.lit("").alias("split"), "n")
    if not shared.isEmpty():
        own = whole.join(small_side(shared, SEND_ROWS), ["lang", "digest"])
        own = own.groupBy("lang", "source", "digest", F.col("term").alias("split")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        own = materialise(own, "split-counts")
        apart = own.groupBy("lang", "digest", "split").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        terms = terms.unionByName(apart.select("lang", "digest", "split", F.col("split").alias("term"), "lang_n"))
        of_terms = of_terms.unionByName(own.drop("docs").join(apart.select("lang", "digest", "split"), ["lang", "digest", "split"]))
    return terms, of_terms


def shares(docs: DataFrame, min_docs: int = MIN_DOCS, digest_bits: int = 64, **columns) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, terms, cells): groups with sizes, kept terms with strings, and both shares of the terms that occur."""
    digest = F.xxhash64("term")
    if digest_bits < 64:
        digest = digest.bitwiseAND(F.lit((1 << digest_bits) - 1))
    whole = term_counts(docs, **columns).withColumn("digest", F.when(F.col("term").isNotNull(), digest))
    # a string is written once for all sources that a task holds of a language
    counts = materialise(whole.withColumn("term", F.when(F.col("first"), F.col("term"))).drop("first"), "term-counts")
    terms, of_terms = kept_terms(counts, min_docs, whole)
    sizes = of_terms.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("all"))
    groups = counts.where("digest IS NULL").select("lang", "source").distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, ["lang"], "left").fillna(0)
    by_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    groups = materialise(groups.join(by_lang, "lang"), "groups")
    cells = of_terms.join(terms.select("lang", "digest", "split", "lang_n"), ["lang", "digest", "split"]).join(small_side(groups), ["lang", "source"])
    p = share(F.col("n") + ADDED, F.col("own") + ADDED * F.col("v"))
    q = share(F.col("lang_n") + ADDED, F.col("all") + ADDED * F.col("v"))
    cells = cells.select("lang", "source", "digest", "split", "n", p.alias("p"), q.alias("q"), "v", "n_sources")
    return groups, terms, materialise(cells, "shares")


def pair_sums(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value): the differences of two sources, summed over all kept terms of the language."""
    blocks = F.greatest(F.ceil(F.col("v") * F.col("n_sources") / CELLS), F.lit(1))
    strips = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_sources") - 1) / STRIP).cast("int"))).alias("strip")
    block = F.pmod(F.xxhash64("digest", "split"), blocks)
    left = cells.select("lang", "source", "digest", "split", "p", block.cast("long").alias("block"), strips)
    absent = F.when(F.col("v") > 0, share(F.lit(ADDED).cast("long"), F.greatest(F.col("own") + ADDED * F.col("v"), F.lit(ADDED)))).otherwise(0)
    right = groups.select("lang", "source", absent.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"), "n_sources").select("lang", "source", "p", "block", strips)

    def work(key: tuple, found: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", ignore_index=True)
        names = sources["source"].to_numpy()
        at = pd.Index(names).get_indexer(found["source"])
        term = found.groupby(["digest", "split"], sort=False).ngroup().to_numpy()
        table = np.tile(sources["p"].to_numpy(np.int64), (int(term.max()) + 1 if len(term) else 0, 1))
        table[term, at] = found["p"].to_numpy(np.int64)
        parts = []
        for g in range(key[2] * STRIP, min((key[2] + 1) * STRIP, len(names))):
            value = np.abs(table - table[:, g : g + 1]).sum(axis=0)
            other = np.arange(len(names)) != g
            parts.append(pd.DataFrame({"lang": key[0], "source": names[g], "item": names[other], "value": value[other]}))
        return pd.concat(parts, ignore_index=True)

    keys = ["lang", "block", "strip"]
    summed = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, "lang string, source string, item string, value long")
    return summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(cells: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): the terms whose share in the source is furthest above that in the language."""
    over = cells.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).withColumn("value", F.col("p") - F.col("q"))
    own = Window.partitionBy("lang", "source")
    likely = over.withColumn("_rank", F.rank().over(own.orderBy(F.desc("value")))).where(F.col("_rank") <= top)
    # few rows are left: text joins here, and settles the order of equals
    likely = likely.select("lang", "source", "digest", "split", "value").join(terms.select("lang", "digest", "split", "term"), ["lang", "digest", "split"])
    return likely.select("lang", "source", F.col("term").alias("item"), "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = 64, **columns) -> DataFrame:
    """lang, source, part, item, value, rank: each source against its language's other sources and words."""
    groups, terms, cells = shares(docs, min_docs, digest_bits, **columns)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_sums(groups, cells).withColumn("rank", F.row_number().over(order))
    words = top_terms(cells, terms, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    told = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, d in (("pair", pairs), ("term", words))]
    return told[0].unionByName(told[1])
