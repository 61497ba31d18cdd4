"""Document fingerprints by I-Match over randomised lexicons.

Terms are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased.  The
lexicon holds the terms whose inverse document frequency, ln(documents / documents with the
term), lies between ln(1 / 0.3) and ln(1000), counted over all documents.  Of a text the distinct lexicon terms are
sorted; one hash covers all of them, and 32 more cover those in random subsets of the lexicon
(a quarter, a 16th, a 64th or a 256th of it each), so that short and long texts alike have
hashes that survive an edit.  A fingerprint is the 33 hashes of eight hex digits, dashes where
no term is left.  Likeness is the share of equal hashes among those that either side has.

The band bounds the lexicon: where a document holds t terms on average, at most 1000 t terms are
in a thousandth of the documents each, however many documents there are.  Only this lexicon is
broadcast.

A text without a lexicon term keeps all its terms, one without any term is a term itself
(its whole text), so equal texts, and only they, are sure to agree.  Null texts are empty ones.

``next_pairs`` brings every document together with the next by ``doc_id`` (null first; equal ids by
a hash of the text): rows go once, compressed, to ranges between cuts from a bounded sample, and every
range also gets the first row of the next.  After the last row comes the first.  Repeated
rows follow each other; a single row follows itself.  An empty table has an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from usagelens.llm.common import whole_text

#: The band as shares of the documents; the ends belong to it.
BAND = (0.001, 0.3)
#: Byte i of a term's SHA-256 puts it into subset i + 1 if it is below the i-th limit.
LIMITS = (64,) * 8 + (16,) * 8 + (4,) * 8 + (1,) * 8
DIGITS = 8
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Terms a task counts before it hands them on; sampled rows for cuts, at most; bytes of a range.
COUNTED, SAMPLE, RANGE_BYTES = 200_000, 20_000, 32 << 20

Batches = Iterator[pa.RecordBatch]


def terms_of(text: str) -> set[bytes]:
    return set(TERM.findall(text.encode().lower()))


def subsets_of(term: bytes) -> tuple[int, ...]:
    """Numbers of the subsets that hold a term; 0 is the whole lexicon."""
    digest = hashlib.sha256(term).digest()
    return (0, *(i for i, (b, limit) in enumerate(zip(digest, LIMITS), 1) if b < limit))


def fingerprint(text: str, lexicon: dict[bytes, tuple[int, ...]]) -> str:
    """``lexicon`` holds the subsets of its terms."""
    found = terms_of(text)
    places = {t: lexicon[t] for t in found if t in lexicon} or {
        t: subsets_of(t) for t in found or {text.encode()}}
    kept: list[list[bytes]] = [[] for _ in range(len(LIMITS) + 1)]
    for term in sorted(places):
        for i in places[term]:
            kept[i].append(term)
    return "".join(hashlib.md5(b" ".join(k)).hexdigest()[:DIGITS] if k else "-" * DIGITS
                   for k in kept)


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among those that one of two fingerprints has."""
    none, pairs = "-" * DIGITS, [(a[i:i + DIGITS], b[i:i + DIGITS])
                                 for i in range(0, len(a), DIGITS)]
    either = [x == y for x, y in pairs if x != none or y != none]
    return sum(either) / len(either)


def document_frequencies(documents: DataFrame) -> DataFrame:
    """``term, n``: documents that hold the term."""
    def counted(batches: Batches) -> Batches:
        counts: Counter[bytes] = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()).cast(pa.string()),
                 pa.array(counts.values(), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(terms_of(text))
                if len(counts) > COUNTED:
                    yield handed_on()
        yield handed_on()

    return (documents.select(whole_text().alias("text")).mapInArrow(counted, "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("n")))


def lexicon_of(documents: DataFrame, n_documents: int, band: tuple[float, float] = BAND
               ) -> dict[bytes, tuple[int, ...]]:
    """Terms within the band, with their subsets."""
    low, high = (n_documents * share for share in band)
    rows = document_frequencies(documents).where(F.col("n").between(low, high)).select("term")
    return {t: subsets_of(t) for r in rows.collect() for t in [r.term.encode()]}


@dataclass(frozen=True)
class Ranges:
    """Cuts in the order of documents; range i holds what is from cut i - 1 on to before cut i."""

    cuts: tuple[tuple[int, int, int], ...]

    def of(self, doc_id: Column, code: Column) -> Column:
        cuts = self.cuts

        @F.arrow_udf(IntegerType())
        def placed(ids: pa.Array, codes: pa.Array) -> pa.Array:
            return pa.array([bisect_right(cuts, _place(i, c)) for i, c in zip(
                ids.to_pylist(), codes.to_pylist())], pa.int32())

        return placed(doc_id, code)

    def packed(self, rows: DataFrame) -> DataFrame:
        """Rows of ``doc_id, code, range, text`` with their texts compressed, which halves what moves;
        a null range is that of the row's place."""
        cuts = self.cuts

        def pack(batches: Batches) -> Batches:
            compress = zstandard.ZstdCompressor(level=1).compress
            for batch in batches:
                at = [bisect_right(cuts, _place(i, c)) if r is None else r
                      for i, c, r in zip(*(batch.column(k).to_pylist() for k in range(3)))]
                texts = [compress(t.encode()) for t in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(at, pa.int32()),
                     pa.array(texts, pa.binary())], names=["doc_id", "code", "range", "packed"])

        return rows.select("doc_id", "code", "range", "text").mapInArrow(
            pack, "doc_id long, code long, range int, packed binary")


def _place(doc_id: int | None, code: int) -> tuple[int, int, int]:
    """Null ids come first."""
    return (0, 0, code) if doc_id is None else (1, doc_id, code)


CODE = "xxhash64(coalesce(text, ''))"


def _ranges(documents: DataFrame) -> Ranges:
    """Ranges of about ``RANGE_BYTES`` of text, at least one per shuffle partition."""
    keys = documents.select(F.col("doc_id").cast("long"), F.expr(CODE).alias("code"),
                            F.octet_length(whole_text()).cast("long").alias("size"))
    n, size = keys.agg(F.count("*"), F.sum("size")).first()
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-(size or 0) // RANGE_BYTES))
    step = max(1, -(-n // SAMPLE))
    sample = sorted(_place(r.doc_id, r.code) for r in keys.where(
        F.pmod(F.xxhash64("doc_id", "code"), F.lit(step)) == 0).select("doc_id", "code").collect())
    at = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    return Ranges(tuple(at))


def next_pairs(documents: DataFrame, pair: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """``pair`` sees ``doc_id, text, is_last`` in order; the last row of a range, which is the first of
    the next one, only follows."""
    ranges = _ranges(documents)
    spark, n = documents.sparkSession, len(ranges.cuts) + 1
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")) \
        .withColumn("code", F.expr(CODE))
    key = F.struct(F.isnotnull("doc_id").alias("named"), "doc_id", "code")
    heads = sorted(rows.select(ranges.of(F.col("doc_id"), F.col("code")).alias("range"), "doc_id", "code")
                   .groupBy("range").agg(F.min(key).alias("k")).collect(), key=lambda r: r.range)
    before = [(heads[i - 1].range, h.k.doc_id, h.k.code) for i, h in enumerate(heads)]
    followers = F.broadcast(spark.createDataFrame(before, "range int, id long, c long"))  # a row a range
    texts = rows.join(followers, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("code") == F.col("c"))) \
        .groupBy("range", "doc_id", "code").agg(F.min("text").alias("text"))
    own = ranges.packed(rows.withColumn("range", F.lit(None).cast("int")))
    dealt = (own.withColumn("follows", F.lit(False))
             .unionByName(ranges.packed(texts).withColumn("follows", F.lit(True)))
             .repartitionById(n, F.col("range"))
             .sortWithinPartitions("follows", F.col("doc_id").asc_nulls_first(), "code", "packed"))

    def paired(batches: Batches) -> Batches:
        expand = zstandard.ZstdDecompressor().decompress
        yield from pair(chain.from_iterable(
            zip(b.column(0).to_pylist(), (expand(t).decode() for t in b.column(1).to_pylist()),
                b.column(2).to_pylist()) for b in batches))

    return dealt.select("doc_id", "packed", "follows").mapInArrow(paired, schema)


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")
#: Rows handed on at once.
OUT = 1000


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by as many from the start of the other text."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def with_edits(documents: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are; see ``RESULT``."""
    lexicon = documents.sparkSession.sparkContext.broadcast(
        lexicon_of(documents, documents.count(), band))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        ids, *rest = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, rest)],
                                          names=[c.split()[0] for c in RESULT.split(", ")])

    def compared(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, now = [], next(rows, None)
        own = now and fingerprint(now[1], lexicon.value)
        while now and not now[2]:
            after = next(rows)
            changed, theirs = edited(now[1], after[1]), fingerprint(after[1], lexicon.value)
            other = fingerprint(changed, lexicon.value)
            out.append((now[0], len(now[1]), hashlib.sha256(changed.encode()).hexdigest(), own,
                        other, likeness(own, other), likeness(own, theirs)))
            if len(out) == OUT:
                yield batch(out)
                out = []
            now, own = after, theirs
        if out:
            yield batch(out)

    return next_pairs(documents, compared, RESULT)
