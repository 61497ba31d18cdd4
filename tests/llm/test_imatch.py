"""I-Match fingerprints against plain Python, and the order of next documents."""

import hashlib
import re

import pyarrow as pa
import pytest

from usagelens.llm import imatch
from usagelens.llm.queries import FINGERPRINT_SQL


def brute_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return set(re.findall("[0-9a-z\u0080-\U0010ffff]+", lowered))


def brute_print(text, lexicon):
    found = brute_terms(text)
    kept = sorted(found & lexicon, key=str.encode) or sorted(found or {text}, key=str.encode)
    out = []
    for i in range(33):
        limit = 256 if i == 0 else (64, 16, 4, 1)[(i - 1) // 8]
        own = [t for t in kept if hashlib.sha256(t.encode()).digest()[max(i - 1, 0)] < limit]
        out.append(hashlib.md5(" ".join(own).encode()).hexdigest()[:8] if own else "--------")
    return out


def brute(rows, low=0.001, high=0.3):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in rows]
    counts = {}
    for t in texts:
        for term in brute_terms(t):
            counts[term] = counts.get(term, 0) + 1
    lexicon = {t for t, n in counts.items() if low * len(rows) <= n <= high * len(rows)}

    def like(a, b):
        either = [x == y for x, y in zip(a, b) if {x, y} != {"--------"}]
        return sum(either) / len(either)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(rows)]
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        a, b, c = (brute_print(t, lexicon) for t in (text, changed, after))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), "".join(a),
                    "".join(b), like(a, b), like(a, c)))
    return out


def unique(document_rows):
    seen, out = set(), []
    for r in document_rows:
        if r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def test_fingerprints_equal_plain_python(spark, document_rows, documents, monkeypatch):
    monkeypatch.setattr(imatch, "COUNTED", 50)
    rows = unique(document_rows)
    found = imatch.with_edits(spark.createDataFrame(rows, documents.schema).repartition(5))
    expected = brute([r[:2] for r in rows])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_repeated_ids_and_small_tables(spark, document_rows, documents, no_documents):
    found = imatch.with_edits(documents).collect()
    assert len(found) == len(document_rows)
    by_text = {}
    for (i, text, *_), r in zip(sorted(document_rows, key=lambda r: (r[0] is not None, r[0] or 0)),
                                sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id or 0))):
        assert r.doc_id == i and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for r in found:
        by_text.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert imatch.with_edits(no_documents).collect() == []
    alone = imatch.with_edits(spark.createDataFrame([(4, "Only one text")], "doc_id long, text string"))
    (r,) = alone.collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"Only onOnly o").hexdigest()


@pytest.mark.parametrize("n,hot", [(1, 0), (500, 0), (400, 300)])
def test_every_row_meets_the_next(spark, monkeypatch, n, hot):
    """Ranges cut at any place, one id that most rows share, and rows repeated as they are."""
    monkeypatch.setattr(imatch, "RANGE_BYTES", 64)
    rows = [(3 if i < hot else 10 * i, f"t{i % 350}") for i in range(n)] + [(None, "none")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)

    def pair(found):
        now, out = next(found, None), []
        while now and not now[2]:
            after = next(found)
            out.append((now[0], now[1], after[0], after[1]))
            now = after
        if out:
            a, b, c, d = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b), pa.array(c, pa.int64()), pa.array(d)],
                names=["a", "b", "c", "d"])

    got = [tuple(r) for r in imatch.next_pairs(docs, pair, "a long, b string, c long, d string").collect()]
    assert sorted(((a, b) for a, b, _, _ in got), key=str) == sorted(rows, key=str)
    assert sorted(((c, d) for _, _, c, d in got), key=str) == sorted(rows, key=str)
    ids = sorted((i for i, _ in rows if i is not None))
    order = [None, None, *ids]
    steps = sorted(((a, c) for a, _, c, _ in got), key=str)
    assert steps == sorted(zip(order, order[1:] + order[:1]), key=str)


def test_terms_and_likeness():
    assert imatch.terms_of("The THE the, Éa été x1-2") == {
        t.encode() for t in ("the", "Éa", "été", "x1", "2")}
    a = "a" * 8 + "-" * 8 + "b" * 8
    assert imatch.likeness(a, a) == 1.0 and imatch.likeness(a, "c" * 8 + "-" * 16) == 0.0
    assert imatch.likeness(a, "a" * 8 + "c" * 16) == 1 / 3


def test_sql_twin_names_the_same_band():
    assert all(f"CAST({share} AS DOUBLE)" in FINGERPRINT_SQL for share in imatch.BAND)
