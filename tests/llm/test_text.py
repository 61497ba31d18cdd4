import hashlib
import random
import re
import time

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from usagelens.llm import decontaminate, pii
from usagelens.llm.common import whole_text


def plain_luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def plain_spans(text):
    out = [(m.start(), 0, "email", m.end()) for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in
            re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and plain_luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


PIECES = ["a@b.co", "x.y@@z.com", "@", ".", "me@host", "1.2.3.4", "300.1.1.1", "01.002.3.4.5",
          "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0100", "+1234", " ", "é", "🎉",
          "5", "-", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "iban ", "mail "]


@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_spans_equal_the_patterns(text):
    base = [s for s in pii.spans_of(text) if s[0] in pii.BASE]
    assert ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base) == plain_spans(text)


def test_checksums_confirm_and_context_raises():
    found = pii.spans_of("IBAN GB82 WEST 1234 5698 7654 32. Not GB82 WEST 1234 5698 7654 33.")
    assert [(k, a, b) for k, a, b, _ in found] == [("iban", 5, 32)]
    assert pii.spans_of("number 123-45-6789") == []
    assert [s[0] for s in pii.spans_of("social security 123-45-6789")] == ["ssn"]
    plain, near = pii.spans_of("x 1.2.3.4")[0][3], pii.spans_of("server 1.2.3.4")[0][3]
    assert near > plain


def test_codes_end_where_the_country_says():
    for code in ("ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "BE68 5390 0754 7034",
                 "AT61 1904 3002 3457 3201", "PL61 1090 1014 0000 0712 1981 2874",
                 "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for after in ("", " EUR 500", " EUR", " EUROS", " A", ".", " and", " FR14"):
            found = [s[:3] for s in pii.spans_of(f"to {code}{after}") if s[0] == "iban"]
            assert found == [("iban", 3, 3 + len(code))], (code, after)
    both = "AB12 ES91 2100 0418 4502 0005 1332 BE68 5390 0754 7034 EUR"
    assert [s[1:3] for s in pii.spans_of(both) if s[0] == "iban"] == [(5, 34), (35, 54)]
    assert pii.masked_text("ES9121000418450200051332 EUR") == "[IBAN] EUR"


def test_an_address_part_of_many_zeros():
    text = f"1.2.3.{'0' * 5000}4 and {'0' * 5000}.0.0.1"
    assert [s[0] for s in pii.spans_of(text) if s[0] == "ip"] == ["ip", "ip"]


@given(st.text("0129. ", max_size=60))
@settings(max_examples=400, deadline=None)
def test_addresses_tried_by_runs_are_those_of_the_pattern(text):
    assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in pii.IP_RUNS.finditer(text)]


def test_a_million_digits_take_seconds():
    for text in ("7" * 1_000_000, "1." * 500_000, "12.34." * 170_000 + "x", "1" * 500_000 + "." + "2" * 500_000):
        start = time.process_time()
        list(pii.ips(text))
        assert time.process_time() - start < 5


def test_columns_over_awkward_documents(documents, document_rows):
    spans = pii.find(whole_text())
    rows = documents.select("doc_id", whole_text().alias("t"), spans.alias("s")).select(
        "doc_id", "t", pii.listed(F.col("s"), pii.BASE).alias("base"),
        pii.count(F.col("s"), "email").alias("n")).collect()
    assert len(rows) == len(document_rows)
    assert all(r.base == plain_spans(r.t) and r.n == r.base.count("email") for r in rows)


def test_corpus_spans_equal_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("text", F.sha2(pii.listed(pii.find(F.col("text")), pii.BASE), 256)
                       .alias("h")).collect()
    assert all(r.h == hashlib.sha256(plain_spans(r.text).encode()).hexdigest() for r in rows)


def test_masking_replaces_whole_spans(spark):
    df = spark.createDataFrame([("write a@b.co, 1.2.3.4!",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(pii.mask(F.col("text"))).collect()] == [
        "write [EMAIL], [IP]!", None, ""]


# -- decontamination ----------------------------------------------------------

def plain_tiling(text, item, match):
    """Greedy string tiling by comparing everything with everything."""
    a, b = decontaminate.words_of(text), decontaminate.words_of(item)
    match = min(match, len(b))
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while b:
        best = (0, 0, 0)
        for q in range(len(b)):
            for p in range(len(a)):
                n = 0
                while (p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]
                       and free_a[p + n] and free_b[q + n]):
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < match:
            break
        for i in range(n):
            free_a[p + i] = free_b[q + i] = False
        covered += n
    return covered


@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), min_size=1,
                                                                max_size=14))
@settings(max_examples=300, deadline=None)
def test_tiling_equals_comparing_everything(text, item):
    text, item = " ".join(text), " ".join(item)
    found = [f[2] for f in decontaminate.Benchmark([(1, item)], 3).found(text)]
    assert (found or [0])[0] == plain_tiling(text, item, 3)


@given(st.lists(st.sampled_from("ab"), max_size=24), st.lists(st.sampled_from("ab"), min_size=1,
                                                              max_size=16))
@settings(max_examples=300, deadline=None)
def test_tiling_of_repeated_words_equals_comparing_everything(text, item):
    text, item = " ".join(text), " ".join(item)
    found = [f[2] for f in decontaminate.Benchmark([(1, item)], 4).found(text)]
    assert (found or [0])[0] == plain_tiling(text, item, 4)


def test_a_word_repeated_many_times_takes_seconds():
    index = decontaminate.Benchmark([(1, "again " * 200 + "and the end"), (2, "other words " * 60)])
    start = time.process_time()
    (match,) = index.found("again " * 200_000)
    assert match[:3] == (1, 1, 200) and time.process_time() - start < 20


def test_equal_benchmark_rows_are_reported_each(spark):
    bench = spark.createDataFrame([(1, ITEMS[0][1])] * 300 + [(2, ITEMS[1][1])], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEMS[0][1]), (2, "nothing of it")], "doc_id long, text string")
    found = decontaminate.contaminations(docs, bench).collect()
    assert len(found) == 300 and {(r.doc_id, r.item_id) for r in found} == {(1, 1)}
    assert [len(b.items) for b in decontaminate.blocks_of(bench)] == [2]


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near a river bank today"),
         (2, "Pack my box with five dozen liquor jugs and then carry them home"),
         (3, None), (4, ""), (5, "short one"), (None, "an item that has no number of its own")]


def benchmark(spark):
    return spark.createDataFrame([(*i, "x") for i in ITEMS],
                                 "item_id long, text string, coverage string")


def test_reordered_and_partial_passages(spark):
    fox = ITEMS[0][1]
    rows = [(1, f"before {fox.upper()} after"), (2, "near a river bank today! the quick brown fox jumps"
             " over -- and the quick"), (3, "the quick brown fox sat near a river"),
            (4, "short one"), (5, "one short"), (6, "an item that has no number of its own"),
            (7, "pack my box with five; dozen liquor jugs and then")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminations(docs, benchmark(spark)).collect()}
    assert set(found) == {(1, 1), (2, 1), (4, 5), (6, None), (7, 2)}
    assert found[1, 1].coverage == 1.0 and found[2, 1].n_tiles == 2
    kept = decontaminate.clean(docs, benchmark(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5]


def test_blocks_give_the_same_result(spark, documents, document_rows):
    rng = random.Random(1)
    items = [(i, " ".join((t or "").split()[:30])) for i, t, *_ in rng.sample(document_rows, 25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.contaminations(documents, bench)
    blocks = list(decontaminate.blocks_of(bench, block_bytes=600))
    assert len(blocks) > 3
    found = sorted(((i, *f) for i, t, *_ in document_rows for b in blocks for f in b.found(t or "")
                    if f[3] >= 0.5), key=str)
    assert sorted(map(tuple, whole.collect()), key=str) == found and found


def test_empty_tables(spark, documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminations(no_documents, benchmark(spark)).count() == 0
    assert decontaminate.contaminations(documents, none).count() == 0
    assert decontaminate.clean(documents, none).count() == documents.count()
