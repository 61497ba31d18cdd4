import base64
import zlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import numpy as np
from usagelens.llm import bpe, tokenfile
from usagelens.llm.common import scratch, whole_text

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS,
                              special_tokens={})
ENCODER = bpe.Encoder.load(bpe.RANKS, public_tokenizers.PATTERN)


def ids_of(text):
    return np.frombuffer(ENCODER.encode(text), "<u4").tolist()


@given(st.text(st.sampled_from("abcthe ing 's  \n\té漢🎉12.,!?A"), max_size=80))
@settings(max_examples=400, deadline=None)
def test_encoding_equals_the_library(text):
    assert ids_of(text) == REFERENCE.encode_ordinary(text)


@given(st.binary(max_size=120), st.integers(0, 120), st.integers(0, 120), st.binary(max_size=8))
@settings(max_examples=200, deadline=None)
def test_appends_and_edits_keep_the_encoding(data, a, b, new):
    def encoded(piece):
        return REFERENCE._encode_single_piece(piece) if piece else []
    prefixes = bpe.Prefixes(ENCODER.vocabulary, data[:40])
    prefixes.append(data[40:])
    assert prefixes.tokens() == encoded(data)
    start, end = sorted((min(a, len(data)), min(b, len(data))))
    prefixes.edit(start, end, new)
    assert prefixes.data == data[:start] + new + data[end:]
    assert prefixes.tokens() == encoded(prefixes.data)


def test_an_edit_recomputes_only_nearby():
    prefixes = bpe.Prefixes(ENCODER.vocabulary, b"the river and the stone " * 2000)
    assert prefixes.edit(24_000, 24_001, b"x") < 3 * ENCODER.vocabulary.longest


def test_columns_round_trip(documents, document_rows):
    coded = documents.select("doc_id", whole_text().alias("t"), bpe.encode(whole_text()).alias("ids"))
    rows = coded.select("doc_id", "t", "ids", bpe.decode(F.col("ids")).alias("back"),
                        bpe.ids_array(F.col("ids")).alias("list"),
                        bpe.n_tokens(F.col("ids")).alias("n")).collect()
    assert len(rows) == len(document_rows)
    for r in rows:
        assert bytes(r.back).decode() == r.t and r.n == len(r.list)
        assert r.list == REFERENCE.encode_ordinary(r.t)


def library_ids(text):
    t = Tokenizer.from_file(tokenfile.TOKENIZER)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def check_files(spark, documents, rows, **options):
    manifest = tokenfile.write(documents, scratch(spark, "files"), **options)
    found = tokenfile.read(spark, manifest).collect()
    found.sort(key=lambda r: r.start)
    assert [r.doc_id is not None for r in found] == sorted(r.doc_id is not None for r in found)
    ids = [r.doc_id for r in found if r.doc_id is not None]
    assert ids == sorted(ids) and len(found) == len(rows)
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    expected = sorted((str(i), zlib.crc32(np.array([*library_ids(t or ""), 0], "<u4").tobytes()))
                      for i, t, *_ in rows)
    assert sorted((str(r.doc_id), zlib.crc32(bytes(r.ids))) for r in found) == expected


def test_files_hold_all_documents_in_order(spark, documents, document_rows):
    check_files(spark, documents, document_rows)
    check_files(spark, documents, document_rows, block=100, bits=True)


def test_added_tokens_are_found_as_by_the_plain_call():
    plain = Tokenizer.from_file(tokenfile.TOKENIZER)
    encoder = tokenfile.LibraryEncoder(tokenfile.TOKENIZER)
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a  <|endoftext|>\n\nb<|endoftext|>", "<|endoftext",
             "no token here", "", "odd\x1cspace <|endoftext|> x", "odd\x1cspace  x"]
    found = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.many(texts)]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert found[0] == [87, 220, 50256, 331]


def test_units_need_no_whole_call(monkeypatch):
    """Missing units go through the library's splitter and model, its whole call is spared."""
    texts = ["It's  the\n\n end, we'll see...", "a1b2 \u00e9t\u00e9 12.5 x_y__z ''tis '9a", " \t\u3042\u6f22\u5b57 \u0416\u0438 \U0001f600!",
             "caf\u00e9\u00d7\u00f7 \u00aa\u00b5\u00ba\u01c0\u024f\u0250 don't", "", " ", "x  "] * 2
    expected = [library_ids(t) for t in texts]
    monkeypatch.setattr(tokenfile, "CACHE", 4)
    encoder = tokenfile.LibraryEncoder(tokenfile.TOKENIZER)
    monkeypatch.setattr(encoder, "_whole", None)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.many(texts)] == expected


def test_plain_letters_are_one_match():
    units = tokenfile.LibraryEncoder(tokenfile.TOKENIZER).units
    letters = "".join(c for c in map(chr, range(0x250)) if tokenfile.PLAIN(c) and c != " ")
    assert letters.isalpha() and len(letters) > 400
    (match, _), = units.split(f" {letters}")
    assert match == f" {letters}".encode().decode("latin-1").translate(tokenfile.ALPHABET)
    printed = "".join(map(chr, range(0x80)))
    assert ("".join(m for m, _ in units.split(printed)) == printed.translate(tokenfile.ALPHABET))


def test_no_documents_make_no_files(spark, no_documents):
    manifest = tokenfile.write(no_documents)
    assert manifest.count() == 0 and tokenfile.read(spark, manifest).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.booleans())
@settings(max_examples=100, deadline=None)
def test_planes_round_trip(values, bits):
    ids = np.array(values, "<u4")
    planes = tokenfile.planes_of(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert tokenfile.ids_of(planes, len(ids), bits).tolist() == values


def test_blocks_are_read_at_random(tmp_path):
    import pyarrow.fs as pafs
    path = str(tmp_path / "a.planes")
    with open(path, "wb") as out:
        writer = tokenfile.PlaneWriter(out, block=64)
        for d in range(30):
            writer.add(d, np.arange(d * 10, d * 10 + d, dtype="<u4"))
        writer.close()
    reader = tokenfile.PlaneReader(pafs.LocalFileSystem().open_input_file(path))
    flat = np.concatenate([np.arange(d * 10, d * 10 + d) for d in range(30)])
    assert reader.block(3).tolist() == flat[192:256].tolist()
    assert [len(ids) for _, ids in reader] == list(range(30))
