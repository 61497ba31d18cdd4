import zlib

from usagelens.llm import sharding
from usagelens.llm.sharding import Tree


def test_documents_land_once_with_gapless_slots(documents, document_rows):
    rows = sharding.shard_documents(documents, Tree.even(7), Tree.even(8)).collect()
    expected = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
                       for i, t, *_ in document_rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == expected
    for s in range(7):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 7) for r in rows)


def test_growth_takes_rows_only_into_the_new_shard(spark):
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    for n in (1, 4, 15, 16, 40):
        rows = sharding.place(df, "doc_id", Tree.even(n), Tree.even(n + 1)).collect()
        moved = [r for r in rows if r.shard != r.grown_shard]
        assert {r.grown_shard for r in moved} == {n}
        assert abs(len(moved) / 6000 - 1 / (n + 1)) < 0.25 / (n + 1) + 0.01


def test_changed_weight_moves_rows_in_or_out_of_its_path_only(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    one, two = Tree((1.0,) * 20), Tree((1.0,) * 6 + (3.0,) + (1.0,) * 13)
    rows = sharding.place(df, "doc_id", one, two).collect()
    assert {r.grown_shard for r in rows if r.shard != r.grown_shard} == {6}
    share = sum(r.grown_shard == 6 for r in rows) / 4000
    assert abs(share - 3 / 22) < 0.02


def test_weights_set_the_shares_and_zero_takes_nothing(spark):
    df = spark.range(8000).withColumnRenamed("id", "doc_id")
    rows = sharding.place(df, "doc_id", Tree((1.0, 2.0, 0.0, 1.0, 4.0), 2, 2)).collect()
    for s, w in enumerate((1, 2, 0, 1, 4)):
        assert abs(sum(r.shard == s for r in rows) / 8000 - w / 8) < 0.02


def test_place_keeps_other_columns_and_empty_tables(documents, no_documents):
    placed = sharding.place(documents, "doc_id", Tree.even(3), shard="home")
    assert placed.columns == [*documents.columns, "home"]
    assert sharding.shard_documents(no_documents, Tree.even(3)).count() == 0


def test_no_python_in_the_plan(documents):
    plan = sharding.place(documents, "doc_id", Tree.even(40))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
