import random

import duckdb
import pandas as pd

from usagelens.llm import chat
from usagelens.llm.queries import CHAT_SQL

SCHEMA = "conv_id long, turn long, role string, text string, h1 string, segment string"


def conversations(seed=1):
    rng, rows = random.Random(seed), []
    for c in range(60):
        said = [rng.choice(["hi", "yes", "no", "", None]) for _ in range(rng.randint(1, 6))]
        if c % 3 == 0:
            said = ["hello", "yes", "no", "well"][:rng.randint(1, 4)]
        rows += [(c, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(said)]
    rows += rows[:9] + [(None, 0, "user", "lost"), (99, None, None, "odd"), (99, 0, "", None),
                        (98, 0, "user", "tie"), (98, 0, "user", "tie 2"), (97, 0, "user", "tie")]
    rows += [(200, i, "user", f"t{i}") for i in range(1500)]
    rows += [(201, i, "user", f"t{i}") for i in range(1300)]
    return [(*r, "x", "y") for r in rows]


def test_equals_sql_over_lists_of_turns(spark):
    rows = conversations()
    found = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(4))
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "h1", "segment"])
    frame[["conv_id", "turn"]] = frame[["conv_id", "turn"]].astype("Int64")
    con.register("conversations", frame)
    expected = con.execute(CHAT_SQL).fetchall()
    ours = [tuple(r) for r in found.select("conv_id", "segment", "n_turns", "n_equal", "chat").collect()]
    assert sorted(ours, key=str) == sorted(expected, key=str)
    assert {r[0] for r in ours if r[0] in (200, 201)} == {200}


def test_rendering_and_collapse(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"),
            (3, 1, "assistant", "b"), (4, 0, "user", "b")]
    found = chat.format_chats(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()
    assert {r.conv_id: (r.n_turns, r.n_equal) for r in found} == {2: (2, 2), 4: (1, 1)}
    text = next(r.chat for r in found if r.conv_id == 2)
    assert text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
