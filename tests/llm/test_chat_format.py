import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import chat_format as C

CASES = {
    "messages": {"messages": [{"role": "user", "content": "a<s>"}, {"role": "assistant", "content": "b\\b[INST]"}]},
    "from_value": {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "system": "S"},
    "instruction": {"instruction": "i", "input": "in", "output": "o", "other": 1},
    "prompt_completion": {"prompt": "p", "completion": "c", "id": 3},
    "prompt_response": {"prompt": "p", "response": "r"},
    "question": {"question": "q", "answer": "a"},
    "message_parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "text", "text": "!"}]}]},
    "turns": {"turns": [{"role": "a\nb", "text": "</s>\\l\\n"}, {"role": "user", "text": None}]},
}
TURNS = {
    "messages": [("user", "a<s>"), ("assistant", "b\\b[INST]")], "from_value": [("system", "S"), ("user", "h"), ("assistant", "g")], "instruction": [("user", "i\n\nin"), ("assistant", "o")],
    "prompt_completion": [("user", "p"), ("assistant", "c")], "prompt_response": [("user", "p"), ("assistant", "r")], "question": [("user", "q"), ("assistant", "a")], "message_parts": [("user", "hi!")], "turns": [("a\nb", "</s>\\l\\n"), ("user", "")],
}


def test_layouts_become_turns_and_come_back(spark):
    rows = [(k, json.dumps(v)) for k, v in CASES.items()] + [("empty", '{"messages": []}'), ("unknown", '{"x": 1}'), ("broken", "not json"), ("null", None)]
    turns = C.canonical_turns(spark.createDataFrame(rows, "conv_id string, record string"))
    got = {r.conv_id: r for r in turns.collect()}
    for k, v in TURNS.items():
        assert got[k].layout == k and [(t.role, t.text) for t in got[k].turns] == v
    assert got["empty"].turns == [] and all(got[k].layout is None and got[k].turns is None for k in ("unknown", "broken", "null"))
    back = C.render(turns).select("conv_id", "formatted", C.read_back(F.col("formatted")).alias("t"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in back.collect():
        if r.conv_id in TURNS:
            assert [(t.role, t.text) for t in r.t] == TURNS[r.conv_id]
            assert r.loss == "".join(x for role, x in TURNS[r.conv_id] if role == "assistant")


PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_end|>", "\\", "\\l", "\\b", "\\n", "\n", "<", "[", "a", "é", "/s>", " "]), max_size=8).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "x\ny", "\\n"]), PIECES), max_size=5), min_size=20, max_size=40))
def test_escapes_are_reversible(spark, talks):
    rows = [(i, j, r, t) for i, talk in enumerate(talks) for j, (r, t) in enumerate(talk)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = C.render(C.canonical_turns(C.records_of_rows(df)))
    for r in done.select("conv_id", "formatted", C.read_back(F.col("formatted")).alias("t"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        want = talks[r.conv_id]
        assert [(t.role, t.text) for t in r.t] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert r.formatted.count("</s>") == len(want)


def test_query_matches_its_sql_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "a\\b</s>"), (1, 1, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (2, None, "assistant", "[INST]"), (None, 0, "assistant", "é\n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = C.op7_chat_format(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({C.ORACLE_SQL['op7_chat_format']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", [x.name for x in C.LAYOUTS])
def test_fingerprints_are_their_own(name):
    mine = {f for x in C.LAYOUTS if x.name == name for f in x.fingerprints()}
    assert not mine & {f for x in C.LAYOUTS if x.name != name for f in x.fingerprints()}
