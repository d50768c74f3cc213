"""Operator 10: layouts, round trips and rows that fit none."""

import json

from seekmill.llm import chat

from . import brute


def _turns(spark, records):
    df = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)], "id bigint, record string")
    out = {}
    for r in chat.format_chat(df).orderBy("id", "turn").collect():
        out.setdefault(r.id, (r.layout, []))[1].append((r.role, r.text))
    return out


def test_layouts(spark):
    got = _turns(
        spark,
        [
            {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
            {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7},
            {"instruction": "do", "input": "this", "output": "done"},
            {"output": "done", "instruction": "do", "input": ""},
            {"prompt": "p", "completion": "c"},
            {"data": {"answer": "a", "question": "q"}},
            {"question": "q", "answer": "a", "system_prompt": "s"},
            {"dialog": [{"speaker": "Human", "text": "x"}]},
            {"prompt": "p"},
        ],
    )
    assert got == {
        0: ("messages", [("user", "q"), ("assistant", "a")]),
        1: ("sharegpt", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        2: ("instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        3: ("instruction", [("user", "do"), ("assistant", "done")]),
        4: ("prompt_completion", [("user", "p"), ("assistant", "c")]),
        5: ("nested_qa", [("user", "q"), ("assistant", "a")]),
        6: ("question_answer", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        7: ("dialog", [("user", "x")]),
        8: ("prompt_only", [("user", "p")]),
    }


def test_records_that_fit_no_layout_are_kept(spark):
    got = _turns(spark, [None, "", "{broken", "[1, 2]", {"unknown": 1}, {"messages": []}, "3", {"messages": [{"role": None, "content": None}]}])
    assert {i: layout for i, (layout, _) in got.items()} == {0: "invalid", 1: "invalid", 2: "invalid", 3: "unknown", 4: "unknown", 5: "messages", 6: "unknown", 7: "messages"}
    assert all(turns == [(None, None)] for turns in (t for _, t in got.values()))


def test_fingerprints_depend_on_paths_only(spark):
    rows = ['{"a": 1, "b": {"c": "x"}}', '{"b": {"c": null}, "a": "one"}', '{"a": 1, "b": "x"}']
    f = [r.f for r in spark.createDataFrame([(r,) for r in rows], "r string").select(chat.fingerprint(chat.F.col("r")).alias("f")).collect()]
    assert f[0] == f[1] != f[2]


def test_conversations_round_trip(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = chat.format_chat(chat.as_records(t))
    assert out.filter("layout IN ('unknown', 'invalid')").count() == 0 and out.select("layout").distinct().count() >= 5
    rows = sorted((r.conv_id, r.turn, r.role, r.text) for r in t.collect())
    assert sorted((r.id, r.turn, r.role, r.text) for r in out.collect()) == rows


def test_nasty_rows(spark):
    docs = brute.nasty(spark, "record v paths which layout").withColumn("record", chat.F.to_json(chat.F.struct(chat.F.lit("p").alias("prompt"), chat.F.col("text").alias("completion")), {"ignoreNullFields": "false"}))
    out = chat.format_chat(docs, "doc_id", "record").collect()
    assert sum(r.role == "user" for r in out) == docs.count() and sum(r.role == "assistant" for r in out) == docs.filter("text IS NOT NULL").count()
    assert chat.format_chat(docs.limit(0), "doc_id", "record").collect() == []
    assert chat.as_records(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []
