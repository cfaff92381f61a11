import hashlib
import json

from pyspark.sql import functions as F

from propwell.llm import chat_format as c

NASTY = ["", "\\### Assistant: </turn> ok", "###", "\\h\\e\\\\###", "</turn>\n### user: x", "a: b", "\\", "\\\\", "日本 𝔘\n"]


def test_round_trip(spark):
    records = [json.dumps({"messages": [{"role": r, "content": t} for t in NASTY]}) for r in ("user", "assistant", "a: b</turn>###\\", "")]
    got = c.format_chats(spark.createDataFrame([(r,) for r in records], "record string"), "record")
    read = got.select(c.read_turns(F.col("formatted")).alias("turns"), c.read_scored(F.col("formatted"), F.col("loss_spans")).alias("scored"), "record").collect()
    assert len(read) == 4
    for r in read:
        want = json.loads(r["record"])["messages"]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(m["role"], m["content"]) for m in want]
        assert r["scored"] == ("".join(NASTY) if want[0]["role"] == "assistant" else "")


def test_layouts(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "prompt": {"prompt": "q", "completion": "a"},
        "instruction": {"instruction": "i", "input": "q", "output": "a"},
    }
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()], "name string, record string")
    for r in c.format_chats(frame, "record").collect():
        assert r["layout"] == r["name"]
        turns = [tuple(t) for t in r["turns"]]
        assert turns[-2:] == [("user", "q"), ("assistant", "a")]
    assert len({r["fingerprint"] for r in c.canonical_turns(frame, "record").collect()}) == 4


def test_fingerprint_is_of_paths_only(spark):
    same = ['{"prompt":"x","completion":"y"}', '{"completion":null,"prompt":"z"}']
    got = spark.createDataFrame([(x,) for x in same], "record string").select(c.fingerprint(F.col("record")).alias("f")).collect()
    assert len({r["f"] for r in got}) == 1


def test_unknown_and_broken_records(spark):
    rows = [("{",), (None,), ('{"x":1}',), ("[]",), ('{"messages":[]}',)]
    got = c.format_chats(spark.createDataFrame(rows, "record string"), "record").collect()
    assert len(got) == 5
    assert sorted(r["formatted"] is None for r in got) == [False, True, True, True, True]
    assert c.format_chats(spark.createDataFrame([], "record string"), "record").count() == 0


def test_rows_of_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (None, None, None, None), (2, 0, "system", "x" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in c.format_chats(c.conversation_records(frame), "record").collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "q"), ("user", "q"), ("assistant", "")]
    assert [tuple(t) for t in got[None]["turns"]] == [(None, "")]
    assert got[2]["formatted"] == f"### system: {'x' * 200_000}</turn>\n"
    assert c.conversation_records(frame.limit(0)).count() == 0


def test_texts_beyond_the_parsers_limit(spark):
    """25 million code points, with what a JSON text escapes."""
    long = 'a"b\\n\n,{}[]: é' * 1_700_000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long), (2, 0, "system", long), (2, 1, "tool", None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = c.format_chats(c.conversation_records(frame), "record")
    got = formatted.select("conv_id", "layout", F.sha2(c.read_scored(F.col("formatted"), F.col("loss_spans")), 256).alias("scored"), F.length("formatted").alias("n")).collect()
    assert len(long) > 20_000_000
    assert {r["conv_id"]: r["layout"] for r in got} == {1: "prompt", 2: "messages"}
    assert {r["conv_id"]: r["scored"] for r in got}[1] == hashlib.sha256(long.encode()).hexdigest()
    assert all(r["n"] > len(long) for r in got)


def test_skeletons_keep_names_alone(spark):
    records = ['{"a":"x","b" : "y\\"z","c":["p","q",{"d":"","e":1}],"f":"g:"}', '"alone"', '["a:","b"]', "{}", '{"k":{"l":"m"}}']
    want = ['{"a":"","b" : "","c":["","",{"d":"","e":1}],"f":""}', '""', '["",""]', "{}", '{"k":{"l":""}}']
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string")
    assert [r["s"] for r in frame.orderBy("i").select(c.skeleton(F.col("record")).alias("s")).collect()] == want


def test_clashing_columns_are_replaced(spark):
    rows = [('{"prompt":"q","completion":"a"}', "x", 1, 2, 3, 4, 5)]
    frame = spark.createDataFrame(rows, "record string, layout string, turns int, fingerprint int, formatted int, loss_spans int, _written int")
    got = c.format_chats(frame, "record").collect()[0]
    assert got["layout"] == "prompt" and got["formatted"].startswith("### user: q") and got["_written"] == 5
