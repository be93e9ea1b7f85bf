import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.chat import CONTROL, MAPPINGS, canonical, chats, digests, escaped, formatted, parsed, records_of_turns, unescaped

PIECES = st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "|", "/", ">", "\n", "text", "é", "<\\|end|>", "user"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_round_trip(text):
    out = escaped(text)
    assert unescaped(out) == text and not any(c in out for c in CONTROL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), PIECES), PIECES), max_size=6))
def test_template_round_trip(turns):
    text, spans = formatted(turns)
    assert parsed(text) == turns
    assert "".join(unescaped(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_layouts_become_the_same_turns():
    want = [("user", "Q"), ("assistant", "A")]
    for record in (
        {"messages": [{"role": "user", "content": "Q"}, {"role": "assistant", "content": "A"}]},
        {"conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}]},
        {"prompt": "Q", "completion": "A"}, {"question": "Q", "answer": "A"}, {"instruction": "Q", "input": "", "output": "A"},
        {"dialog": [{"speaker": "prompter", "text": "Q"}, {"speaker": "bot", "text": "A"}]},
    ):
        assert canonical(record)[1] == want
    assert canonical({"instruction": "Q", "input": "I", "output": "A"})[1] == [("user", "Q\n\nI"), ("assistant", "A")]
    assert canonical({"else": 1}) == (None, []) and canonical({"messages": []}) == ("messages", [])


def test_query_digests_equal_brute_force(spark):
    rows = [(1, 1, "assistant", "a</s>b"), (1, 0, "user", "q"), (2, 0, "user", None), (2, 0, None, "x"), (3, 5, "assistant", ""), (None, 0, "user", "n"), (1, 0, "user", "q")]
    table = spark.createDataFrame([(*r, "extra", "more") for r in rows], "conv_id long, turn long, role string, text string, record string, messages string")
    got = {r["conv_id"]: r for r in digests(chats(records_of_turns(table))).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_broken_records(spark):
    table = spark.createDataFrame([(1, None), (2, "{"), (3, "[1]"), (4, json.dumps({"prompt": "p", "response": "r"}))], "conv_id long, record string")
    got = {r["conv_id"]: (r["mapping"], r["formatted"]) for r in chats(table).collect()}
    assert got[1] == got[2] == got[3] == (None, "") and got[4][0] == "prompt-response"
    assert chats(table.limit(0)).collect() == []


def test_records_that_no_parser_takes_whole(spark):
    deep = "[" * 100_000 + "]" * 100_000
    odd = ['{"messages": ["hi"]}', '{"messages": [null]}', '{"messages": [[]]}', '{"messages": [{}]}', '{"messages": "x"}', '{"messages": [{"role": "user", "content": "x"}, 1]}', '{"prompt": ' + deep + ', "response": "r"}', "null", "3"]
    rows = [(i, x) for i, x in enumerate(odd)] + [(100, '{"prompt": "a\\ud800b", "response": "\\ud83d\\ude00"}'), (101, '{"messages": [{"role": null, "content": null}]}'), (102, '{"prompt": "", "completion": ""}'), (103, '{"prompt": null, "completion": "c"}')]
    got = {r["conv_id"]: r for r in digests_and_texts(spark.createDataFrame(rows, "conv_id long, record string"))}
    assert all(got[i]["mapping"] is None and got[i]["formatted"] == "" and got[i]["n_turns"] == 0 for i in range(len(odd)))
    assert parsed(got[100]["formatted"]) == [("user", "a\ufffdb"), ("assistant", "\U0001f600")]
    assert parsed(got[101]["formatted"]) == [("", "")]
    assert parsed(got[102]["formatted"]) == [("user", ""), ("assistant", "")] and parsed(got[103]["formatted"]) == [("assistant", "c")]


def digests_and_texts(table):
    chat = chats(table)
    return chat.join(digests(chat), "conv_id").collect()


def test_a_table_of_all_layouts(spark):
    """Each of the mappings is met through its fingerprint, and its texts come back from the output."""
    rows, want = [], {}
    for i, m in enumerate(MAPPINGS):
        record = {f: f"{f} of {i}" for f, _ in m.fields}
        if m.items:
            record[m.items] = [{m.role: "human", m.text: "Q </s>"}, {m.role: "assistant", m.text: "A " * 20_000}]
        rows.append((i, json.dumps(record)))
        want[i] = (m.name, m.turns(record))
    got = {r["conv_id"]: r for r in digests_and_texts(spark.createDataFrame(rows, "conv_id long, record string"))}
    assert len(got) == 13
    for i, (name, turns) in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[i]["mapping"] == name and parsed(got[i]["formatted"]) == turns and len(turns) > 1
        assert got[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[i]["loss_chars"] == len(loss) > 0
