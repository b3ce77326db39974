"""Pseudonyms and tool calls against plain Python."""

import json
import re

from spikeloom.llm import chat, pii


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def test_pseudonyms(shared, frame):
    text = "Mail the.72@mail3.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111, ip 10.20.30.40, born 1984-02-29, not 4111111111111112 nor 300.1.1.1 nor 2023-13-45. DE89 3704 0044 0532 0130 00"
    df = shared.createDataFrame([(1, text), (2, "Again: the.72@mail3.example.com and 4111 1111 1111 1111"), (3, "clean text with 12 words"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(df).collect()}
    new = got[1].text
    assert got[1].n_replaced == 6
    for gone in ("the.72@", "555-7713", "4111 1111 1111 1111", "10.20.30.40", "1984-02-29", "DE89 3704 0044 0532 0130 00"):
        assert gone not in new
    for kept in ("4111111111111112", "300.1.1.1", "2023-13-45", "@mail3.example.com"):
        assert kept in new
    assert re.sub(r"\d", "9", re.sub("[a-z]", "x", new)).count("9") == re.sub(r"\d", "9", text).count("9") or len(new) >= len(text) - 9
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", new)[1]
    mail = re.search(r"[a-z]+\.\d\d@mail3", new)[0]
    assert luhn(card.replace(" ", "")) and card in got[2].text and mail in got[2].text
    assert (got[3].text, got[3].n_replaced, got[4].text, got[5].text) == ("clean text with 12 words", 0, None, "")
    assert {r.doc_id: r.text for r in pii.pseudonymised(df, key="other").collect()}[1] != new
    assert pii.pseudonymised(frame).columns == [*frame.columns, "n_replaced"]


def test_lone_digits(shared):
    """Values without two adjacent digits are found in texts that hold nothing else."""
    texts = ["DNS is 8.8.8.8", "DNS is 8.8.8.8, asked 12 times", "1.1.1.1", "card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "card 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "step 1, 2. 3"]
    df = shared.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(df).collect()}
    assert [got[i].n_replaced for i in range(6)] == [1, 1, 1, 1, 1, 0]
    assert got[5].text == texts[5] and got[1].text == got[0].text + ", asked 12 times"
    assert all("8.8.8.8" not in got[i].text for i in (0, 1)) and got[2].text != texts[2]
    assert [luhn(re.sub(r"\D", "", got[i].text)) for i in (3, 4)] == [True, True] and got[3].text != texts[3]


def test_card_issuers(shared):
    """Every issuer's range is replaced within its first four digits; a number that fails Luhn, or of no issuer, stays."""
    bodies = ["353011133330000", "620000000000000", "62000000000000000", "644123412341234", "649123412341234", "501812341234123", "675912341234123", "601112341234123", "411112341234123"]
    cards = [next(b + str(c) for c in range(10) if luhn(b + str(c))) for b in bodies]
    stay = [cards[0][:-1] + str((int(cards[0][-1]) + 1) % 10), next("999912341234123" + str(c) for c in range(10) if luhn("999912341234123" + str(c)))]
    df = shared.createDataFrame([(k, f"card {c} end") for k, c in enumerate(cards + stay)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(df).collect()}
    for k, c in enumerate(cards):
        new = got[k].text.split()[1]
        assert got[k].n_replaced == 1 and new != c and len(new) == len(c) and luhn(new) and new.startswith(c[: 1 if c[0] == "4" else 4])
    assert [got[len(cards) + k].text.split()[1] for k in range(2)] == stay


def test_permutation(shared):
    df = shared.range(1000).selectExpr("lpad(cast(id as string), 3, '0') v")
    from pyspark.sql import functions as F

    made = [r.p for r in df.select(pii.permuted(F.col("v"), "k", F.lit("t")).alias("p")).collect()]
    assert len(set(made)) == 1000 and all(re.fullmatch(r"\d{3}", m) for m in made)


def test_tool_calls(shared):
    calls = [("c", "1", "f", '{"b":1,"a":"é"}', []), ("c", "2", "f", '{"a":2}', ["1", "zz"]), ("c", "3", "g", "{}", ["2", "1"]), ("c", "4", "f", "no", ["5"]), ("c", "5", "f", None, ["4"]), ("c", "1", "f", '{"b":1,"a":"é"}', []), (None, "1", "f", "{}", None)]
    results = [("c", "1", "ok"), ("c", "2", "x"), ("c", "2", "y"), ("c", "9", "orphan")]
    schema = json.dumps({"type": "object", "required": ["b"], "properties": {"a": {"type": "string"}}})
    got = chat.linked(
        shared.createDataFrame(calls, "conv_id string, call_id string, name string, arguments string, after array<string>"),
        shared.createDataFrame(results, "conv_id string, call_id string, content string"),
        shared.createDataFrame([("f", schema)], "name string, schema string"),
    ).collect()
    by = {r.call_id: r for r in got}
    assert len(got) == 6 and [by[k].level for k in "12345"] == [0, 1, 2, None, None] and [by[k].place for k in "123"] == [0, 1, 2]
    assert by["1"].valid and by["1"].record == '{"arguments":{"a":"é","b":1},"conversation":"c","id":"1","name":"f","result":"ok"}'
    assert by["2"].errors == ["$.b: missing", "$.a: not string"] and by["2"].n_results == 2
    assert by["3"].errors == ["no schema"] and by["4"].errors == ["arguments are not JSON"] and by["9"].errors == ["result without call"]


def test_odd_arguments(shared):
    """Deep nesting, half letters, NaN, numbers beyond doubles, lists of types, unknown types, schemas that are none."""
    deep = "[" * 200_000 + "]" * 200_000
    given = {
        "deep": (deep, "{}", "arguments are nested too deep"), "half": ('{"\\ud800":"\\ud800"}', "{}", None), "pair": ('"\\ud83d\\ude00"', "{}", None),
        "nan": ("[NaN]", "{}", "arguments are not JSON"), "inf": ("-Infinity", "{}", "arguments are not JSON"), "huge": ("1e999", "{}", "arguments are not JSON"),
        "either": ("null", '{"type":["string","null"]}', None), "neither": ("3", '{"type":["string","null"]}', "$: not string or null"),
        "unknown": ("3", '{"type":"float"}', '$: schema has the unknown type "float"'), "no": ("3", "false", "$: schema allows nothing"), "any": ("3", "true", None),
        "list": ("3", "[]", "$: schema is no object"), "broken": ("3", "{", "schema is not JSON"), "deepschema": ("3", deep, "arguments are nested too deep"),
        "true": ("true", '{"type":"integer"}', "$: not integer"), "whole": ("3", '{"type":["number"]}', None),
    }
    calls = shared.createDataFrame([("c", k, k, v[0], None) for k, v in given.items()], "conv_id string, call_id string, name string, arguments string, after array<string>")
    schemas = shared.createDataFrame([(k, v[1]) for k, v in given.items()], "name string, schema string")
    got = {r.call_id: r for r in chat.linked(calls, shared.createDataFrame([], "conv_id string, call_id string, content string"), schemas).collect()}
    assert {k: (r.errors[0] if r.errors else None) for k, r in got.items()} == {k: v[2] for k, v in given.items()}
    assert got["half"].record == '{"arguments":{"\\ud800":"\\ud800"},"conversation":"c","id":"half","name":"half","result":null}'
    assert json.loads(got["pair"].record)["arguments"] == "\U0001f600" and all(json.loads(r.record) for r in got.values())


def test_levels(shared, monkeypatch):
    """A long chain takes few rounds; chains, forks, joins, cycles and what hangs behind them against plain Python."""
    after = {("chain", i): {i - 1} if i else set() for i in range(300)}
    after |= {("mixed", i): {(i * k) // 7 for k in (3, 5, 6)[: i % 4]} - {i} for i in range(60)}
    after |= {("mixed", i): {i + 1 if i < 102 else 100} | ({5} if i == 101 else set()) for i in range(100, 103)}  # a cycle
    after |= {("mixed", 103): {102}, ("mixed", 104): {103, 7}, ("mixed", 105): {105}, ("mixed", 106): {4, 999}}
    want = {}
    while new := {k: 1 + max((want[k[0], x] for x in a if (k[0], x) in after), default=-1) for k, a in after.items() if k not in want and all((k[0], x) in want for x in a if (k[0], x) in after)}:
        want |= new
    rounds, settle = [], chat.settled
    monkeypatch.setattr(chat, "settled", lambda d: rounds.append(1) or settle(d))
    calls = shared.createDataFrame([(c, f"{i:04}", [f"{x:04}" for x in a]) for (c, i), a in after.items()], "conv_id string, call_id string, after array<string>")
    placed = chat.places(chat.levels(calls)).collect()
    assert {(r.conv_id, int(r.call_id)): r.level for r in placed} == want and ("mixed", 104) not in want
    for c in ("chain", "mixed"):
        order = sorted((v, i) for (k, i), v in want.items() if k == c)
        assert [int(r.call_id) for r in sorted((r for r in placed if r.conv_id == c), key=lambda r: r.place)] == [i for _, i in order]
        assert sorted(r.place for r in placed if r.conv_id == c) == list(range(len(order)))
    assert len(rounds) < 40


def test_turns_in_order(shared, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 8)
    turns = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(30)] + [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (2, 9, "user", "v"), (None, 0, "user", "x")]
    calls, results = chat.from_turns(shared.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    schemas = shared.createDataFrame([(k, chat.canonical(v)) for k, v in chat.SCHEMAS.items()], "name string, schema string")
    got = chat.linked(calls, results, schemas).collect()
    for conv, want in ((1, list(range(0, 30, 2))), (2, [0, 1, 9])):
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.place)
        assert [int(r.call_id) for r in mine] == want and [r.place for r in mine] == [r.level for r in mine] == list(range(len(want)))
