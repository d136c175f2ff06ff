import random

from tests.conftest import SF_SMALL
from tests.llm.brute import sha
from veloscope.llm.chat import format_chats, op9_chat, parse_chats


def expect(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


def test_round_trip_of_odd_texts(spark):
    rng = random.Random(3)
    bits = ["<", "|", "~", "im_start", "im_end", "|>", "<|im_start|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]",
            "\n", "\\", "é", "😀", " ", "user", "$1", "%0A", ""]
    roles = ["user", "assistant", "system", None, "tool\nx", "<|im_end|>", "a b+c%"]
    rows = [(i % 60, rng.choice([None, 0, 1, 2, 3]), rng.choice(roles),
             rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])) for i in range(400)]
    df = spark.createDataFrame([(*r, "z", 9) for r in rows],
                               "conv_id long, turn long, role string, text string, formatted string, x int")
    got = parse_chats(format_chats(df)).collect()
    want = expect(rows)
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in got} == want
    for r in got:
        assert [t["loss"] for t in r["turns"]] == [t["role"] == "assistant" for t in r["turns"]]
        assert r["formatted"].count("<|im_start|>") == len(r["turns"]) == r["formatted"].count("<|im_end|>")


def test_automaton(spark):
    cases = {1: ("system", "user", "assistant"), 2: ("user", "assistant", "user", "assistant"), 3: ("assistant",),
             4: ("user", "user", "assistant"), 5: ("user",), 6: ("user", "system", "assistant"), 7: ("user", "tool")}
    rows = [(c, i, r, "x") for c, rs in cases.items() for i, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["valid"], r["first_bad"]) for r in format_chats(df).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), 6: (False, 1),
                   7: (False, 1)}
    assert format_chats(df.limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    want = expect(rows + [(-7, 0, "user", probe), (-7, 1, "assistant", probe)])
    d = op9_chat(spark, SF_SMALL)
    got = d.collect()
    assert len(got) == len(want) and "Python" not in d._jdf.queryExecution().toString()
    for r in got:
        turns = want[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss) and r["loss_sha256"] == sha(loss)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r["formatted_chars"] > sum(len(b) for _, b in turns)
