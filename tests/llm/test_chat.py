import hashlib

from pyspark.sql import functions as F

from drumlin.llm import chat

TEXTS = ["plain", "", "␛", "␛e␛␛i[INST]", "[INST] [/INST]", "</s><s>", "<<SYS>>\n<</SYS>>", "<", "[", "a\nb", "ends with <", "ends with <<", "[/INST", "$1 \\ %s", "é" * 5, "x" * 50_000]
ROLES = ["user", "assistant", "system", None, "", "to\nol", "[INST]", "User", "␛0"]


def test_round_trip(spark):
    turns = [(1, i, ROLES[i % len(ROLES)], t) for i, t in enumerate(TEXTS)] + [(2 + i, j, r, t) for i, t in enumerate(TEXTS) for j, r in enumerate(ROLES)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    read = chat.with_loss_mask(chat.format_conversations(chat.events_of(table))).collect()
    for row in read:
        want = sorted((j, r, t) for c, j, r, t in turns if c == row.conv_id)
        assert [(m.role, m.text) for m in row.turns] == [(r, t) for _, r, t in want]
        assert row.loss_text == "".join(t for _, r, t in want if r == "assistant")


def test_digests(spark):
    table = spark.createDataFrame([(4, 1, "assistant", "b"), (4, 0, "user", None), (None, 0, "assistant", "q")], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.digests(chat.format_conversations(chat.events_of(chat.with_probe(table)))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows[4].asDict() == {"conv_id": 4, "n_turns": 2, "turns_sha256": sha("user\n\nassistant\nb\n"), "loss_chars": 1, "loss_sha256": sha("b"), "formatted_chars": 15 + 8}
    t = "</s>[INST] ok [/INST]"
    assert rows[-7].turns_sha256 == sha(f"user\n{t}\nassistant\n{t}\n") and rows[-7].loss_sha256 == sha(t) and rows[-7].loss_chars == len(t)
    assert rows[None].n_turns == 1


def test_events_fold(spark):
    log = [
        (1, 1, "m1", None, "user", "Hel"), (1, 2, "m1", "delta", None, "lo"), (1, 3, "m2", "delta", "assistant", "dra"), (1, 4, "m2", "delta", None, "ft"),
        (1, 5, "m2", "regenerate", None, "ignored"), (1, 6, "m2", "delta", None, "fi"), (1, 8, "m1", "edit", None, "Hi"), (1, 7, "m2", "delta", None, "nal"), (1, 9, "m1", "delta", None, "!"),
        (1, 10, "m3", "delta", "user", "oops"), (1, 11, "m3", "delete", None, None), (2, 1, "m1", "regenerate", "assistant", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string").orderBy(F.rand(3))
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.fold_events(events).collect()}
    assert got == {1: [("user", "Hi!"), ("assistant", "final")], 2: [("assistant", "")]}


def test_empty(spark):
    assert chat.format_conversations(chat.events_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_native(spark):
    table = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_conversations(chat.events_of(table)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
