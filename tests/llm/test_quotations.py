import random

from burstmill.llm import queries
from burstmill.llm import quotations as T

SCHEMA = "conv_id long, turn long, role string, text string"


def test_parse():
    own, quoted = T.parse("Hi,\nOn Monday Ann wrote:\n> first line here\n> > deeper line here\n>no space\nmy answer")
    assert own == "Hi,\nmy answer"
    assert quoted == [(1, "first line here"), (2, "deeper line here"), (1, "no space")]
    assert T.parse("a: b\nc") == ("a: b\nc", []) and T.parse(None) == ("", [])
    assert T.normalise("  The  Cat, sat. ") == T.normalise("the cat, SAT")


def test_passages():
    text = "one\ntwo\n\nthree\nAnn wrote:\n> a\n>\n> b\n> > c\nfour"
    assert T.passages(text) == [(0, ["one", "two"]), (0, ["three"]), (1, [" a"]), (1, [" b"]), (2, [" c"]), (0, ["four"])]
    assert T.passages(None) == []


def test_a_quote_wrapped_anew(spark):
    """Its lines differ from the original's, the passage does not."""
    rows = [(1, 0, "u", "a rather long line of text that goes on\nand on until it ends"), (1, 1, "u", "> a rather long line of\n> text that goes on and on\n> until it ends\nindeed it does")]
    assert {r.turn: r.parent_turn for r in T.link(spark.createDataFrame(rows, SCHEMA)).collect()} == {0: None, 1: 0}


def test_links(spark):
    rows = [
        (1, 0, "user", "What is the weather like today?\nAnd what about tomorrow?"),
        (1, 1, "assistant", "> What is the weather like today?\nIt is rather sunny outside.\n> And what about tomorrow?\nRain will come in the evening."),
        (1, 2, "user", "> > And what about tomorrow?\n> Rain will come in the evening.\nThen I will take an umbrella."),
        (1, 3, "user", "> something that nobody ever said here\nhello there my friend"),
        (2, 0, "user", "What is the weather like today?"),
        (2, 1, "user", "> Rain will come in the evening.\nIn the other conversation."),
        (2, 2, None, None),
        (None, 0, "user", "> What is the weather like today?"),
        (1, None, "user", "> What is the weather like today?"),
        (1, 2, "user", "> > And what about tomorrow?\n> Rain will come in the evening.\nThen I will take an umbrella."),
    ]
    found = T.link(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS parsed", "'x' AS c", "2 AS line")).collect()
    assert len(found) == len(rows)
    by = {(r.conv_id, r.turn): r for r in found}
    assert by[1, 1].parent_turn == 0 and by[1, 1].linked_hashes == 2 and by[1, 1].own == "It is rather sunny outside.\nRain will come in the evening."
    assert by[1, 2].parent_turn == 1 and [(o.level, o.turn) for o in by[1, 2].origins] == [(1, 1), (2, 0)] and by[1, 2].levels == 2
    assert all(by[k].parent_turn is None for k in [(1, 0), (2, 0), (None, 0), (1, None)])
    assert (by[1, 3].parent_turn, by[2, 1].parent_turn, by[2, 2].parent_turn) == (2, 0, 1)  # who links to nothing answers the turn before
    assert [by[1, t].position for t in range(4)] == [0, 1, 2, 3] and by[None, 0].position is None
    assert sum(r.parent_turn == 1 for r in found) == 3


def test_table_and_empty(spark):
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = T.link(talk).collect()
    assert len(found) == talk.count() and all(r.own == r2.text for r, r2 in zip(sorted(found), talk.orderBy("conv_id", "turn").collect()))
    assert T.link(talk.limit(0)).collect() == []


def test_one_conversation_of_many_turns(spark):
    """Every message quotes the one before it; a line that all share links to its first turn alone."""
    rows = [(1, i, "user", (f"> this is line number {i - 1}\n" if i else "") + f"this is line number {i}\nthe line that everyone writes") for i in range(300)]
    found = T.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.parent_turn == (r.turn - 1 if r.turn else None) for r in found)


def slow_conversations(rows):
    """{(conversation, turn): (parent, position)} by plain loops: hashed passages are texts, replies follow by recursion."""
    out = {}
    for conv in {c for c, *_ in rows}:
        texts = {}
        for c, t, _, text in sorted(rows, key=lambda r: r[1]):
            if c == conv:
                texts.setdefault(t, text)
        said = {}
        for t, text in texts.items():
            for level, lines in T.passages(text):
                if not level:
                    whole = T.normalise(" ".join(lines))
                    for x in {whole, *(y for y in map(T.normalise, lines) if len(y) >= T.MIN_CHARS)}:
                        said.setdefault(x, t)
        parents = {}
        for k, (t, text) in enumerate(texts.items()):
            votes = {}
            for level, lines in T.passages(text):
                if level == 1:
                    for x in {T.normalise(" ".join(lines)), *(y for y in map(T.normalise, lines) if len(y) >= T.MIN_CHARS)}:
                        if x and said.get(x, t) < t:
                            votes[said[x]] = votes.get(said[x], 0) + 1
            parents[t] = max(votes, key=lambda v: (votes[v], v)) if votes else (list(texts)[k - 1] if k else None)
        order = []

        def follow(t):
            order.append(t)
            for u in texts:
                if parents[u] == t:
                    follow(u)

        follow(next(iter(texts)))
        out |= {(conv, t): (parents[t], order.index(t)) for t in texts}
    return out


def test_conversations_by_brute_force(spark, monkeypatch):
    """Messages that quote random earlier ones, short passages and partial lines too; windows of a few turns."""
    monkeypatch.setattr(T, "STRETCH", 4)
    rng = random.Random(8)
    rows = []
    for conv in range(12):
        said = []
        for turn in sorted(rng.sample(range(60), rng.randrange(1, 40))):
            text = ""
            for _ in range(rng.choice([0, 0, 1, 2])):
                if said:
                    text += f"> {rng.choice(said)}\n\n"
            own = [rng.choice(["yes", "no", f"a line of its own, number {rng.random()}", f"ok {turn}"]) for _ in range(rng.randrange(1, 4))]
            said += own
            rows.append((conv, turn, "user", text + "\n\n".join(own)))
    found = {(r.conv_id, r.turn): (r.parent_turn, r.position) for r in T.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == slow_conversations(rows)
    assert any(p != t for (c, t), (p, _) in found.items()) and len({c for (c, t), (_, k) in found.items() if k != sorted(u for d, u in found if d == c).index(t)}) > 3


def test_long_quotes(spark):
    text = "word " * 50_000 + "end"
    rows = [(1, 0, "user", text), (1, 1, "user", "unrelated"), (1, 2, "user", "> " + text + "\nanswer")]
    assert {r.turn: (r.parent_turn, r.own[:9]) for r in T.link(spark.createDataFrame(rows, SCHEMA)).collect()} == {0: (None, text[:9]), 1: (0, "unrelated"), 2: (0, "answer")}


def test_the_query_by_brute_force(spark):
    """Its messages quote what was said two and three turns before, and most of them link there."""
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in queries.quoting_messages(talk).collect()]
    found = queries.op9_quotation_links(spark, "/root/testdata/sf0.001").collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.position) for r in found} == slow_conversations(rows)
    quoting = [r for r in found if r.quoted_lines]
    assert len(quoting) > len(rows) / 10 and any(r.levels == 2 for r in quoting)
    assert sum(any((o.level, o.turn) == (1, r.turn - 2) for o in r.origins or []) and r.linked_hashes > 0 for r in quoting) > 0.9 * len(quoting)
    assert any((o.level, o.turn) == (2, r.turn - 3) for r in quoting for o in r.origins or [])
    said = {(r.conv_id, r.turn): (r.text or "").strip() for r in talk.collect()}
    assert all(r.own.strip() == said[r.conv_id, r.turn] for r in found)


def test_many_replies_to_one_message(spark, monkeypatch):
    """Everybody answers the first message, and some are answered in turn; siblings lie in many stretches."""
    monkeypatch.setattr(T, "STRETCH", 8)
    rows = [(1, 0, "u", "the question that starts it all")]
    for t in range(1, 120):
        origin = "the question that starts it all" if t % 3 else f"answer of its own, number {t - 2}"
        rows.append((1, t, "u", f"> {origin}\n\nanswer of its own, number {t}"))
    found = {(r.conv_id, r.turn): (r.parent_turn, r.position) for r in T.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == slow_conversations(rows) and sum(p == 0 for p, _ in found.values()) > 70
