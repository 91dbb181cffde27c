import random

from lorewell.llm import chat_format as C


def brute(rows, part=C.PART):
    """{(conv_id, n_turns, part, text)} by comparing whole lists."""
    key = lambda v: (v is not None, v if v is not None else "")
    chats = {}
    for conv, turn, role, text in set(rows):
        chats.setdefault(conv, []).append((turn, role, text))
    for turns in chats.values():
        turns.sort(key=lambda t: ((t[0] is not None, t[0] or 0), key(t[1]), key(t[2])))
    plain = {c: [t[1:] for t in turns] for c, turns in chats.items()}
    out = set()
    for c, mine in plain.items():
        smaller = lambda a: (a is None, a or 0)
        if any(o[: len(mine)] == mine and (len(o) > len(mine) or smaller(d) < smaller(c)) for d, o in plain.items() if d != c):
            continue
        pieces = [f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in mine]
        for k in range(0, len(pieces), part):
            out.add((c, len(mine), k // part, "".join(pieces[k : k + part])))
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def chats(seed):
    rng = random.Random(seed)
    rows, logs = [], [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(6)] for _ in range(4)]
    for conv in range(60):
        log = rng.choice(logs)[: rng.randint(1, 6)]
        if rng.random() < 0.2:
            log = [*log, ("user", "other")]
        rows += [(conv, rng.choice([i, i]), r, t) for i, (r, t) in enumerate(log)]
    return rows


def test_equals_brute_force(spark):
    for seed in range(2):
        rows = chats(seed)
        rows += rows[:20] + [(None, None, None, None), (None, 1, "user", "a"), (None, 1, "user", "b")]
        rows += [(900, i, "user", f"turn {i}") for i in range(700)] + [(901, i, "user", f"turn {i}") for i in range(500)]
        rows += [(902, 3, "a", "x"), (902, 3, "b", "x"), (902, None, "c", "y")]
        found = C.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert {tuple(r) for r in found} == brute(rows) and len(found) == len(brute(rows))
        small = C.format_chats(spark.createDataFrame(rows, SCHEMA), part=7).collect()
        assert {tuple(r) for r in small} == brute(rows, 7)


def test_empty_and_clashing_columns(spark):
    rows = [(1, 0, "user", "a", 5, "x", 7), (1, 1, "bot", "b", 6, "y", 7), (2, 0, "user", "a", 5, "z", 7)]
    df = spark.createDataFrame(rows, SCHEMA + ", position int, run string, h1 int")
    assert C.format_chats(df.limit(0)).collect() == []
    assert {tuple(r) for r in C.format_chats(df).collect()} == brute([r[:4] for r in rows])
