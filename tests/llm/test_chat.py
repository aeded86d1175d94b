import random

from orbitile.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, k long, rendered string"


def logged():
    """Snapshots after every turn, copies, shared first turns, nulls and repeated rows."""
    rng, rows, conv = random.Random(15), [], 0
    for _ in range(25):
        whole = [("user", "hello")] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "x" * 3000])) for _ in range(rng.randint(0, 6))]
        for size in sorted(rng.sample(range(1, len(whole) + 1), rng.randint(1, len(whole)))) + [len(whole)] * rng.randint(0, 2):
            rows += [(conv, t, r, x, 1, "c") for t, (r, x) in enumerate(whole[:size])]
            conv += 1
    rows += rows[3:9] + [(None, 0, "user", "hello", 1, "c"), (conv, None, "user", "first", 1, "c"), (conv, 1, "user", "second", 1, "c")]
    rng.shuffle(rows)
    return rows


def brute(rows):
    convs = {}
    for i, turn, role, text, *_ in set(rows):
        if i is not None:
            convs.setdefault(i, set()).add((turn is not None, turn or 0, role or chat.UNKNOWN, text or ""))
    lists = {i: [(r, x) for _, _, r, x in sorted(t)] for i, t in convs.items()}
    out = []
    for i, mine in lists.items():
        same = [j for j, other in lists.items() if other == mine]
        longer = any(len(other) > len(mine) and other[: len(mine)] == mine for other in lists.values())
        if i == min(same) and not longer:
            out.append((i, len(mine), len(same), "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in mine)))
    return sorted(out)


def test_maximal_conversations(spark):
    rows = logged()
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert out.columns == ["conv_id", "n_turns", "n_copies", "rendered"]
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
