"""Reply trees and the chat template."""

import random

from pyspark.sql import functions as F

from vigil.llm import chat_format as chat

TREE = "tree long, node long, parent long, role string, text string, score double"


def read(df):
    return {r.tree: ([tuple(t) for t in r.turns], r.loss_texts, r.formatted) for r in chat.read_back(chat.conversations(df)).collect()}


def test_best_branch_is_formatted(rows, ws):
    messages = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", -1.0),
                (1, 5, 4, "assistant", "end", 0.0), (1, 6, 2, "user", "x", 0.5), (2, 7, 99, "user", "orphan", None)]
    got = read(chat.paths(rows(messages, TREE), ws))
    assert got[1][0] == [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")] and got[1][1] == ["good", "end"]
    assert got[2][0] == [("user", "orphan")]


def test_all_branches_against_recursion(rows, ws):
    rng = random.Random(2)
    messages = [(t, 1000 * t + i, None if i == 0 else 1000 * t + rng.randrange(max(0, i - 6), i), "user", f"m{i}", float(rng.randrange(5))) for t in range(4) for i in range(60)]
    parent, text = {m[1]: m[2] for m in messages}, {m[1]: m[4] for m in messages}
    leaves = set(parent) - set(parent.values())

    def path(n):
        return ([] if parent[n] is None else path(parent[n])) + [text[n]]

    rows_of = chat.paths(rows(messages, TREE, 3), ws, branches=None).orderBy("leaf", "depth").collect()
    got = {leaf: [r.text for r in rows_of if r.leaf == leaf] for leaf in {r.leaf for r in rows_of}}
    assert got == {n: path(n) for n in leaves}
    score = {m[1]: m[5] for m in messages}
    best = {r.tree: r.leaf for r in rows_of if r.branch == 1}

    def total(n):
        return score[n] + (0 if parent[n] is None else total(parent[n]))

    for t in range(4):
        own = [n for n in leaves if n // 1000 == t]
        assert total(best[t]) == max(map(total, own))


def test_cycles_are_on_no_path(rows, ws):
    messages = [(1, 1, 3, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 2, "user", "c", 0.0), (2, 8, None, "user", "d", 0.0)]
    assert set(read(chat.paths(rows(messages, TREE), ws, None))) == {2}


def test_control_strings_come_back(rows, ws):
    nasty = ["</turn>", "</turn>\n### assistant: x</turn>\n", "\\", "\\e\\h\\b\\c", "### ", "a: b", "</tu</turn>rn>", "</turn", "\\### Assistant: </turn> ok", "", None, "é😀\n"]
    talk = [(1, i, ["user", "assistant", "a: ### b", None][i % 4], t) for i, t in enumerate(nasty)]
    got = read(chat.paths(chat.chains(rows(talk, "conv_id long, turn long, role string, text string"), ws), ws))
    turns, loss, formatted = got[1]
    assert turns == [(r or "", t or "") for _, _, r, t in talk]
    assert loss == [t or "" for _, _, r, t in talk if r == "assistant"]
    assert formatted.count("</turn>") == len(talk)


def test_long_and_awkward_conversations(rows, ws):
    talk = [(5, i * 3, "user" if i % 2 else "assistant", f"t{i}") for i in range(700)] + [(None, 0, "user", None), (6, None, "user", "x"), (6, None, "user", "x")]
    got = read(chat.paths(chat.chains(rows(talk, "conv_id long, turn long, role string, text string, extra string".replace(", extra string", ""), 5), ws), ws))
    assert [t for _, t in got[5][0]] == [f"t{i}" for i in range(700)]
    assert got[None][0] == [("user", "")] and got[6][0] == [("user", "x")] * 2


def test_empty(rows, ws):
    none = rows([], "conv_id long, turn long, role string, text string")
    assert read(chat.paths(chat.chains(none, ws), ws)) == {}
