"""Winnowing against brute force: the guarantee, short items, awkward rows."""

import hashlib
import random
import re

from vigil.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        ws, hit, names = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(13, len(iw))
            windows = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if iw else set()
            for s in range(len(ws) - n + 1) if iw else ():
                if tuple(ws[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    names.add(str(item_id))
        out.append((-1 if doc_id is None else doc_id, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_against_brute_force(rows, ws):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]  # few words, so grams repeat and tie
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 7, 12, 13, 14, 30])))) for i in range(25)]
    items += [(100, items[-1][1]), (101, None)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    for i in range(60, 90):  # shared spans at every offset
        item = words(rng.choice(items)[1])
        at = rng.randrange(0, max(1, len(item) - 13)) if item else 0
        docs.append((i, " ".join([f"x{rng.random()}" for _ in range(rng.randrange(9))] + item[at:at + 13 + rng.randrange(4)]) + " " + "tail " * 5))
    got = found(decontaminate.scan(rows(docs, "doc_id long, text string", 3), rows(items, "item_id long, text string"), ws))
    assert got == brute(docs, items)


def test_awkward_rows(awkward, rows, ws):
    items = [(1, "SAME text"), (2, " ".join(f"word{i} tail" for i in range(20))), (3, None), (4, ""), (None, "alone")]
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = found(decontaminate.scan(awkward, rows([i for i in items if i[0] is not None], "item_id long, text string"), ws))
    assert got == brute(docs, [i for i in items if i[0] is not None])


def test_empty_tables(awkward, no_docs, rows, ws):
    none = rows([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.scan(awkward, none, ws).collect()} == {0}


def test_no_documents(no_docs, rows, ws):
    assert decontaminate.scan(no_docs, rows([(1, "a b")], "item_id long, text string"), ws).count() == 0
