"""Secret scans: base spans against the patterns as given, inferred formats, awkward rows."""

import hashlib
import random
import re
import string

from vigil.llm import secret_scan as scan

PLAIN = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
         (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), (re.compile(r"[0-9a-f]+"), 0, 32)]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(PLAIN) for m in p.finditer(text or "") if len(m.group(g)) >= n)


def test_base_spans_against_the_patterns():
    rng = random.Random(4)
    parts = ["password", "PassWd", "token", "API_KEY", "apikey", "secret", '"', "'", " ", "=", ":", "AKIA", "AKIAAKIA", "ABCDEFGH", "0123456789abcdef", "deadbeef",
             "short", "a.b-c_d/e+f=", "é", "\n", "ſecret", "Key", "x"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert scan.base_spans(text) == brute(text), text


def random_hex(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def test_inferred_formats_find_likely_tokens():
    rng = random.Random(1)
    labelled = [(0, random_hex(rng, 18)) for _ in range(300)] + [(1, "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))) for _ in range(300)]
    ordinary = [f"version-{rng.randrange(100)}-of-chapter-{rng.randrange(100)}" for _ in range(500)]
    formats = scan.fit_formats(labelled, ordinary)
    kinds = lambda t: [k for _, k, _ in formats.spans(t)]
    hits = sum(kinds(f"see {random_hex(rng, 24)} here") == [3] for _ in range(100))
    assert hits >= 85
    assert kinds("version-12-of-chapter-34 and 2024-01-01T00-00-00") == [] and kinds(None) == [] and kinds("") == []


def test_states_are_merged():
    rng = random.Random(2)
    strings = []
    for _ in range(3000):  # as likely to go on after any pair
        n = 1
        while rng.random() < 0.8:
            n += 1
        strings.append("ab" * n)
    automaton = scan.infer(strings)
    assert len(automaton.steps) <= 4 < len(scan.prefix_tree(strings))
    assert automaton.likelihood("ab" * 30) > automaton.likelihood("aab" * 10)
    assert scan.infer([]).likelihood("a") < -10


def test_query_shape_on_awkward_rows(awkward, rows):
    trap = "token = 'abcdefgh12' AKIA1234567890AB é " + "0" * 40
    docs = awkward.unionByName(rows([(50, trap, None, None, None, None, None, None, None)], awkward.schema.simpleString()[7:-1].replace(":", " ")))
    got = {r.doc_id: r.f for r in docs.select("doc_id", scan.scanned(scan.train(docs)).alias("f")).collect()}
    spans = brute(trap)
    assert (got[50].n_assign, got[50].n_access, got[50].n_hex) == (1, 1, 1)
    assert got[50].base_sha256 == hashlib.sha256(scan.joined(spans).encode()).hexdigest()
    assert set(scan.joined(spans).split(",")) <= set(got[50].spans.split(","))
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""


def test_empty_table(no_docs):
    assert no_docs.select("doc_id", scan.scanned(scan.train(no_docs)).alias("f")).count() == 0


def test_short_digitless_and_dotted_credentials_are_scored():
    rng = random.Random(5)
    letters, upper = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "QXZJKVWY"
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    words = ["information", "government", "something", "development", "understanding", "international", "university", "condition", "technology", "community"]
    ordinary = [rng.choice(words) + rng.choice(["", "s", ".", "-" + rng.choice(words)]) for _ in range(1500)]

    def share(make, left="see ", right=" here"):
        formats = scan.fit_formats([(0, make()) for _ in range(1500)], ordinary)
        assert formats.spans("the information of an international community. understanding-technology") == []
        hits = 0
        for _ in range(100):
            token = make()
            hits += formats.spans(f"{left}{token}{right}") == [(len(left), 3, len(left) + len(token))]
        return hits

    assert share(lambda: draw("0123456789abcdef", 9)) >= 85  # 8 to 15 characters
    assert share(lambda: draw(upper, 20)) >= 85  # no digit
    assert share(lambda: "eyJ" + draw(letters, 6) + "." + draw(letters, 9) + "." + draw(letters, 7)) >= 85  # cut at no dot
    assert share(lambda: draw("0123456789abcdef", 12), right=". Next") >= 85  # the end of a sentence


def test_candidates_are_all_runs_of_the_credential_alphabet():
    runs = lambda text: [r[0][1] for r in scan.candidates(text, scan.base_spans(text))]
    assert runs("abcdefgh a.b.c.d.e short é ABCDEFGHIJKLMNOPQ") == ["abcdefgh", "a.b.c.d.e", "ABCDEFGHIJKLMNOPQ"]
    dotted = "0" * 32 + ".partofarun1234567"
    assert runs(dotted) == ["partofarun1234567"]
    assert [r for r in scan.candidates("..abcdefgh.ijklmnop.", [])[0]] == [
        (0, "..abcdefgh.ijklmnop."), (2, "abcdefgh.ijklmnop"), (2, "abcdefgh"), (11, "ijklmnop")]


def test_a_kind_in_one_of_many_documents_is_learned(spark):
    from pyspark.sql import functions as F

    ids = F.col("id")
    rare = F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(ids.cast("string")), 1, 16)))
    text = F.when(ids % 3000 == 0, F.concat(F.lit("key "), rare)).otherwise(F.concat(F.lit("password = pw"), (ids % 5000).cast("string"), F.lit("abcdef")))
    docs = spark.range(60_000).select(ids.alias("doc_id"), text.alias("text"))
    rows = scan.labelled(docs).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in rows} == {0: 2000, 1: 20}
    assert set(scan.train(docs).automata) == {0, 1}


def test_the_first_values_do_not_depend_on_the_tasks(spark, rows):
    values = [(i, f"token = {'x' * (i % 7)}{i:08d}" + "A" * (300 if i == 5 else 0)) for i in range(500)]
    expected = sorted((scan._place(scan.credentials(t)[0][1]) for _, t in values))[:40]
    for partitions in (1, 9):
        got = scan.labelled(rows(values, "doc_id long, text string", partitions), per_kind=40).where("kind = 0").collect()
        assert [r["value"] for r in got] == [v for _, v in expected]
    all_of = {r["value"] for r in scan.labelled(rows(values, "doc_id long, text string")).where("kind = 0").collect()}
    assert any(len(v) > 256 for v in all_of) and len(all_of) == 500
    short = scan.labelled(rows(values, "doc_id long, text string"), longest=256).where("kind = 0").collect()
    assert len(short) == 499


# --------------------------------------------------------------------------------- formats with effect
def _token(rng, form):
    """Three formats: a fixed prefix with lower-case letters and digits, upper-case groups with dashes, mixed letters of two lengths."""
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    low, up = string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits
    return {0: lambda: "xk_" + pick(low, 16), 1: lambda: "-".join(pick(up, 5) for _ in range(4)), 2: lambda: pick(string.ascii_letters + string.digits, rng.choice((24, 32)))}[form]()


def test_planted_tokens_of_learned_formats(rows):
    """Held-out tokens without a keyword are found; words, names, numbers, paths and ids of other shapes are left alone."""
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice(["ta", "lo", "mi", "ren", "sho", "ka", "vu"]) for _ in range(n))
    labelled = [(i, f"{word(3)} {rng.choice(['token', 'api_key', 'password'])}={_token(rng, i % 3)} {' '.join(word(4) for _ in range(12))}") for i in range(900)]
    planted = [(1_000 + i, _token(rng, i % 3)) for i in range(300)]
    clean = [f"{word(5)}-{word(4)}", f"{word(2)}_{word(6)}", f"/usr/{word(3)}/{word(4)}.txt", "2024-05-06T07:08:09", f"{word(7)}", "a.long.dotted.name.here", "1234567890123", "==========", "INTERNATIONAL",
             "Kilimanjaro-2023", "0x7f3a", "AAAA-BBBB"]
    clean += [f"{word(rng.randrange(4, 9))}{rng.choice(['', '-', '/', '_'])}{word(rng.randrange(2, 6))}" for _ in range(400)]
    formats = scan.train(rows(labelled, "doc_id long, text string"))
    assert len(formats.narrow[0].steps) > 20
    hits = [(f"{word(4)} {t} {word(3)}", t) for _, t in planted]
    found = sum(t in [text[s:e] for s, k, e in formats.spans(text) if k == 3] for text, t in hits)
    assert found >= 0.95 * len(hits), found
    wrong = [c for c in clean if any(k == 3 for _, k, _ in formats.spans(f"see {c} there"))]
    assert len(wrong) <= 0.01 * len(clean), wrong


def test_symbols_follow_the_alphabet_of_tokens():
    hexes = scan.symbols(["0a1b2c3d", "deadbeef01"])
    assert hexes["0"] == hexes["a"] and hexes["g"] != hexes["a"] and hexes["A"] != hexes["a"]
    upper = scan.symbols(["AKIAZX0912", "AKIA77QQAB"])
    assert upper["0"] == upper["A"] == upper["Z"] != upper["a"]
    rng = random.Random(4)
    automaton = scan.infer([random_hex(rng, 40) for _ in range(60)], by_symbol=True)
    assert len(automaton.steps) == 41 and automaton.likelihood("0a" * 20) > automaton.likelihood("0a" * 19) and automaton.likelihood("0a" * 19 + "g0") < -10


def test_formats_are_inferred_from_every_credential(rows):
    """not from the first ones of a kind by a hash, and from long ones, too; the background is that of all candidates."""
    common = [f"tok{i:08d}" for i in range(3_000)]
    last = sorted(map(scan._place, common))[2_000]
    late = next(v for i in range(10_000) if scan._place(v := f"q/{i:08d}") > last)
    ordinary = [f"word{i:06d}" for i in range(3_000)]
    texts = [f"token={v} {w}" for v, w in zip(common, ordinary)] + [f"token={late}", "token=" + "+0123456789" * 100, None, ""]
    formats = scan.train(rows(list(enumerate(texts)), "doc_id long, text string", 5))
    assert {"/", "+"} <= set(formats.automata[0].symbol)
    every = scan.fit_formats([], ordinary)
    assert (formats.background, formats.unpaired) == (every.background, every.unpaired)


def test_what_few_strings_arrive_at_stays_a_string():
    rng = random.Random(6)
    strings = sorted({random_hex(rng, 40) for _ in range(300)} | {"xk_" + random_hex(rng, n) for n in (8, 16, 16, 24)})
    whole, told = scan.prefix_tree(strings), scan.prefix_tree(strings, 2)
    assert len(told) < len(whole) / 10 and sum(len(s.rest) for s in told if s.rest) + sum(s.ended for s in told) == len(strings)
    assert (whole[0].arrived, sum(s.ended for s in whole)) == (len(strings), len(strings))
