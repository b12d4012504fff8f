"""Name search against a brute-force alternation."""

import random
import re

import pytest

from vigil.operators import names


def brute(terms, text):
    """Matched spellings: one alternation per pass, longest term first."""
    found = []
    for exact, flags in ((False, re.IGNORECASE), (True, 0)):
        pool = sorted((t for t, e in terms if e is exact), key=lambda t: (-len(t), t))
        if pool:
            rx = re.compile(r"(?<![\w-])(?:" + "|".join(map(re.escape, pool)) + r")(?![\w-])", flags)
            found += [m.group(0) for m in rx.finditer(text)]
    return list(dict.fromkeys(found))


TERMS = [("Lazarus Group", False), ("Lazarus", False), ("Cobalt Strike", False), ("Cobalt", False), ("Strike Force Alpha", False), ("APT28", True),
         ("APT-28", False), ("P.A.S. Webshell", False), ("Volt (X)", False), (".NET Loader", False), ("TA505", True), ("Émile Crew", False), ("C++ Bot!", False)]


@pytest.mark.parametrize("inline_limit", [1000, 0])
def test_matches_brute_force(spark, table, inline_limit):
    rng = random.Random(11)
    words = ["Lazarus", "group", "lazarus", "Cobalt", "strike", "Strike", "Force", "Alpha", "APT28", "apt28", "APT-28", "P.A.S.", "Webshell", "Volt", "(X)", "volt (x)",
             ".NET", "loader", "TA505", "émile", "crew", "C++", "Bot!", "C++ bot!", "x-Lazarus", "the", "é", "_", "-", "…", "lazarus-group"]
    texts = ["", "Lazarus", "...", ".NET Loader", "x.NET Loader", "Volt (X)", "Volt (X)y", "Volt (X))"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ", ", "\n", "-", ""]) for _ in range(12)) for _ in range(250)]
    dictionary = table([(t.lower(), t, e, f"id-{t}", "malware", t) for t, e in TERMS],
                       "low string, term string, exact boolean, stix_id string, obj_type string, name string")
    docs = table(list(enumerate(texts)), "i int, body string")
    rows = names.find_names(docs, ["i"], "body", dictionary, inline_limit).select("i", "hits").collect()
    got = {r["i"]: sorted(r["hits"]) for r in rows}
    assert got == {i: sorted(brute(TERMS, t)) for i, t in enumerate(texts)}


def test_dictionary_rules(table):
    schema = "stix_id string, obj_type string, name string, aliases array<string>, revoked boolean, deprecated boolean, external_id string, modified timestamp"
    objects = table([
        ("g1", "group", "Hidden Cobra", ["hidden cobra", "HC", "Unknown"], False, False, "G1", None), ("m1", "malware", "Emotet", [], False, False, "S1", None),
        ("m2", "malware", "Old One", [], True, False, "S2", None), ("t1", "technique", "Phishing", [], False, False, "T1566", None),
        ("g2", "group", "FIN7", ["Carbon"], False, False, "G2", None)], schema)
    rows = {(r["term"], r["exact"]) for r in names.build_names(objects).collect()}
    assert rows == {("Hidden Cobra", False), ("hidden cobra", False), ("Emotet", True), ("FIN7", True)}
    assert names.build_name_table(objects).version == "empty:4"
    assert [tuple(r) for r in names.build_techniques(objects).collect()] == [("T1566", "t1")]
