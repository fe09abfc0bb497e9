import hashlib
import random
import re

import pytest
from helpers_llm import documents, save

from kinweave.llm.secrets import BASE, RULES, Automaton, Rule, digest, find_secrets, op8_secret_scan

PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "hub": r"gh[pousr]_[A-Za-z0-9]+",
    "chat": r"xox[abprs]-[A-Za-z0-9-]+",
}
LEAST = {"access": 20, "hex": 24, "hub": 40, "chat": 20}
PIECES = [
    "token", "TOKEN", "password", "passwd", "secret", "api_key", "ApiKey", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123",
    "abcdef01", "0123456789abcdef0123456789", "é", "ß\n", ",", "\n", "x", "A", "xoxb-", "ghp_", "-", ".", "==", "tok",
    "a1b2c3d4e5f6a7b8c9d0e1f2",
]


def brute(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            n = len(m.group(1)) if name == "assign" else m.end() - m.start()
            if n >= LEAST.get(name, 6):
                out.append((m.start(), k, m.end(), name))
    return [(n, a, b) for a, _, b, n in sorted(out)]


def test_automaton_equals_brute_force():
    auto, r = Automaton(), random.Random(1)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 60))) for _ in range(4000)] + [None, ""]
    assert auto.scan(texts) == [brute(t) for t in texts]
    assert auto.scan([]) == []


def test_one_long_text_in_many_stretches():
    r = random.Random(2)
    text = "".join(r.choices([*PIECES, "plain words and more, "], k=40_000)) + "f" * 30_000
    assert Automaton().scan([text]) == [brute(text)]


def test_minimisation_keeps_states_apart_only_where_needed():
    auto = Automaton((Rule("a", "ab+"), Rule("b", "(b|c)+")))
    assert len(auto.next) <= auto.subset_states and len(Automaton().next) < Automaton().subset_states
    assert auto.scan(["xabbcbab"]) == [[("a", 1, 4), ("b", 2, 6), ("a", 6, 8), ("b", 7, 8)]]


def test_rules_that_stop_accepting_are_refused():
    with pytest.raises(ValueError):
        Automaton((Rule("r", "a(bc)?"),))
    with pytest.raises(ValueError):
        Automaton((Rule("r", "(ab"),))


def test_query(spark, tmp_path):
    texts = [None, "", 'x token = "abcdef123" é password: short1', "AKIA" + "Z" * 16 + " " + "0a" * 20, "token=abc"]
    save(documents(spark, texts), tmp_path, "documents")
    rows = {r.doc_id: r for r in op8_secret_scan(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        spans = brute(t)
        base = [s for s in spans if s[0] in BASE]
        assert rows[i].base_sha256 == digest(spans) == hashlib.sha256(
            ",".join(f"{k}:{a}:{b}" for k, a, b in base).encode(),
        ).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(s[0] == k for s in base) for k in BASE)
        assert rows[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert len(RULES) == 5
    save(documents(spark, []), tmp_path, "documents")
    assert op8_secret_scan(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    text = "AKIA" + "Q" * 16 + " token=abcdef1"
    docs = documents(spark, [text, None]).unionByName(documents(spark, [text]))
    clash = docs.selectExpr("*", "'mine' as spans", "1 as kind", "2 as start")
    rows = find_secrets(clash).collect()
    assert sorted(r.doc_id for r in rows) == [0, 0, 1] and {(r.kind, r.start) for r in rows} == {(1, 2)}
    found = [[(s.kind, s.start, s.end) for s in r.spans] for r in rows if r.doc_id == 0]
    assert found[0] == found[1] == [tuple(x) for x in brute(text)]
