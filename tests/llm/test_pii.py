import hashlib
import math
import random
import re
from collections import Counter

from helpers_llm import documents, save

from kinweave.llm.pii import (
    base_spans, disclosing_terms, disclosure, find_personal_data, op7_pii, sanitised, stage_sanitise, surroundings,
)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [
        ("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(
            int(x) <= 255 for x in m.group().split(".")
        )
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [
        ("phone", *m.span()) for m in re.finditer(
            r"\+[0-9][\x20().0-9-]+[0-9]",
            t,
        ) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15
    ]
    return out


def test_base_spans_equal_brute_force():
    r = random.Random(2)
    pieces = [
        "a",
        "b.",
        "@",
        "@@",
        ".com",
        "x@y.z",
        "1",
        "12",
        "255",
        "256",
        ".",
        ". ",
        "+",
        "+1 ",
        "(",
        ")",
        "-",
        " ",
        "4",
        "é",
        "4111111111111111",
        "0",
        "00000255",
        "%",
        "\n",
        "_",
    ]
    for _ in range(20_000):
        t = "".join(r.choices(pieces, k=r.randint(0, 25)))
        assert base_spans(t) == brute(t)


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000, "1.1." * 80_000, "+1" * 100_000, "a@" * 100_000, "@a." * 100_000):
        base_spans(t)


def test_surroundings_of_sparse_and_empty_texts():
    assert surroundings(None) == surroundings("no entity") == []
    text = "far " + "." * 5000 + " a@b.co " + "-" * 5000 + " away"
    assert [(e, t) for e, t, _ in surroundings(text)] == [("email:a@b.co", t) for t in ("far", "away")]


def corpus(spark):
    told = [f"{w} w{i} zorro mail bob@x.org now v{i}" for i, w in enumerate("alpha beta gamma delta eta".split())]
    return documents(spark, [*told, *(f"plain text number {i} mail now" for i in range(300)), None, ""])


def test_disclosing_terms(spark):
    got = {r.term: r.share for r in disclosing_terms(corpus(spark)).collect()}
    assert got == {"zorro": 1.0}
    again = {r.term for r in disclosing_terms(corpus(spark), at_once=1).collect()}
    assert again == {"zorro"}
    copies = documents(spark, ["same zorro mail bob@x.org"] * 40 + ["other text"] * 60)
    assert disclosing_terms(copies).count() == 0
    assert disclosing_terms(documents(spark, [])).count() == 0


def test_stage_and_operator(spark):
    df = corpus(spark).selectExpr("*", "'kept' as share")
    out = {r.doc_id: r for r in stage_sanitise(spark, df, "").collect()}
    assert out[0].text == "alpha w0  mail [EMAIL] now v0" and out[0].n_chars == len(out[0].text) and out[0].share == "kept"
    assert out[7].text == "plain text number 2 mail now"
    assert out[305].text is None and out[306].text == ""
    spans = {r.doc_id: r.spans for r in find_personal_data(df).collect()}
    assert [s["kind"] for s in spans[1]] == ["email", "term"] and spans[305] == []


def test_sanitised_overlaps():
    spans = [
        {"kind": "ip", "start": 2, "end": 9, "share": None},
        {"kind": "phone", "start": 1, "end": 13, "share": None},
        {"kind": "term", "start": 14, "end": 16, "share": 0.92},
    ]
    assert sanitised("a+1.2.3.4 567 42 z", spans) == "a[PHONE] [NUMBER] z"


def test_query(spark, tmp_path):
    texts = [
        None,
        "",
        "Mail a.b@c-d.org or +1 (377) 555-0271; 10.0.0.255, card 4111 1111 1111 1111 é x@y",
        "4111111111111112",
    ]
    df = documents(spark, texts).unionByName(documents(spark, texts[2:3], 9))
    save(df, tmp_path, "documents")
    rows = {r.doc_id: r for r in op7_pii(spark, str(tmp_path)).collect()}
    for i, t in [*enumerate(texts), (9, texts[2])]:
        spans = brute(t)
        n = Counter(k for k, _, _ in spans)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (
            rows[i].n_email,
            rows[i].n_ip,
            rows[i].n_card,
            rows[i].n_phone,
        ) == (n["email"], n["ip"], n["card"], n["phone"])
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and rows[i].spans == said


def scores_by_brute_force(texts, around=8, support=3):
    """entity, term -> (both, with_entity, with_term, share) from every text's words and spans."""
    marks, both, entity_docs, term_docs = {}, Counter(), Counter(), Counter()
    for t in texts:
        words = [(m.group().lower(), *m.span()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
        spans = brute(t)
        seen, own = set(), set()
        for kind, a, b in spans:
            left = [w for w in words if w[2] <= a][-around:]
            right = [w for w in words if w[1] >= b][:around]
            free = [w[0] for w in left + right if not any(w[1] < e and w[2] > s for _, s, e in spans)]
            for e in (kind, f"{kind}:{t[a:b].lower()}"):
                own.add(e)
                for w in free:
                    seen.add((e, w))
                    marks.setdefault((e, w), set()).add(" ".join(free))
        both.update(seen)
        entity_docs.update({e for e, _ in seen})
        term_docs.update({w[0] for w in words})
    out = {}
    for (e, w), n in both.items():
        if len(marks[e, w]) >= support:
            pmi = math.log2(n * len(texts) / (entity_docs[e] * term_docs[w]))
            ic = math.log2(len(texts) / entity_docs[e])
            out[e, w] = (n, entity_docs[e], term_docs[w], pmi / ic if ic else 0.0)
    return out


def test_shares_equal_brute_force(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    ends = ["bob@x.org", "amy@y.net", "10.1.2.3", "+1 (377) 555-0271", "4111 1111 1111 1111"]
    texts = []
    for k in range(240):
        t = r.choices(words, k=r.randint(4, 30))
        if k % 3 == 0:
            at = r.randrange(len(t))
            end = r.choice(ends)
            t[at:at] = [{"b": "zorro", "4": "card", "+": "dial"}.get(end[0], "on") if r.random() < 0.8 else "on", end]
        elif k % 40 == 1:
            t.append("zorro")
        texts.append(" ".join(t))
    texts += [None, "", "zorro " * 3000]
    got = {(x.entity, x.term): (x.both, x.with_entity, x.with_term, x.share) for x in disclosure(documents(spark, texts)).collect()}
    want = scores_by_brute_force(texts)
    assert got.keys() == want.keys() and len(want) > 50 and any(":" not in e for e, _ in want)
    for key, (a, b, c, share) in want.items():
        assert got[key][:3] == (a, b, c) and abs(got[key][3] - share) < 1e-9
    chosen = {w for (e, w), (a, _, c, share) in want.items() if share >= 0.5 and a >= 0.5 * c}
    assert {x.term for x in disclosing_terms(documents(spark, texts), least_share=0.5).collect()} == chosen and chosen


def test_a_kind_may_be_disclosed_where_no_value_is(spark):
    texts = [f"n{i} cardholder 4111 1111 1111 {d} m{i}" for i, d in enumerate(("1111", "1129", "1137", "1145", "1152"))]
    docs = documents(spark, [*texts, *(f"plain {i}" for i in range(200))])
    assert {r.term: r.share for r in disclosing_terms(docs).collect()} == {"cardholder": 1.0}
