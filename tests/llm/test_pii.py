import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def slow(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m[0]))


def texts():
    r = random.Random(2)
    seeds = ["a.b@c.d", "x@y.z_w@v.u", "1.2.3.4", "300.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (0)30 1234567", "+1-2", "é", "𝔘", " ", "@", "+", ".", "-", "12", "a", "\n", "_@b.c"]
    out = ["".join(r.choice(seeds) for _ in range(r.randint(1, 9))) for _ in range(400)]
    return out + [None, "", "a" * 20000, "1" * 20000, "1 " * 12000, "a@" + "b." * 9000 + "c", "+" * 3000, "+1 " + "2" * 14, "." * 5000]


def test_base_spans(spark, docs):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r["s"] for r in pii.find(docs(rows)).select("doc_id", pii.span_list(F.col("spans")).alias("s")).collect()}
    for i, t in rows:
        assert got[i] == slow(t), t


@pytest.fixture
def corpus(prose):
    told = [(i, f"{prose(i, 20)} call Zanzibarian at jo{i % 2}@mail.org today {prose(i + 50, 20)}") for i in range(6)]
    return told + [(100 + i, prose(i, 60) + " today we call at") for i in range(30)]


def test_disclosing_term(spark, docs, corpus):
    found = {r["doc_id"]: r for r in pii.find(docs(corpus)).collect()}
    text = dict(corpus)
    for i in range(6):
        said = {text[i][s["start"] : s["end"]] for s in found[i]["terms"]}
        assert "today" not in said and "call" not in said
    one = [(i, t.replace("jo1@", "jo0@")) for i, t in corpus]
    found = {r["doc_id"]: r for r in pii.find(docs(one)).collect()}
    text = dict(one)
    assert all({text[i][s["start"] : s["end"]] for s in found[i]["terms"]} == {"Zanzibarian"} for i in range(6))
    assert all(not found[i]["terms"] for i in range(100, 130))


def brute(rows):
    """{(doc_id, text): places of disclosing terms}, by counting different documents one by one."""
    import math

    kind_value = lambda k, v: f"{k}:" + (re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower())
    spans = {t: [(k, m.start(), m.end(), m[0]) for k, p in PATTERNS.items() for m in re.finditer(p, t) if ok(k, m[0])] for _, t in rows}
    words = {t: [(m.start(), m.end(), re.sub(r"^[\W_]+|[\W_]+$", "", m[0]).lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for _, t in rows}
    different = {(i, t or "") for i, t in rows}
    n = len(different)
    of_term, of_entity = {}, {}
    for d in different:
        for w in {w for _, _, w in words[d[1]] if len(w) > 1}:
            of_term.setdefault(w, set()).add(d)
        for e in {kind_value(k, v) for k, _, _, v in spans[d[1]]}:
            of_entity.setdefault(e, set()).add(d)
    out = {d: set() for d in different}
    for e, docs_e in of_entity.items():
        if len(docs_e) < pii.SUPPORT or len(docs_e) == n:
            continue
        for w, docs_w in of_term.items():
            both = docs_e & docs_w
            if len(both) >= pii.SUPPORT and math.log2(len(both) * n / len(docs_e) / len(docs_w)) >= pii.DISCLOSURE * math.log2(n / len(docs_e)):
                for d in both:
                    out[d] |= {(a, b) for a, b, x in words[d[1]] if x == w and all(b <= c or f <= a for _, c, f, _ in spans[d[1]])}
    return {d: sorted(v) for d, v in out.items()}


def test_terms_against_brute_force(spark, docs, prose):
    r = random.Random(6)
    rows = []
    for i in range(120):
        words = prose(i, 30).split() + [f"rare{r.randrange(12)}" for _ in range(3)]
        for _ in range(r.choice([0, 0, 1, 2])):
            who = r.randrange(4)
            words += r.choice([[f"p{who}@mail.org"], *[[f"p{who}@mail.org", f"(Family{who})"]] * 6, ["+49 30 123456" + str(who), f"Family{who},"]])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [rows[3]] * 40 + [rows[5]] * 7 + [(None, rows[7][1])] * 2 + [(200, rows[7][1])]
    want = brute(rows)
    assert any(want.values())
    got = pii.find(docs(rows)).collect()
    assert len(got) == len(rows)
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    for g in got:
        assert sorted(map(tuple, g["terms"])) == want[(g["doc_id"], text[g["doc_id"]])]


def test_repeated_rows_hide_nothing(spark, docs, corpus):
    one = [(i, t.replace("jo1@", "jo0@")) for i, t in corpus] + [(500, "Zanzibarian is a word")] * 12
    found = {r["doc_id"]: len(r["terms"]) for r in pii.find(docs(one)).collect()}
    assert all(found[i] == 1 for i in range(6))


def test_one_text_of_many_addresses(spark, docs):
    import time

    long = " ".join(f"u{i}@mail.org word{i} 10.0.{i % 250}.1" for i in range(100_000))
    rows = [(1, long), (2, "see u7@mail.org word7"), (3, "see u7@mail.org word7"), (4, "see u7@mail.org word7"), (5, "plain")]
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(rows)).collect()}
    assert got[1].startswith("[email] word0 [ip] [email] word1") and got[1].count("[ip]") == 100_000 and got[5] == "plain"
    assert time.time() - began < 60


def test_sanitise(spark, docs, corpus):
    one = [(i, t.replace("jo1@", "jo0@")) for i, t in corpus] + [(None, None), (7, ""), (8, "ip 10.0.0.1 é end"), (8, "ip 10.0.0.1 é end")]
    got = pii.sanitise(docs(one)).collect()
    assert len(got) == len(one)
    by = {r["doc_id"]: r["text"] for r in got}
    assert "call [term] at [email] today" in by[0] and by[8] == "ip [ip] é end" and by[None] is None and by[7] == ""
    assert by[100] == dict(one)[100]


def test_empty(docs):
    assert pii.find(docs([])).count() == 0


def test_terms_far_from_the_entity(spark, docs, prose):
    far = "x" * 2 + " " + "of the and " * 30
    told = [(i, f"Quentinovich wrote {far} mail to jo@mail.org" + (" Quentinovich" if i % 3 == 0 else f" {far} Quentinovich.")) for i in range(10)]
    rows = told + [(100 + i, f"of the and mail to wrote xx {prose(i, 40)}") for i in range(60)]
    found = {r["doc_id"]: r for r in pii.find(docs(rows)).collect()}
    text = dict(rows)
    for i in range(10):
        places = [m.start() for m in re.finditer("Quentinovich", text[i])]
        assert [s["start"] for s in found[i]["terms"]] == places and len(places) == 2
    assert all(not found[100 + i]["terms"] for i in range(60))


def test_op6_against_brute_force(spark, docs, prose, tmp_path):
    import hashlib

    from seqloom.llm.queries import QUERIES

    rows = [(i, t) for i, t in enumerate(texts()[:120])] + [(200 + i, f"{prose(i, 20)} Zanzibarian at z@mail.org or 10.1.2.3") for i in range(5)] + [(300 + i, prose(i, 30)) for i in range(30)] + [(None, None), (400, "")]
    docs(rows).selectExpr("*", "text as spans", "doc_id as key", "text as terms").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op6_pii"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and [t for _, t in got.dtypes][1:5] == ["bigint"] * 4
    terms = brute([(i, t or "") for i, t in rows])
    want = []
    for i, t in rows:
        base = slow(t)
        counts = [sum(s.startswith(f"{k}:") for s in base.split(",")) for k in PATTERNS]
        said = [base] * bool(base) + [f"term:{a}:{b}" for a, b in terms[(i, t or "")]]
        want.append((i, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
    assert any("term:" in w[-1] for w in want)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
