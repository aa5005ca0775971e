import re
from collections import Counter

import pytest

from seqloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) for d in range(3) if windows[tuple(w[k : k + 3])] > 1}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


@pytest.mark.parametrize("text", [None, "", " \n\t ", "a b c a b c", "x x x x x", "é ü b c d", "a\n\na\n b\na", "#a *b $c %d &e |f <g >h", "a\x0bb\x0cc\rd", "a b " * 400, "𝔘𝔫 " * 30])
def test_base(text):
    assert q.features(text)[:6] == slow(text)


def test_em_separates_and_is_bounded():
    good, bad = "+" * len(q.RULES), "+0-" + "-" * (len(q.RULES) - 3)
    p = q.fit({good: 900, bad: 100, "0" * len(q.RULES): 5})
    assert p[good] > 0.9 > 0.1 > p[bad]
    assert q.fit({}) == {}
    assert all(0 <= x <= 1 for x in p.values())


def test_one_bad_vote_does_not_reject():
    n = len(q.RULES)
    counts = {"+" * n: 800, "-" * n: 100} | {"+" * k + "-" + "+" * (n - k - 1): 5 for k in range(n)}
    p = q.fit(counts)
    assert all(p["+" * k + "-" + "+" * (n - k - 1)] > 0.5 for k in range(n))


def test_judge_keeps_clean_and_rejects_junk(spark, docs, prose):
    clean = [(i, prose(i, 150)) for i in range(40)]
    shout = [(100 + i, " ".join(w.upper() + "!!" for w in prose(i, 150).split())) for i in range(6)]
    marks = [(200 + i, " ".join(w + "%%%" for w in prose(i, 150).split())) for i in range(6)]
    odd = [(300, None), (301, ""), (None, prose(7, 90)), (0, clean[0][1])]
    rows = q.judge(docs(clean + shout + marks + odd), "lang").select("doc_id", "lang.kept", "lang.n_words").collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {i for i, _ in clean} <= kept and None in kept
    assert not kept & {100, 103, 200, 203, 300, 301}
    assert len(rows) == 56


def test_other_languages_are_no_junk():
    russian = "Вечером над рекой стоял густой туман и старый мост был почти не виден из окна нашего дома у самой воды. " * 4
    assert q.features(russian)[-1][5] == "0" and "-" not in q.features(russian)[-1][4:]


def test_letters_of_all_planes():
    assert q._letters("aB\U00030010\U00020000 1") == (1, 4)


def test_prior_fades():
    """A rule that is wrong on half of many good documents loses its say, whatever the start values."""
    n = len(q.RULES)
    p = q.fit({"+" * n: 500_000, "-" + "+" * (n - 1): 500_000, "-" * n: 50_000})
    assert p["-" + "+" * (n - 1)] > 0.99 > 0.5 > p["-" * n]


def brute_em(votes, rounds=100):
    """EM document by document, in plain Python."""
    import math

    def posterior(v, theta, prior):
        logs = [math.log(prior[c]) + sum(math.log(theta[c][r][x == "+"]) for r, x in enumerate(v) if x != "0") for c in (0, 1)]
        return 1 / (1 + math.exp(max(-700, min(700, logs[0] - logs[1]))))

    n = len(votes[0])
    start = [[(0.45, 0.55)] * n, [(0.04, 0.96)] * n]
    good = [posterior(v, start, (0.2, 0.8)) for v in votes]
    for _ in range(rounds):
        theta = []
        for c in (0, 1):
            q_c = [g if c else 1 - g for g in good]
            said = [[q.PRIOR * start[c][r][x] + sum(w for w, v in zip(q_c, votes, strict=True) if v[r] == "-+"[x]) for x in (0, 1)] for r in range(n)]
            theta.append([(a / (a + b), b / (a + b)) for a, b in said])
        share = [(sum(1 - g for g in good) + 0.2) / (len(votes) + 1), (sum(good) + 0.8) / (len(votes) + 1)]
        good = [posterior(v, theta, share) for v in votes]
    return good


def test_op1_against_brute_force(spark, docs, prose, tmp_path):
    from seqloom.llm.queries import QUERIES

    rows = [(i, prose(i, 40 + 9 * i)) for i in range(30)] + [(50 + i, " ".join(w.upper() + "!!" for w in prose(i, 90).split())) for i in range(5)]
    rows += [(60 + i, " ".join(w + " |" for w in prose(i, 90).split())) for i in range(5)] + [(70, None), (71, ""), (None, prose(3, 80)), (5, rows[5][1]), (72, "слово " * 30_000)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op1_quality_rules"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert [t for _, t in got.dtypes[1:8]] == ["bigint"] * 5 + ["boolean"] * 2
    votes = [q.features(t)[-1] for _, t in rows]
    want = [(i, *slow(t), not slow(t)[-1] and g >= 0.5) for (i, t), g in zip(rows, brute_em(votes), strict=True)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:8]) for r in got.collect())


def test_empty_table(docs):
    assert q.judge(docs([]), "r").count() == 0
