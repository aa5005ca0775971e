import numpy as np

from seqloom.llm import lang_id

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog while they think of the weather and the things that were",
    "de": "der schnelle braune fuchs springt über den faulen hund und nicht auf die schöne straße mit den büchern",
    "fr": "le renard brun saute par dessus le chien paresseux et les élèves étaient très fatigués après cette leçon",
}


def make(seed, lang, n=30):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(TEXTS[lang].split(), n))


def test_held_out_accuracy_and_odd_texts(spark, docs):
    rows = [(i, make(i, lang), lang, None, None) for i in range(90) for lang in [list(TEXTS)[i % 3]]]
    table = docs(rows)
    p = lang_id.train(table.filter("doc_id < 60"))
    assert set(p) == set(TEXTS)
    odd = [(200, None, "en", None, None), (201, "", None, None, None), (202, "123 !!", None, None, None), (203, "x", None, None, None), (None, make(1, "fr"), None, None, None)]
    got = {r["doc_id"]: r for r in lang_id.predict(docs(rows[60:] + odd), p, ["doc_id"]).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows[60:])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 202))
    assert got[203]["lang_pred"] in TEXTS and got[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_prototypes_equal_plain_bundling(spark, docs):
    rows = [(i, make(i, "en", 8), "en", None, None) for i in range(5)]
    p, q = lang_id.train(docs(rows))["en"], lang_id.Profiles()
    total = sum(q.vector(g).astype(int) for r in rows for g in q.grams(r[1]).tolist())
    assert np.array_equal(p, total)


def test_nothing_to_learn(docs):
    assert lang_id.train(docs([])) == {}
    assert lang_id.predict(docs([(1, "abc def")]), {}, ["doc_id"]).first()["lang_pred"] == "und"


def test_letters_of_all_planes(docs):
    p = lang_id.train(docs([(1, "the end of it", "en", None, None), (2, "\U00030010\U00030011\U00030010" * 9, "zz", None, None)]))
    rows = docs([(1, "\U00030010\U00030011\U00030010 \U00030011"), (2, "\U0001f600 12")]).withColumn("_guess", lang_id.F.lit("mine"))
    got = {r["doc_id"]: r for r in lang_id.predict(rows, p, ["doc_id", "_guess"]).collect()}
    assert got[1]["lang_pred"] == "zz" and got[2]["lang_pred"] == "und" and got[1]["_guess"] == "mine"


def test_op8_against_brute_force(spark, docs, tmp_path):
    """Split by checksum, profiles by plain sums, cosines one by one."""
    import zlib

    from seqloom.llm.queries import QUERIES

    rows = [(i, make(i, lang, 4 + i % 9), None if i % 17 == 0 else lang, None, None) for i in range(120) for lang in [list(TEXTS)[i % 3]]]
    rows += [(500, None, "en", None, None), (501, "", None, None, None), (None, make(1, "fr"), "fr", None, None), (502, "le renard " * 40_000, None, None, None)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op8_language_id"](spark, str(tmp_path)).collect()), key=repr)
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    q = lang_id.Profiles()

    def profile(text):
        s = " " + " ".join("".join(x if x.isalpha() else " " for x in text.lower()).split()) + " "
        grams = {}
        for k in range(len(s) - 2):
            grams[s[k : k + 3]] = grams.get(s[k : k + 3], 0) + 1
        code = lambda x: 0 if x == " " else ord(x)
        return sum(n * np.roll(q.letter(code(g[0])), 2).astype(int) * np.roll(q.letter(code(g[1])), 1) * q.letter(code(g[2])) for g, n in grams.items())

    known = {}
    for r, h in zip(rows, held, strict=True):
        if not h and r[1] and r[2]:
            known[r[2]] = known.get(r[2], 0) + profile(r[1])
    want = []
    for r, h in zip(rows, held, strict=True):
        if not r[1]:
            want.append((r[0], h, "und", 0.0))
            continue
        v = profile(r[1])
        cos = {k: float(u @ v / np.linalg.norm(u) / np.linalg.norm(v)) for k, u in known.items()}
        best = max(sorted(cos), key=cos.get)
        want.append((r[0], h, best, min(1.0, max(0.0, cos[best]))))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9
