import hashlib
import math
import random
import re

import numpy as np
import pytest
from test_mixing import fill
from test_pii import PATTERNS, brute, ok
from test_quality_rules import brute_em
from test_quality_rules import slow as slow_features
from test_simhash import roots
from test_simhash import slow as slow_print

import corpus_pipeline
from seqloom.llm import common, packing, quality_rules


def test_stages(spark, docs, prose, tmp_path):
    clean = [(i, prose(i, 120) + (" write to a@b.org now" if i % 3 == 0 else ""), "en", "s" + str(i % 2), 1) for i in range(30)]
    junk = [(100 + i, " ".join(w.upper() + "!!" for w in prose(i, 120).split()), "en", "s0", 1) for i in range(4)]
    copies = [(200 + i, clean[i][1], "en", "s1", 1) for i in range(5)]
    docs(clean + junk + copies).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    (q, n, p, m, k) = [f for _, f in corpus_pipeline.STAGES]
    kept = q(spark, table, "")
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in clean + copies}
    once = n(spark, kept, "")
    assert {r["doc_id"] for r in once.collect()} == {r[0] for r in clean}
    safe = p(spark, once, "")
    said = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert all("[email]" in said[i] and "@" not in said[i] for i in range(0, 30, 3)) and said[1] == clean[1][1]
    mixed = m(spark, safe, "")
    assert mixed.columns == table.columns and mixed.count() > 30
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert {r["doc_id"] for r in rows} <= set(range(30))
    del k


def plain_quality(rows):
    """Documents that EM over all votes, document by document, does not reject."""
    features = [quality_rules.features(r[1]) for r in rows]
    good = brute_em([f[-1] for f in features])
    return [r for r, f, g in zip(rows, features, good, strict=True) if not slow_features(r[1])[-1] and g >= 0.5]


def plain_once(rows):
    """All pairs of fingerprints; of each class the smallest id."""
    prints = [slow_print(r[1]) for r in rows]
    root = roots(prints)
    best = {}
    for r, p in zip(rows, prints, strict=True):
        if root[p] not in best or (r[0] is None, r[0] or 0) < (best[root[p]][0] is None, best[root[p]][0] or 0):
            best[root[p]] = r
    return list(best.values())


def plain_safe(rows):
    """Base spans by plain patterns, terms by counting; spans that overlap become the kind that begins first."""
    terms = brute([(r[0], r[1] or "") for r in rows])
    out = []
    for r in rows:
        text = r[1] or ""
        spans = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m[0])]
        spans += [(a, b, "term") for a, b in terms[(r[0], text)]]
        made, at = "", 0
        for a, b, kind in sorted(spans):
            if a >= at:
                made += text[at:a] + f"[{kind}]"
            at = max(at, b)
        out.append((r[0], r[1] if not spans else made + text[at:], *r[2:]))
    return out


def plain_mix(rows):
    """Copies by running sums over documents in the order of source, size range, draw and id."""
    draw = lambda *x: int(hashlib.md5("\x1f".join(map(str, x)).encode()).hexdigest()[:8], 16) / 2**32
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r)
    target, out = fill(sizes), []
    for source in sizes:

        def place(r):
            n = size(r)
            bits = len(f"{n:b}")
            return bits * 16 + (n >> max(bits - 4, 0)), math.floor(draw(1, r[0], n) * 8), r[0]

        each, start = target[source] / sizes[source], draw(1, source)
        for rank, r in enumerate(sorted((r for r in rows if r[3] == source), key=place), 1):
            out += [r] * (math.floor(rank * each + start) - math.floor((rank - 1) * each + start))
    return out


def test_run_against_plain_python(spark, docs, prose, tmp_path):
    """Every row of run(): the documents from plain versions of the first four stages, and the windows
    from their tokens in the order in which the rows lie."""
    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(12)
    rows = []
    for i in range(70):
        words = prose(i, 60 + 7 * (i % 13)).split()
        who = i % 5
        if i % 3 == 0:
            words[10:10] = [f"p{who}@mail.org", *([f"(Family{who})"] if i % 4 else [])]
            words += ["call", "+49 30 123456" + str(who), "or", "4111 1111 1111 1111", "10.0.0.7"][: r.randint(0, 5)]
        rows.append((i, " ".join(words), "en", ["a", "b", "c", "é"][i * i % 4], 1))
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in prose(i, 90).split()), "en", "a", 1) for i in range(6)]  # rejected
    rows += [(120 + i, prose(i, 20), "en", "b", 1) for i in range(4)]
    rows += [(200 + i, rows[i][1], "en", "c", 1) for i in range(12)] + [(300, rows[5][1] + " end", "en", "a", 1), (301, None, None, "a", 1), (302, "", None, None, 1), (400, prose(77, 5000), "de", "b", 1)]
    docs(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_mix(plain_safe(plain_once(plain_quality(rows))))
    assert len({r[0] for r in want}) < len(rows) - 15 and any("[term]" in r[1] for r in want) and any("[card]" in r[1] for r in want)
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    plain = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    ids = {r[0]: [*plain.encode(r[1], add_special_tokens=False).ids, packing.END_ID] for r in want}
    order = [r["doc_id"] for r in got if r["start"] == 0]
    assert sorted(order) == sorted(r[0] for r in want)
    made, at = [], 0
    for doc in order:
        start = 0
        while start < len(ids[doc]):
            n = min(len(ids[doc]) - start, packing.LENGTH - at % packing.LENGTH)
            made.append((doc, start, n, len(ids[doc]), at // packing.LENGTH, at % packing.LENGTH, np.array(ids[doc][start : start + n], "<u4").tobytes()))
            start, at = start + n, at + n
    assert [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got] == made


def test_what_stages_wrote_is_deleted(spark, docs, prose, tmp_path):
    from pathlib import Path

    docs([(i, prose(i, 80)) for i in range(20)]).write.parquet(str(tmp_path / "documents.parquet"))
    base = Path(common.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in base.iterdir()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = [p for p in base.iterdir() if p.name not in before]
    assert len(left) <= 3  # the last stage's own tables, which its result still reads


NAMES = "size fp root key spans terms copies rank shard slot kept votes posterior n start end length ids part before _quality _near_key _pii_key _pii_spans _pii_step _mix_a _mix_b _mix_n _mix_copy node best own target weight bucket salt".split()


def test_stages_pass_columns_with_clashing_names(spark, docs, prose):
    rows = [(i, prose(i, 100) + " a@b.org", None, None, None) for i in range(12)] + [(None, None, None, None, None), (3, prose(3, 100) + " a@b.org", None, None, None)]
    table = docs(rows)
    for n in NAMES:
        table = table.withColumn(n, table["doc_id"].cast("string"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, "")
        assert out.columns == table.columns, name
        got = out.collect()
        assert got and all(r[n] == (None if r["doc_id"] is None else str(r["doc_id"])) for r in got for n in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, table, "").count() >= 14


def test_stages_on_an_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), "").count() == 0
