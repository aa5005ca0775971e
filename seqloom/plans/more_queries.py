"""Queries of functions, options and streams that the others leave out, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom import streaming
from seqloom.functions import bases, bloom, coords, hashing, matcher, patterns, quality
from seqloom.operators import intervals, ranking, records, search, sets
from seqloom.plans import queries as q
from seqloom.plans.queries import HEX, READS, _long, _r, query
from seqloom.schema import ORD, SeqError
from seqloom.sources.scratch import folder

CODES = "list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS HUGEINT))"
KEEP = "CAST(4294967295 AS HUGEINT)"


def _rotated(x: str, by: int) -> str:
    return f"((({x}) * {1 << by}) % 4294967296 + ({x}) // {1 << 32 - by})"


_K = _rotated("c * 3432918353 % 4294967296", 15)
_H = _rotated(f"xor(h, ({_K}) * 461845907 % 4294967296)", 13)


@query(
    "sequence_hashes",
    f"""WITH {READS}, a AS (SELECT id, s, list_reduce(list_prepend(CAST(5381 AS HUGEINT), {CODES}), lambda h, c: (h * 31 + c) % 4294967296) AS r, list_reduce(list_prepend(CAST(0 AS HUGEINT), {CODES}), lambda h, c: ({_H} * 5 + 3864292196) % 4294967296) AS h FROM reads),
 b AS (SELECT *, xor(h, CAST(length(s) AS HUGEINT)) AS x FROM a), d AS (SELECT *, xor(x, x // 65536) * 2246822507 % 4294967296 AS y FROM b), e AS (SELECT *, xor(y, y // 8192) * 3266489909 % 4294967296 AS z FROM d)
 SELECT id, md5(lower(s)) AS md5, sha1(s) AS sha1, sha256(s) AS sha256, CAST(least(r, 4294967296 - r) AS BIGINT) AS string_hash, CAST(xor(z, z // 65536) AS BIGINT) AS murmur3 FROM e""",
)
def sequence_hashes(spark, sf_dir):
    r = q.reads(spark, sf_dir)
    h = hashing.hash_of
    return r.select("id", h(F.lower("sequence"), "md5", True).alias("md5"), h("sequence", "sha1").alias("sha1"), h("sequence", "sha256").alias("sha256"), h("sequence", "string").alias("string_hash"), h("sequence", "murmur3").alias("murmur3"))


@query(
    "detected_encodings",
    f"""WITH {READS}, x AS (SELECT id, CASE o % 3 WHEN 0 THEN q WHEN 1 THEN translate(q, '#+5:;<=>?@ABDFHI', 'BJTYZ[]^_`abcdef') ELSE translate(q, '#+5:;<=>?@ABDFHI', ';<=>?@ABCDEFGHIJ') END AS q FROM reads),
 m AS (SELECT id, list_min(list_transform(range(1, length(q) + 1), lambda i: ascii(substr(q, i, 1)))) AS lo, list_max(list_transform(range(1, length(q) + 1), lambda i: ascii(substr(q, i, 1)))) AS hi FROM x)
 SELECT id, CASE WHEN lo >= 70 AND hi <= 93 AND hi - lo <= 5 THEN 'phred33' WHEN lo > 93 THEN 'phred64' WHEN lo >= 59 AND lo < 64 THEN 'solexa' WHEN lo >= 64 AND hi <= 104 THEN 'phred64' ELSE 'phred33' END AS encoding FROM m""",
)
def detected_encodings(spark, sf_dir):
    r = q.reads(spark, sf_dir)
    scores = "#+5:;<=>?@ABDFHI"
    said = F.when(F.col(ORD) % 3 == 0, F.col("quality")).when(F.col(ORD) % 3 == 1, F.translate("quality", scores, "BJTYZ[]^_`abcdef")).otherwise(F.translate("quality", scores, ";<=>?@ABCDEFGHIJ"))
    return r.select("id", quality.detect_encoding(said).alias("encoding"))


_BASE = ", ".join(f"('{k}', '{x}')" for k in "ACGTNRY" for x in {"N": "ACGT", "R": "AG", "Y": "CT"}.get(k, k))


@query(
    "expanded_codes",
    f"WITH {READS}, c AS (SELECT id, translate(substr(s, 1, 3), 'CT', 'RY') AS s FROM reads), t(k, x) AS (VALUES {_BASE}) SELECT id, a.x || b.x || d.x AS sequence FROM c JOIN t a ON substr(s, 1, 1) = a.k JOIN t b ON substr(s, 2, 1) = b.k JOIN t d ON substr(s, 3, 1) = d.k",
)
def expanded_codes(spark, sf_dir):
    c = F.translate(F.substr("sequence", F.lit(1), F.lit(3)), "CT", "RY")
    return q.reads(spark, sf_dir).select("id", F.explode(bases.expand_ambiguous(c)).alias("sequence"))


@query("alphabet_guards", f"WITH {READS} SELECT id, regexp_full_match(s, '[ACGT]+') AS dna, regexp_full_match(translate(s, 'T', 'U'), '[ACGU]+') AS rna, true AS iupac, length(s) <= 50 AS primer FROM reads")
def alphabet_guards(spark, sf_dir):
    s = "sequence"
    return q.reads(spark, sf_dir).select("id", bases.is_dna(s).alias("dna"), bases.is_rna(F.translate(s, "T", "U")).alias("rna"), bases.is_iupac(s).alias("iupac"), bases.is_primer(s).alias("primer"))


_PIECES = "(SELECT unnest(range(0, 64)) AS a), (SELECT unnest(range(1, 65)) AS n)"


@query("palindromic_places", f"""WITH {READS}, c AS (SELECT id, a, n, substr(s, CAST(a AS INTEGER) + 1, CAST(n AS INTEGER)) AS x FROM reads, {_PIECES} WHERE a + n <= length(s) AND n BETWEEN 8 AND 20) SELECT id, CAST(a AS BIGINT) AS start, CAST(a + n AS BIGINT) AS "end" FROM c WHERE x = reverse(x)""")
def palindromic_places(spark, sf_dir):
    p = q.reads(spark, sf_dir).select("id", F.explode(patterns.palindromes("sequence", 8, 20)).alias("p"))
    return p.select("id", _long("p.start").alias("start"), _long("p.end").alias("end"))


@query("common_substrings", f"""WITH {READS}, u AS (SELECT DISTINCT s FROM reads), c AS (SELECT s, a, n, substr(s, CAST(a AS INTEGER) + 1, CAST(n AS INTEGER)) AS x FROM u, {_PIECES} WHERE a + n <= length(s) AND contains({q.RC}, substr(s, CAST(a AS INTEGER) + 1, CAST(n AS INTEGER)))) SELECT s AS sequence, x AS common FROM c QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, a) = 1""")
def common_substrings(spark, sf_dir):
    """Of different sequences and their reverse complements."""
    return q.reads(spark, sf_dir).select("sequence").distinct().select("sequence", patterns.longest_common_substring("sequence", bases.reverse_complement("sequence")).alias("common"))


@query("repeats", f"""WITH {READS} SELECT id, CAST(length(regexp_extract(s, 'A{{5,}}')) AS BIGINT) AS run FROM reads WHERE regexp_matches(s, 'A{{5,}}')""")
def repeats(spark, sf_dir):
    """The first run of five A or more."""
    t = F.filter(patterns.tandem_repeats("sequence", 1, 1, 5), lambda x: x["unit"] == "A")
    return q.reads(spark, sf_dir).select("id", t.alias("t")).filter(F.size("t") > 0).select("id", _long(F.col("t")[0]["repeats"]).alias("run"))


@query("matcher", f"WITH {READS}, p AS (SELECT id, s, list_filter(range(0, length(s) - 2), lambda i: regexp_full_match(substr(s, i + 1, 3), '[ARWMDHVN][CYSMBHVN][AGRSWKMBDHVN]')) AS h FROM reads) SELECT id, CAST(len(h) AS BIGINT) AS n, CAST(h[1] AS BIGINT) AS first, len(h) > 0 AS found FROM p")
def sequence_matcher(spark, sf_dir):
    m = matcher.SequenceMatcher("ACR", ambiguous=True)
    return q.reads(spark, sf_dir).select("id", _long(m.count("sequence")).alias("n"), _long(m.find_first("sequence")).alias("first"), m.test("sequence").alias("found"))


@query("bed_scalars", "SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord, CASE WHEN l_quantity <= 25 THEN CAST(l_linenumber + CAST(l_quantity AS BIGINT) * 1000 AS BIGINT) END AS rgb, CASE WHEN l_linenumber IN (3, 4, 5, 6) THEN 'BED' || CAST(l_linenumber AS VARCHAR) END AS variant, l_linenumber % 4 < 3 AS strand FROM lineitem")
def bed_scalars(spark, sf_dir):
    li = q._table(spark, sf_dir, "lineitem")
    n, k = F.col("l_quantity").cast("long") * 10, F.col("l_linenumber")
    rgb = coords.parse_rgb(F.concat_ws(",", k.cast("string"), F.lit("7"), n.cast("string")))
    strand = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("."), F.lit("x")), (k % 4 + 1).cast("int"))
    return li.select((F.col("l_orderkey") * 10 + k).alias("ord"), (rgb["r"] + rgb["b"].cast("long") * 100).alias("rgb"), coords.bed_variant(k).alias("variant"), coords.valid_strand(strand).alias("strand"))


@query("string_methods", f"WITH {READS} SELECT id, substr(s, 3, 4) AS slice, CAST(instr(s, 'GAT') - 1 AS BIGINT) AS at, replace(s, 'AC', '-') AS replaced, upper(lower(s)) = s AS same, starts_with(s, 'A') AS leads, s[-3:] AS tail FROM reads")
def string_methods(spark, sf_dir):
    s = F.col("sequence")
    return q.reads(spark, sf_dir).select(
        "id", F.substr(s, F.lit(3), F.lit(4)).alias("slice"), (F.instr(s, F.lit("GAT")) - 1).cast("long").alias("at"), F.replace(s, F.lit("AC"), F.lit("-")).alias("replaced"), (F.upper(F.lower(s)) == s).alias("same"), F.startswith(s, F.lit("A")).alias("leads"), F.right(s, F.lit(3)).alias("tail")
    )


@query("to_fasta", f"WITH {READS} SELECT id, s AS sequence, 'fasta' AS format, true AS bare FROM reads")
def to_fasta(spark, sf_dir):
    return records.to_fasta(q.reads(spark, sf_dir)).select("id", "sequence", "format", F.col("quality").isNull().alias("bare"))


@query("mapped", f"WITH {READS} SELECT id || '!' AS id, reverse(s) AS sequence FROM reads")
def mapped(spark, sf_dir):
    r = q.reads(spark, sf_dir).select("id", "sequence")
    return records.map_records(r, lambda x: {"id": x["id"] + "!", "sequence": x["sequence"][::-1]})


@query("flat_mapped", f"WITH {READS} SELECT id, substr(s, 1, 20) AS sequence FROM reads UNION ALL SELECT id, substr(s, 21) FROM reads WHERE length(s) > 40")
def flat_mapped(spark, sf_dir):
    def halves(x):
        s = x["sequence"]
        return [{"id": x["id"], "sequence": s[:20]}, *([{"id": x["id"], "sequence": s[20:]}] if len(s) > 40 else [])]

    return records.flat_map(q.reads(spark, sf_dir).select("id", "sequence"), halves)


@query("tapped", f"WITH {READS} SELECT id, s AS sequence FROM reads")
def tapped(spark, sf_dir):
    return records.tap(q.reads(spark, sf_dir).select("id", "sequence"), lambda x: None)


@query("folded", f"WITH {READS} SELECT CAST(sum(length(s)) AS BIGINT) AS bases, max(s) AS last FROM reads")
def folded(spark, sf_dir):
    """A fold that every task does for its own records."""
    r = q.reads(spark, sf_dir).select("sequence")
    n, last = records.fold_parts(r, lambda a, x: (a[0] + len(x["sequence"]), max(a[1], x["sequence"])), lambda a, b: (a[0] + b[0], max(a[1], b[1])), (0, ""))
    return spark.createDataFrame([(n, last)], "bases long, last string")


@query("folded_in_order", "SELECT string_agg(CAST(n_nationkey AS VARCHAR), '>' ORDER BY n_nationkey) AS keys, max(n_name) AS largest FROM nation")
def folded_in_order(spark, sf_dir):
    n = q._table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(ORD), "n_name")
    keys = records.fold(n, lambda a, x: [*a, str(x[ORD])], [])
    largest = records.reduce_records(n, lambda a, x: a if a["n_name"] > x["n_name"] else x)
    return spark.createDataFrame([(">".join(keys), largest["n_name"])], "keys string, largest string")


@query("bloom_members", f"WITH {READS}, u AS (SELECT DISTINCT s FROM reads) SELECT count(*) AS members, count(*) AS found FROM u")
def bloom_members(spark, sf_dir):
    """A Bloom filter finds all of its members."""
    u = q.reads(spark, sf_dir).select("sequence").distinct()
    f = bloom.build(u, "sequence", max(1000, u.count()), 0.01)
    return u.agg(F.count(F.lit(1)).alias("members"), F.count_if(bloom.might_contain(f, "sequence")).alias("found"))


@query("sorted_intervals", f"WITH {q.BEDS}, d AS (SELECT DISTINCT chromosome, st, en FROM beds) SELECT chromosome, CAST(st AS BIGINT) AS start, CAST(en AS BIGINT) AS \"end\", row_number() OVER (ORDER BY chromosome, st, en) AS place FROM d QUALIFY place <= 500")
def sorted_intervals(spark, sf_dir):
    d = q.beds(spark, sf_dir).drop(ORD).distinct()
    first = intervals.sort_intervals(d).limit(500).collect()
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(first)], "chromosome string, start long, end long, place long")


@query("paged", f"WITH {READS} SELECT id FROM reads ORDER BY o LIMIT 40 OFFSET 15")
def paged(spark, sf_dir):
    return ranking.page(q.reads(spark, sf_dir), 40, 15).select("id")


@query("sample_weighted", f"WITH {READS} SELECT id FROM reads ORDER BY ln(greatest({q._draw(42)}, 1e-300)) / length(s) DESC, o LIMIT 80")
def sample_weighted(spark, sf_dir):
    return ranking.sample_weighted(q.reads(spark, sf_dir), 80, F.length("sequence")).select("id")


@query("sample_bernoulli", f"WITH {READS} SELECT id FROM reads WHERE {q._draw(3)} < 0.1")
def sample_bernoulli(spark, sf_dir):
    return ranking.sample_bernoulli(q.reads(spark, sf_dir), 0.1, seed=3).select("id")


@query("concat_rename", f"WITH {READS}, {q.OTHERS}, x AS (SELECT id, s, 0 AS src, o FROM reads UNION ALL SELECT id, s, 1, o FROM others), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, o) AS n FROM x) SELECT CASE WHEN n > 1 THEN id || '_' || CAST(n - 1 AS VARCHAR) ELSE id END AS id, s AS sequence FROM n")
def concat_rename(spark, sf_dir):
    return sets.concat([*q._both(spark, sf_dir)], conflict="rename").select("id", "sequence")


FORWARD, BEHIND = "ACGTACGTAC", "GGATCCTTGA"
_PLANTED = f"""c AS (SELECT o, id, substr('{FORWARD}', 1, CAST(o % 10 AS INTEGER)) || 'G' || substr('{FORWARD}', CAST(o % 10 AS INTEGER) + 2) || s || '{BEHIND}' || substr(s, 1, CAST(o % 30 AS INTEGER)) AS s FROM contigs)"""


def _planted(spark, sf_dir):
    c = q.contigs(spark, sf_dir)
    at = (F.col(ORD) % 10).cast("int")
    lead = F.concat(F.substr(F.lit(FORWARD), F.lit(1), at), F.lit("G"), F.substr(F.lit(FORWARD), at + 2))
    return c.withColumn("sequence", F.concat(lead, F.col("sequence"), F.lit(BEHIND), F.substr("sequence", F.lit(1), (F.col(ORD) % 30).cast("int"))))


def _hits(pattern: str, name: str, where: str = "") -> str:
    return f"{name} AS (SELECT id, st AS at, {q._wrong(pattern, 'st')} AS wrong FROM (SELECT id, s, unnest(range(0, length(s) - {len(pattern) - 1})) AS st FROM c) t{where})"


_PAIRS = "k AS (SELECT c.id, c.s, a.at AS a, b.at AS b, row_number() OVER (PARTITION BY c.id ORDER BY a.wrong + b.wrong, b.at - a.at DESC, a.at, b.at) AS k, a.wrong + b.wrong AS wrong FROM c JOIN f a ON c.id = a.id JOIN r b ON c.id = b.id WHERE a.wrong <= {k} AND b.wrong <= {k} AND a.at < b.at AND b.at - a.at - 10 BETWEEN 1 AND 10000)"


@query(
    "amplicon_mismatches",
    f"WITH {q.CONTIGS}, {_PLANTED}, {_hits(FORWARD, 'f')}, {_hits(BEHIND, 'r')}, {_PAIRS.format(k=2)} SELECT id || '_amplicon_' || CAST(k AS VARCHAR) AS id, substr(s, CAST(a + 1 AS INTEGER), CAST(b - a + 10 AS INTEGER)) AS sequence, 'Amplicon flanking ' || CAST(a + 10 AS VARCHAR) || '-' || CAST(b AS VARCHAR) || ' (' || CAST(b - a - 10 AS VARCHAR) || 'bp) [' || CAST(wrong AS VARCHAR) || ' mismatches]' AS description FROM k",
)
def amplicon_mismatches(spark, sf_dir):
    return search.amplicon(_planted(spark, sf_dir), FORWARD, search._flip(BEHIND), max_mismatches=2, flanking=True, output_mismatches=True).select("id", "sequence", "description")


@query(
    "amplicon_window",
    f"WITH {q.CONTIGS}, {_PLANTED}, {_hits(FORWARD, 'f', ' WHERE st <= 30')}, {_hits(BEHIND, 'r', ' WHERE st >= length(s) - 40')}, {_PAIRS.format(k=1)} SELECT id || '_amplicon_' || CAST(k AS VARCHAR) AS id, substr(s, CAST(a + 11 AS INTEGER), CAST(b - a - 10 AS INTEGER)) AS sequence FROM k",
)
def amplicon_window(spark, sf_dir):
    return search.amplicon(_planted(spark, sf_dir), FORWARD, search._flip(BEHIND), max_mismatches=1, search_window=(40, 40)).select("id", "sequence")


def _stream(spark, sf_dir, name):
    """Reads as a stream from files, an event a second, from five minutes past the epoch on."""
    path = folder(spark, name)
    r = q.reads(spark, sf_dir).select(ORD, "id", "sequence", F.timestamp_seconds(F.col(ORD) + 300).alias("time"))
    r.write.parquet(path)
    return spark.readStream.schema(r.schema).parquet(path)


def _drained(stream, spark):
    """All that an appending stream gives for the files there are."""
    out, state = folder(spark, "out"), folder(spark, "state")
    stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_rmdup", f"WITH {READS} SELECT DISTINCT s AS sequence FROM reads")
def stream_rmdup(spark, sf_dir):
    return _drained(streaming.rmdup(_stream(spark, sf_dir, "reads"), "time", "3000 days").select("sequence"), spark)


@query("stream_pairs", f"WITH {READS} SELECT id, s AS r1, reverse(s) AS r2 FROM reads")
def stream_pairs(spark, sf_dir):
    a = _stream(spark, sf_dir, "reads").withColumn("id", F.concat("id", F.lit("/1")))
    b = _stream(spark, sf_dir, "reads").withColumns({"id": F.concat("id", F.lit("/2")), "sequence": F.reverse("sequence")})
    j = streaming.pairs(a, b, "time", "3000 days")
    return _drained(j.select("id", F.col("r1.sequence").alias("r1"), F.col("r2.sequence").alias("r2")), spark)


@query("stream_rename", f"WITH {q.GROUPED}, n AS (SELECT o, id, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM g) SELECT o AS ord, CASE WHEN n > 1 THEN id || '_' || CAST(n AS VARCHAR) ELSE id END AS id FROM n")
def stream_rename(spark, sf_dir):
    r = _stream(spark, sf_dir, "reads").withColumn("id", F.concat(F.lit("u"), (F.col(ORD) % 97).cast("string")))
    return _drained(streaming.rename(r.select(ORD, "id")).select(F.col(ORD).alias("ord"), "id"), spark)


@query("stream_stats", f"WITH {READS}, w AS (SELECT o // 300 AS w, s FROM reads) SELECT CAST(w * 300 AS BIGINT) AS started, count(*) AS num_sequences, CAST(sum(length(s)) AS BIGINT) AS total_length, round(CAST(sum({q._n('GC')}) AS DOUBLE) / sum({q._n('GCATU')}), 6) AS gc_content FROM w WHERE (w + 1) * 300 <= (SELECT max(o) - 60 FROM reads) GROUP BY w")
def stream_stats(spark, sf_dir):
    """Windows that the watermark has closed, a minute behind the last event."""
    s = streaming.stats(_stream(spark, sf_dir, "reads"), "time", "5 minutes", "1 minute")
    return _drained(s.select((F.unix_timestamp("window_start") - 300).alias("started"), "num_sequences", "total_length", _r("gc_content").alias("gc_content")), spark)


@query("stream_refusals", "SELECT * FROM (VALUES ('head'), ('sample_systematic'), ('sort'), ('split_by_parts')) t(name)")
def stream_refusals(spark, sf_dir):
    """What a stream cannot do says so."""
    stream = spark.readStream.format("rate").load()
    refused = []
    for name, call in (("head", lambda: streaming.head(stream, 3)), ("sort", lambda: streaming.sort(stream)), ("sample_systematic", lambda: streaming.sample_systematic(stream, 3)), ("split_by_parts", lambda: streaming.split_by_parts(stream, 2))):
        try:
            call()
        except SeqError:
            refused.append((name,))
    return spark.createDataFrame(refused, "name string")
